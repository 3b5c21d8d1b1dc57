"""Plans at larger tables: what is exploded from a small table must not be broadcast."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .conftest import SF


def exploded_broadcasts(df) -> list[str]:
    """Broadcasts of the plan that read a generator's rows as they are (their estimate is that of the table before it)."""
    lines = [line.strip(" :+-") for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    found = []
    for i, line in enumerate(lines):
        if line.startswith("BroadcastExchange"):
            below = next(x for x in lines[i + 1 :] if not x.startswith(("Project", "Filter")))
            found += [below] if below.startswith("Generate") else []
    return found


@pytest.mark.parametrize("name", ["d16_storage_proxy", "d18_mass_correction", "d18_mass_correction_monthly"])
def test_panels_are_not_broadcast(spark, name):
    assert exploded_broadcasts(entry.queries()[name](spark, SF)) == []


def test_steps_are_packed_per_cell(spark):
    """No row per step: the propagation joins and shuffles by cell only, whatever the length of the interval."""
    text = entry.queries()["j03_propagate_long_gaps"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in text.splitlines() if "hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if line.split("hashpartitioning(")[1].count("#") > 1 and "grid_id" in line]


def test_stage_tables_are_columnar(spark):
    """Stages are compressed tables in the shared folder, not uncompressed checkpoints of rows."""
    from gridloom.plans.tables import Tables

    t = Tables(spark, SF)
    assert "FileScan parquet" in t.stage("cells", lambda: t.cells)._jdf.queryExecution().executedPlan().toString()


def test_windows_ahead_shuffle_no_row_per_month(spark):
    """the inputs of a cell are one packed row, so no shuffle carries its months, horizons or sequences as rows."""
    from gridloom.plans import joins_q, predict_q
    from gridloom.plans.tables import Tables

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    try:
        t = Tables(spark, SF)
        plans = [joins_q.c07(t), joins_q.c06(t), predict_q.step_inputs(t)]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all("Window" not in p and "hashpartitioning(grid_id#" in p for p in plans[:2])
    for exchange in re.findall(r"hashpartitioning\(([^)]*)\)", plans[0] + plans[1]):
        assert "start_idx" not in exchange and " h#" not in exchange
    assert "Exchange" not in plans[2]


def test_packed_months_equal_rows(spark):
    """Sums and sequences from packed months are those of windows over rows, with gaps, nulls and cells without facts."""
    from gridloom.operators import joins

    cells = spark.range(4).withColumnRenamed("id", "grid_id")
    facts = spark.createDataFrame([(0, 0, 1.5), (0, 2, 0.1), (0, 5, None), (1, 9, 0.3), (1, 3, 0.7), (2, 12, 9.0)], "grid_id LONG, month_idx INT, v DOUBLE")
    rows = joins.densify(cells, facts, 10).na.fill(0.0, ["v"])
    sums, seqs = joins.forward_sums(rows, ["v"], [1, 3]), joins.forward_sequences(rows, ["v"], [1, 3])
    packed = joins.pack_months(cells, facts, ["v"], 10)
    assert sorted(map(tuple, packed.select("grid_id", F.inline("months")).collect())) == sorted(map(tuple, rows.select("grid_id", "month_idx", "v").collect()))
    steps = F.array(*[F.struct(F.lit(k).alias("start_idx"), F.lit(h).alias("h")) for k in range(-1, 11) for h in (1, 3)])
    at = packed.select("*", F.inline(steps)).where(joins.inside_months(10))
    found = at.select("grid_id", "start_idx", "h", joins.packed_sum("v", [1, 3]), joins.packed_sequence(["v"], 3))
    wanted = sums.join(seqs, ["grid_id", "start_idx", "h"]).select("grid_id", "start_idx", "h", "sum_v", "sequence")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_local_anchors_deal_cells_once(spark):
    """No window or join over the panel; cells that go on in the next batch of a task are whole."""
    from gridloom.operators import anchors

    panel = spark.range(40).selectExpr("id AS grid_id", "explode(sequence(0, 11)) AS month_idx").selectExpr("*", "sin(grid_id + month_idx) AS value")
    obs = panel.where("grid_id % 4 > 0 AND (grid_id * 7 + month_idx * 5) % 11 < grid_id % 4").selectExpr("grid_id", "month_idx", "value + 1 AS value", "2D AS quality")
    obs = obs.unionByName(obs.limit(1).selectExpr("grid_id", "99 AS month_idx", "value", "quality"))  # outside the panel
    plan = anchors.apply_local_anchors(panel, obs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    whole = sorted(map(tuple, anchors.apply_local_anchors(panel, obs).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(tuple, anchors.apply_local_anchors(panel, obs).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) == 480 and {r[2] for r in whole} == {"none", "single_obs", "exact", "bridge", "edge"}
    seen = {tuple(r)[:2]: r["value"] for r in obs.collect()}
    by = {r[:2]: r for r in whole}
    for g in range(40):
        months = sorted(m for c, m in seen if c == g and m < 12)
        for a, b in zip(months, months[1:]) if len(months) > 1 else []:
            for m in range(a + 1, b):  # quality 2 on both sides: score 0.4, fading with the gap
                alpha = (0.35 + 0.45 * 0.4) / (1 + (b - a - 1) / 12)
                line = seen[g, a] + (seen[g, b] - seen[g, a]) * (m - a) / (b - a)
                x = math.sin(g + m)
                assert by[g, m][2] == "bridge" and by[g, m][3] == pytest.approx((1 - alpha) * x + alpha * line)


def test_packed_steps_equal_a_table_of_steps(spark):
    """Steps made from the packed months of a cell run like a table with a row per cell, month and horizon; no such table is written."""
    from gridloom.operators import reconstruct, regression
    from gridloom.operators.uncertainty import greedy_paths
    from gridloom.plans import predict_q, recon_q
    from gridloom.plans.tables import Tables

    t = Tables(spark, SF)
    packed = predict_q.predictor(t)
    assert packed.table is None and "predictor" not in t._stages
    table = regression.StatePredictor.of_members(predict_q.step_inputs(t), predict_q.members(t), predict_q.FEATURES, predict_q.STATE, "base_wtd")
    pairs = F.explode(F.array(*[F.array(*map(F.lit, p)) for p in ((0, 0, 12), (1, 60, 71), (2, 12, 13))])).alias("p")
    seg = t.cells.select("grid_id", pairs).selectExpr("grid_id", "p[0] AS segment_id", "p[1] AS left_idx", "p[2] AS right_idx", "0.5D AS state")
    cfg = reconstruct.Settings(paths=greedy_paths(12))
    found = []
    for p in (packed, table):
        rows = reconstruct.state_rows(reconstruct.propagate(seg, p, recon_q.observed(t), cfg)).collect()
        found.append({(r["segment_id"], r["grid_id"], r["k"]): r["state"] for r in rows})
    assert len(found[0]) == t.cells.count() * (13 + 12 + 2) and found[0].keys() == found[1].keys()
    assert [found[0][k] for k in found[0]] == pytest.approx([found[1][k] for k in found[0]], abs=1e-12)


def test_radii_meet_their_paths_by_cell(spark):
    """paths, radii and observed months are joined by cell, so no row per step or month is shuffled for a join."""
    from gridloom.operators import uncertainty

    cells = spark.range(3).withColumnRenamed("id", "grid_id")
    steps = uncertainty.plan_steps(spark.createDataFrame([(0, 8)], "left_idx INT, right_idx INT"), uncertainty.greedy_paths(8))
    radii = spark.range(3).selectExpr("id AS grid_id", "explode(sequence(0, 7)) AS start_idx").selectExpr("*", "explode(array(1, 3, 6)) AS h", "CAST(grid_id + start_idx AS DOUBLE) AS radius")
    path = uncertainty.discounted_rss(cells, steps, radii)
    dense = uncertainty.observed_month_radius(cells, 9, path, cells.selectExpr("grid_id", "4 AS month_idx"), radii, 1)
    text = dense._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert all(d.count("#") == 1 for d in dealt if "grid_id" in d)
    assert [r["radius"] for r in dense.where("grid_id = 1 AND month_idx IN (0, 4)").orderBy("month_idx").collect()] == [0.0, 4.0]


def test_arrays_of_tiles_are_compressed():
    """what a tile never changes is kept in a checkpoint, which compresses nothing itself."""
    import numpy as np

    from gridloom.operators import tiles

    diag = np.repeat(np.arange(1000.0), 16).reshape(1000, 16)
    blob = tiles._bytes(diag)[0]
    assert len(blob) < diag.nbytes / 8 and (tiles._array(blob).reshape(1000, 16) == diag).all()


def test_intervals_run_where_their_cell_is_stored(spark):
    """no row with months is shuffled or sorted for the right ends; packed cells give the states of the joined ones."""
    from gridloom.operators import reconstruct
    from gridloom.plans import recon_q
    from gridloom.plans.tables import Tables

    plan = entry.queries()["j04_endpoint_correction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "grid_id" in p] and "Sort" not in plan
    t = Tables(spark, SF)
    cells = recon_q.stored_cells(t)
    # a cell without observations, one without its last anchor, one whose anchor has no value
    first = F.when(F.col("grid_id") != 3, F.col("obs")).alias("obs")
    changed = F.transform("states", lambda s: F.struct(s["month_idx"].alias("month_idx"), F.when((F.col("grid_id") != 5) | (s["month_idx"] != 24), s["value"]).alias("value")))
    kept = F.filter(changed, lambda s: (F.col("grid_id") != 4) | (s["month_idx"] != 83)).alias("states")
    cells = cells.select(*[c for c in cells.columns if c not in ("obs", "states")], first, kept)
    anchors, states = recon_q.anchor_list(t), cells.select("grid_id", F.inline("states"))
    obs = recon_q.observed(t).where("grid_id <> 3")
    seg = reconstruct.with_ends(reconstruct.root_segments(states, anchors), states)
    joined = reconstruct.propagate(seg, recon_q.predictor(t), obs, recon_q.CFG)
    packed = reconstruct.propagate_cells(cells, list(zip(anchors[:-1], anchors[1:])), recon_q.predictor(t), recon_q.CFG)
    found = [{(r["segment_id"], r["grid_id"]): tuple(r) for r in d.collect()} for d in (joined, packed)]
    n = t.cells.count()
    assert len(found[0]) == n * (len(anchors) - 1) - 1 and found[0] == found[1]
    with pytest.raises(ValueError):
        reconstruct.propagate_cells(cells, [(0, 24)], recon_q.predictor(t), recon_q.CFG)


def test_unsplit_panel_is_made_where_its_cells_are(spark):
    """summary and locally anchored panel of packed cells equal those of rows of months, which shuffle them all."""
    from dataclasses import replace

    from gridloom.operators import anchors as an
    from gridloom.operators import reconstruct
    from gridloom.plans import recon_q
    from gridloom.plans.tables import Tables

    t = Tables(spark, SF)
    cfg = replace(recon_q.CFG, split_rmse=1e9, split_p95=1e9)
    months = recon_q.JANUARIES
    cells, steps, pairs = recon_q.stored_cells(t), recon_q.predictor(t), list(zip(months[:-1], months[1:]))
    # a cell without observations, one whose anchor has no value
    first = F.when(F.col("grid_id") != 3, F.col("obs")).alias("obs")
    changed = F.transform("states", lambda s: F.struct(s["month_idx"].alias("month_idx"), F.when((F.col("grid_id") != 5) | (s["month_idx"] != 24), s["value"]).alias("value")))
    cells = cells.select(*[c for c in cells.columns if c not in ("obs", "states")], first, changed.alias("states"))
    states, obs, counts = cells.select("grid_id", F.inline("states")), recon_q.observed(t).where("grid_id <> 3"), recon_q.month_counts(t)
    n_month = {r["month_idx"]: r["n_month"] for r in counts.collect()}
    rows, summary = reconstruct.run_segments(reconstruct.root_segments(states, months), steps, obs, counts, states, None, cfg)
    tail = reconstruct.extrapolate_tail(states, months[-1], 83, steps, obs, cfg)
    wanted = an.apply_local_anchors(reconstruct.merge_segments(rows).unionByName(tail), obs, **recon_q.LOCAL).drop("mode")
    wanted = an.from_anomaly(wanted, t.baseline, "value", "value")
    panel = reconstruct.panel_of_cells(cells, pairs, steps, n_month, cfg, recon_q.LOCAL, 83, "base_wtd")
    assert "Exchange" not in panel._jdf.queryExecution().executedPlan().toString()
    found = [{(r["grid_id"], r["month_idx"]): r["value"] for r in d.collect()} for d in (panel, wanted)]
    assert len(found[0]) == t.cells.count() * 84 and found[0].keys() == found[1].keys()
    same = [(a, found[1][k]) for k, a in found[0].items()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in same)
    assert any(a is None for a, _ in same)
    mine, cuts = reconstruct.flagged_segments(reconstruct.segment_summary(reconstruct.ends_of_cells(cells, pairs, steps, n_month, cfg)), set(n_month), cfg)
    assert not cuts and len(mine) == len(summary) == 6
    by = {r["segment_id"]: r for r in summary}
    for r in mine:
        assert r.keys() == by[r["segment_id"]].keys()
        assert all(v == pytest.approx(by[r["segment_id"]][k], abs=1e-12) for k, v in r.items())


def test_harmonic_months_meet_their_observations_without_broadcasts(spark, tmp_path):
    """Months and observations of the fitted cells both come dealt by cell; their union has to bring them together."""
    from gridloom.operators import anchors as an

    rows = [(i % 500, (i // 500) * 5, math.cos(math.pi / 6 * ((i // 500) * 5)), 1.0) for i in range(500 * 16)]
    spark.createDataFrame(rows, "grid_id long, month_idx int, value double, quality double").write.parquet(str(tmp_path / "obs"))
    obs = spark.read.parquet(str(tmp_path / "obs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = {r["is_pseudo"]: r["count"] for r in an.harmonic_pseudo_obs(obs, 84).groupBy("is_pseudo").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert counts == {False: 500 * 16, True: 500 * (84 - 16)}
