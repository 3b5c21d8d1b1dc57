"""Hand tables for the edge cases of single operators."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar as cal
from gridloom.functions import scalars as sc
from gridloom.operators import aggregates as ag
from gridloom.operators import anchors as an
from gridloom.operators import conformal as cf
from gridloom.operators import classify, events, joins, profiles, reconstruct, samples, windows
from gridloom.sources import sinks


def one(df):
    return df.first()[0]


def test_clip_keeps_missing(spark):
    d = spark.range(1).select(sc.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("c"), sc.log1p_nonneg(F.lit(None).cast("double")).alias("l"))
    assert d.first()["c"] is None and d.first()["l"] is None


def test_month_inverse_of_december(spark):
    d = spark.range(1).select(cal.month_start_of(F.lit(12 * 1996 + 12)).cast("string"), cal.label_of_ord(F.lit(12 * 1996 + 12)))
    assert tuple(d.first()) == ("1996-12-01", "1996-12")


def test_rollup_edges(spark):
    rows = [(1, f"2020-01-{d:02d}", 1.0) for d in range(1, 4)] + [(2, f"2020-01-{d:02d}", None) for d in range(1, 11)]
    rows += [(3, f"2020-01-{d:02d}", float(d)) for d in range(25, 32)] + [(3, f"2020-02-{d:02d}", 100.0) for d in range(1, 3)]
    df = spark.createDataFrame(rows, "c INT, day STRING, v DOUBLE").withColumn("day", F.to_date("day"))
    out = {(r["c"], r["month_start"].month): r for r in ag.monthly_rollup(df, "c", "day", "v").collect()}
    assert out[1, 1]["monthly_max_7day"] == 3.0  # fewer than seven days: the sum
    assert out[2, 1]["monthly_sum"] == 0.0 and out[2, 1]["monthly_mean"] is None
    assert out[3, 1]["monthly_max_7day"] == sum(range(25, 32)) and out[3, 2]["monthly_max_7day"] == 200.0


def test_interpolation_ends_and_gaps(spark):
    rows = [(i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])]
    df = spark.createDataFrame(rows, "t INT, v DOUBLE")
    got = [r["f"] for r in windows.interpolate_linear(df, [], "t", "v", "f").orderBy("t").collect()]
    assert got == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    empty = df.withColumn("v", F.lit(None).cast("double"))
    assert {r["f"] for r in windows.interpolate_linear(empty, [], "t", "v", "f").collect()} == {None}


def test_first_extreme_on_ties(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (4, 5.0), (0, None)], "i INT, v DOUBLE")
    r = df.agg(windows.first_at_min(F.col("v"), F.col("i")).alias("a"), windows.first_at_max(F.col("v"), F.col("i")).alias("b")).first()
    assert (r["a"], r["b"]) == (1, 2)


def test_conformal_positions(spark):
    rows = [(i, "validation", float(i), 0.0) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "sample_key LONG, split STRING, y DOUBLE, p DOUBLE")
    got = {r["level"]: r["qhat"] for r in cf.fit_conformal(df, cf.absolute_score("y", "p"), [0.75, 0.9]).collect()}
    import math

    for level, q in got.items():
        ql = min(math.ceil(20 * level) / 19, 1.0)
        assert q == 1 + math.ceil(ql * 18)
    single = df.where("sample_key = 5")
    assert cf.fit_conformal(single, cf.absolute_score("y", "p"), [0.9]).first()["qhat"] == 5.0
    with pytest.raises(ValueError):
        cf.fit_conformal(df, cf.absolute_score("y", "p"), [1.0])


def test_coverage_holds_on_the_fit_split(spark):
    rows = [(i, "validation", float((i * 37) % 101) / 10, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_key LONG, split STRING, y DOUBLE, p DOUBLE")
    c = cf.fit_conformal(df, cf.absolute_score("y", "p"), [0.9])
    s = cf.interval_summary(cf.apply_intervals(df, c, "p", [0.9]), "y", [0.9]).first()
    assert s["empirical_coverage"] >= 0.9 and s["radius_is_constant"]


def test_metrics_of_degenerate_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0)], "g STRING, p DOUBLE, y DOUBLE")
    out = {r["g"]: r for r in df.groupBy("g").agg(*ag.regression_metrics("p", "y")).collect()}
    assert out["a"]["pearson_r"] is None and out["b"]["r2"] is None and out["b"]["bias"] == 1.0


def test_coverage_guard(spark):
    left = spark.createDataFrame([(1,), (2,)], "cell_id LONG")
    right = spark.createDataFrame([(1, 0.5)], "cell_id LONG, base_wtd DOUBLE")
    with pytest.raises(Exception, match="no base_wtd"):
        joins.with_full_coverage(left, right, ["cell_id"], "base_wtd").collect()


def test_empty_season_is_an_error(spark):
    c = cal.observed_calendar(spark.sql("SELECT date'1996-01-05' AS d UNION ALL SELECT date'1996-03-02'"), "d")
    assert events.require_months(c, (12 * 1996 + 1, 12 * 1996 + 2)).count() == 2
    with pytest.raises(ValueError):
        sc.step_weight(F.lit(1), [1.0], [1.0])


def test_nearest_axis_ties_go_low(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 30.0)], "i INT, c DOUBLE")
    pts = spark.createDataFrame([(v,) for v in (-50.0, 5.0, 5.1, 20.0, 20.5, 99.0)], "v DOUBLE")
    got = {r["v"]: r["i"] for r in joins.nearest_on_axis(pts, "v", axis, "c", "i").collect()}
    assert got == {-50.0: 0, 5.0: 0, 5.1: 1, 20.0: 1, 20.5: 2, 99.0: 2}


def test_bands_are_checked():
    with pytest.raises(ValueError):
        profiles.check_bands([(0, 10), (5, 20)])
    with pytest.raises(ValueError):
        profiles.check_bands([(0, 2)], depths=(2.5, 7.5))
    with pytest.raises(ValueError):
        profiles.profile_view(None, (2.5, 7.5), max_depth=1.0)


def test_longest_run(spark):
    df = spark.createDataFrame([([True, False, True, True],), ([False],), ([],)], "f ARRAY<BOOLEAN>")
    assert [r[0] for r in df.select(profiles.longest_run(F.col("f"))).collect()] == [2, 0, 0]


def test_split_counts_follow_fractions(spark):
    cells = spark.range(103).withColumnRenamed("id", "grid_id")
    n = {r["grid_split"]: r["count"] for r in samples.seeded_cell_split(cells, 7, [("a", 0.5), ("b", 0.3), ("c", 0.2)]).groupBy("grid_split").count().collect()}
    assert n == {"a": 51, "b": 31, "c": 21}


def test_split_month_rule():
    rule = reconstruct.split_month
    assert [rule(0, g) for g in (6, 7, 11, 12, 17, 18, 24)] == [None, 3, 5, 6, 6, 12, 12]


def test_local_priors_modes(spark):
    obs = spark.createDataFrame(
        [(1, 10, 2.0, 1.0), (1, 20, 4.0, 1.0), (2, 5, 1.0, 2.0)], "grid_id LONG, month_idx INT, value DOUBLE, quality DOUBLE"
    )
    q = spark.createDataFrame([(1, 0), (1, 10), (1, 15), (1, 25), (1, 60), (2, 6), (2, 30), (3, 5)], "grid_id LONG, month_idx INT")
    got = {(r["grid_id"], r["month_idx"]): (r["mode"], r["prior_value"]) for r in an.local_priors(obs, q).collect()}
    assert got == {(1, 0): ("pre_nearest", 2.0), (1, 15): ("interpolate", 3.0), (1, 25): ("post_nearest", 4.0), (2, 6): ("single_near", 1.0)}


def test_release_guards(spark):
    panel = spark.createDataFrame([(1, 0, 1.0, -1.0), (1, 1, float("nan"), 0.1)], "grid_id LONG, month_idx INT, wtd DOUBLE, radius DOUBLE")
    r = sinks.release_violations(panel, 2, 2).first()
    assert (r["missing_cells"], r["nonfinite_values"], r["negative_radii"]) == (1, 1, 1)
    with pytest.raises(KeyError):
        sinks.release_product(panel.drop("radius"), panel, panel)


def test_mass_correction_reaches_target(spark):
    from gridloom.plans.panel_q import corrected, flagged_months, yields
    from gridloom.plans.tables import Tables
    from gridloom.operators.storage import storage_proxy

    from .conftest import SF

    t = Tables(spark, SF)
    moved, shift = corrected(t)
    # with the old cell references, the corrected monthly mean must equal the target
    sy = yields(t)
    before = storage_proxy(moved, sy, flagged_months(t).where("valid").select("month_idx"))
    gain = moved.join(sy.withColumnRenamed("sy", "_sy"), "grid_id").groupBy("month_idx").agg((F.lit(-100.0) * F.avg(F.col("applied") * F.col("_sy"))).alias("gain"))
    bad = before.join(gain, "month_idx").join(shift.select("month_idx", "target_cm"), "month_idx").where(
        F.abs(F.col("storage_cm") + F.col("gain") - F.col("target_cm")) > 1e-3
    )
    assert bad.count() == 0


def test_streaming_daily_totals(spark, tmp_path):
    from gridloom.streaming.rollup import daily_totals, write_daily

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events_df = spark.createDataFrame(
        [(1, "2024-01-01 01:00:00", 2.0), (1, "2024-01-01 23:00:00", 3.0), (2, "2024-01-02 05:00:00", 1.0), (9, "2024-03-01 00:00:00", 0.0)],
        "k LONG, ts STRING, v DOUBLE",
    ).withColumn("ts", F.to_timestamp("ts"))
    events_df.write.parquet(src)
    stream = spark.readStream.schema(events_df.schema).parquet(src)
    q = write_daily(daily_totals(stream, "ts", "k", "v"), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r["k"], str(r["day"]), r["total"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert (1, "2024-01-01", 5.0, 2) in got and (2, "2024-01-02", 1.0, 1) in got


def test_long_gaps_and_tail(spark):
    """A 24-month interval and a tail follow the step rule month by month; a missing prediction or path fails."""
    from gridloom.operators.regression import StatePredictor
    from gridloom.operators.uncertainty import greedy_paths

    paths = greedy_paths(24)
    assert paths[24] == (6, 6, 6, 6) and paths[23] == (6, 6, 6, 3, 1, 1) and all(sum(p) == g for g, p in paths.items())
    base = {(m, h): 0.01 * m + 0.1 * h for m in range(60) for h in (1, 3, 6)}
    slope = {1: 0.02, 3: 0.05, 6: 0.08}
    drv = spark.createDataFrame([(1, m, h, b, slope[h]) for (m, h), b in base.items()], "grid_id LONG, start_idx INT, h INT, base DOUBLE, slope DOUBLE")
    obs = spark.createDataFrame([(1, 14, 7.5, 1.0, 3), (1, 40, 2.0, 1.0, 3), (1, 43, 3.0, 1.0, 3)], "grid_id LONG, month_idx INT, value DOUBLE, quality DOUBLE, n_months INT")
    predictor = StatePredictor(drv)
    cfg = reconstruct.Settings(paths=paths)

    def states(left, gap, s):
        out = [s]
        for k in range(1, gap + 1):
            h = paths[k][-1]
            before = out[k - h]
            now = before - (base[left + k - h, h] + slope[h] * before)
            out.append({14: 7.5, 40: 2.0, 43: 3.0}.get(left + k, now))
        return out

    seg = spark.createDataFrame([(0, 1, 0, 24, 5.0)], "segment_id INT, grid_id LONG, left_idx INT, right_idx INT, state DOUBLE")
    got = {r["k"]: r["state"] for r in reconstruct.state_rows(reconstruct.propagate(seg, predictor, obs, cfg)).collect()}
    assert [got[k] for k in range(25)] == pytest.approx(states(0, 24, 5.0))
    anchors = spark.createDataFrame([(1, 36, 4.0)], "grid_id LONG, month_idx INT, value DOUBLE")
    tail = {r["month_idx"]: r["value"] for r in reconstruct.extrapolate_tail(anchors, 36, 55, predictor, obs, cfg).collect()}
    assert [tail[m] for m in range(37, 56)] == pytest.approx(states(36, 19, 4.0)[1:])
    gone = StatePredictor(drv.where("start_idx <> 6"))
    with pytest.raises(Exception, match="no prediction"):
        reconstruct.propagate(seg, gone, obs, cfg).collect()
    with pytest.raises(Exception, match="no path"):
        reconstruct.propagate(seg, predictor, obs, reconstruct.Settings(paths=greedy_paths(12))).collect()


def test_paths_must_be_complete(spark):
    from gridloom.operators import uncertainty

    cells = spark.createDataFrame([(1,), (2,)], "grid_id LONG")
    steps = uncertainty.plan_steps(spark.createDataFrame([(0, 2)], "left_idx INT, right_idx INT"), uncertainty.greedy_paths(2))
    radii = spark.createDataFrame([(1, 0, 1, 3.0), (1, 1, 1, 4.0), (2, 0, 1, 1.0)], "grid_id LONG, start_idx INT, h INT, radius DOUBLE")
    rss = uncertainty.discounted_rss(cells, steps, radii, 1.0)
    got = {(r["grid_id"], r["month_idx"]): (r["radius"], r["steps_found"], r["n_steps"]) for r in rss.collect()}
    assert got == {(1, 1): (3.0, 1, 1), (1, 2): (5.0, 2, 2), (2, 1): (1.0, 1, 1), (2, 2): (None, 1, 2)}
    with pytest.raises(Exception, match="lacks a step"):
        uncertainty.require_full_paths(rss).collect()
    obs = spark.createDataFrame([(1, 0), (1, 2), (2, 3)], "grid_id LONG, month_idx INT")
    dense = uncertainty.observed_month_radius(cells, 4, rss, obs, radii, 1)
    assert {(r["grid_id"], r["month_idx"]): r["radius"] for r in dense.collect()} == {
        (1, 0): 0.0, (1, 1): 3.0, (1, 2): 4.0, (1, 3): 0.0, (2, 0): 0.0, (2, 1): 1.0, (2, 2): None, (2, 3): None,
    }


def test_pumping_years_beyond_sixty_four(spark):
    rows = [(1, m, 1.0) for m in range(70 * 12)]
    df = spark.createDataFrame(rows, "grid_id LONG, month_idx INT, pumping DOUBLE")
    r = profiles.pumping_features(df, 12 * 1900 + 1, 1950).first()
    assert (r["mean_annual"], r["mean_growing"], r["mean_monthly"], r["event_sum"]) == (12.0, 7.0, 1.0, 6.0)


def test_predictor_uses_rows_with_missing_features(spark):
    from gridloom.operators import regression

    rows = [(i, 1, float(i), None if i % 2 else 1.0 + i, 2.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "k LONG, h INT, a DOUBLE, b DOUBLE, y DOUBLE")
    out = regression.predict_members(df, regression.fit_members(df, ["a", "b"], "y", "k", [1, 2]), ["a", "b"])
    assert out.count() == 40 and out.where("y_pred IS NULL").count() == 0


def test_calibration_fits_only_missing_levels(spark):
    from gridloom.operators import conformal

    have = spark.createDataFrame([(1, 0.9, 2.0)], "h INT, level DOUBLE, qhat DOUBLE")
    asked = []

    def fit(levels):
        asked.append(levels)
        return spark.createDataFrame([(1, v, 1.0) for v in levels], "h INT, level DOUBLE, qhat DOUBLE")

    assert conformal.extend_calibration(have, fit, [0.9]).count() == 1 and asked == []
    assert conformal.extend_calibration(have, fit, [0.9, 0.75]).count() == 2 and asked == [[0.75]]


def test_points_far_off_the_axis(spark):
    axis = spark.createDataFrame([(float(c), i) for i, c in enumerate((0, 10, 30))], "c DOUBLE, i INT")
    pts = spark.createDataFrame([(v,) for v in (-1e12, 0.0, 5.0, 5.1, 20.0, 20.1, 30.0, 1e12)], "v DOUBLE")
    assert {r["v"]: r["i"] for r in joins.nearest_on_axis(pts, "v", axis, "c", "i").collect()} == {-1e12: 0, 0.0: 0, 5.0: 0, 5.1: 1, 20.0: 1, 20.1: 2, 30.0: 2, 1e12: 2}


def test_hot_file_names_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(6000).select(
        F.col("id").alias("grid_id"), F.when(F.col("id") < 5000, "pump1_1km_m3_1996_Jan").when(F.col("id") < 5999, "pump2_1km_m3_1996_Feb").alias("file")
    )
    sinks.write_named_files(rows, str(tmp_path / "named"), "file", ["grid_id"], rows_per_file=500)
    files = lambda name: [p for p in (tmp_path / "named" / f"file={name}").iterdir() if p.suffix == ".parquet"]
    assert len(files("pump1_1km_m3_1996_Jan")) > 4 and len(files("__HIVE_DEFAULT_PARTITION__")) == 1
    stored = spark.read.parquet(str(tmp_path / "named"))
    assert stored.count() == 6000 and stored.where("file IS NULL").count() == 1
    biggest = stored.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0]
    assert biggest <= 500


def test_padding_takes_no_part_in_scalers(spark):
    rows = spark.createDataFrame(
        [([(1.0, 2.0), (3.0, 4.0), (0.0, 0.0)], 2), ([(5.0, 9.0), (0.0, 0.0), (0.0, 0.0)], 1), ([(7.0, 7.0)], 0), ([(8.0, 8.0)], None), (None, 2)],
        "sequence ARRAY<STRUCT<a: DOUBLE, b: DOUBLE>>, n INT",
    )
    got = {r.feature: (r.mean, r.std) for r in ag.sequence_scaler_rows(rows, "sequence", "n", ["a", "b"]).collect()}
    assert got["a"] == pytest.approx((3.0, (8 / 3) ** 0.5 + 1e-6)) and got["b"][0] == pytest.approx(5.0)


def test_sidecar_counts_what_it_writes_and_omits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "train"), (3, None), (4, "test")], "grid_id LONG, split STRING")
    got = sinks.write_samples_with_sidecar(rows, str(tmp_path / "s"), ["train", "test", "none"], ["grid_id"])
    assert {r.split: (r.n, r.omitted) for r in got.collect()} == {"train": (2, 1), "test": (1, 1), "none": (0, 1)}
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_samples_with_sidecar(rows, str(tmp_path / "t"), ["train"], ["grid_id"])
    with pytest.raises(KeyError):
        sinks.write_samples_with_sidecar(rows, str(tmp_path / "u"), ["train"], ["depth"])


def test_equal_cells_keep_equal_ranks(spark):
    """Copies of a cell whose rows come in another order have the same means to the last bit, so they share every rank."""
    windows = events.DroughtWindows.of_year(1996, base_year=1995, recovery_year=2000)
    value = lambda m, g: 0.1 * ((7 * m + g) % 13) + (3.0 if 16 <= m <= 18 else 0.0)
    rows = [(g, m, value(m, g)) for g in range(10) for m in range(84)] + [(100 + g, m, value(m, g)) for g in range(10) for m in reversed(range(84))]
    panel = spark.createDataFrame(rows, "grid_id long, month_idx int, wtd double").coalesce(1)
    ranks = classify.response_ranks(events.drought_metrics(panel, windows, 12 * 1995 + 1)).collect()
    by_cell = {}
    for r in ranks:
        by_cell.setdefault(r["grid_id"] % 100, set()).add(tuple(r)[1:])
    assert len(ranks) == 20 and all(len(found) == 1 for found in by_cell.values())
