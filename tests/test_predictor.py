"""Members fitted from moment sums, step tables, publishing, and joins that must not lose rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import anchors, regression, trees
from gridloom.session import scratch_path
from gridloom.sources import sinks

NAMES = ["s", "a", "b"]


def member_brute(rows, h, seed, ridge=1e-3):
    """Weighted ridge on scaled features, as a dense solve."""
    x = np.array([[np.nan if v is None else v for v in r[3:6]] for r in rows if r[1] == h and r[2] is not None], float)
    y = np.array([r[2] for r in rows if r[1] == h and r[2] is not None])
    keys = np.array([r[0] for r in rows if r[1] == h and r[2] is not None])
    d = (keys % 1000003 * 48271 + seed * 104729) % 2147483647 % 1000
    w = np.select([d < 368, d < 736, d < 920], [0.0, 1.0, 2.0], 3.0)
    mean, spread = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    spread[spread == 0] = 1
    z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / spread)])
    a = z.T @ (z * w[:, None]) + np.diag([0.0] + [ridge * w.sum()] * 3)
    c = np.linalg.solve(a, z.T @ (w * y))
    return c[0] - (c[1:] / spread * mean).sum(), c[1:] / spread, mean


def test_members_match_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        s, a, b = rng.normal(2, 3), rng.normal(), 7.0
        h = int(rng.choice([1, 3]))
        y = None if k % 50 == 0 else float(0.4 * s - 2 * a * h + rng.normal() * 0.1)
        rows.append((k * 977, h, y, float(s), None if k % 17 == 0 else float(a), b, k, 0))
    df = spark.createDataFrame(rows, "key LONG, h INT, y DOUBLE, s DOUBLE, a DOUBLE, b DOUBLE, grid_id LONG, start_idx INT")
    fitted = regression.fit_members(df, NAMES, "y", "key", [11, 22])
    got = {(r["h"], r["seed"]): r for r in fitted.collect()}
    assert sorted(got) == [(1, 11), (1, 22), (3, 11), (3, 22)]
    want = {k: member_brute(rows, *k) for k in got}
    for k, (intercept, coef, _) in want.items():
        assert got[k]["intercept"] == pytest.approx(intercept) and got[k]["coef"] == pytest.approx(coef.tolist())

    def value(r, seed):
        c0, c, mean = want[r["h"], seed]
        x = [m if r[f] is None else r[f] for f, m in zip(NAMES, mean)]
        return c0 + float(np.dot(c, x))

    for r in regression.predict_members(df, fitted, NAMES).collect():
        assert r["y_pred"] == pytest.approx(value(r, r["seed"]))
    for r in regression.member_spread(df, fitted, NAMES).collect():
        assert r["spread"] == pytest.approx(np.std([value(r, s) for s in (11, 22)]), abs=1e-12)
    steps = regression.StatePredictor.of_members(df.withColumn("level", F.lit(1.5)), fitted, NAMES, "s", "level").table
    for r in steps.join(df, ["grid_id", "start_idx", "h"]).collect():
        state = 0.25  # as an anomaly; the members see it with the level added
        both = [value({**r.asDict(), "s": state + 1.5}, s) for s in (11, 22)]
        assert r["base"] + r["slope"] * state == pytest.approx(np.mean(both))
    assert regression.fit_members(df.limit(0), NAMES, "y", "key", [11]).count() == 0


def test_unknown_cells_and_months_raise(spark):
    panel = spark.createDataFrame([(1, 0, 2.0, 0.1), (2, 1, 3.0, 0.1)], "grid_id LONG, month_idx INT, wtd DOUBLE, radius DOUBLE")
    level = spark.createDataFrame([(1, 0.5), (2, None)], "grid_id LONG, base_wtd DOUBLE")
    assert {r["a"] for r in anchors.to_anomaly(panel, level, "wtd", "a").collect()} == {1.5, None}
    with pytest.raises(Exception, match="no long-term level"):
        anchors.from_anomaly(panel, level.where("grid_id = 1"), "wtd", "a").collect()
    cells = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0, 0.0)], "grid_id LONG, x DOUBLE, y DOUBLE, lon DOUBLE, lat DOUBLE")
    months = spark.createDataFrame([(0, "a", 1995), (1, "b", 1995)], "month_idx INT, month_label STRING, year INT")
    assert sinks.release_product(panel, cells, months).count() == 2
    for c, m in ((cells.where("grid_id = 1"), months), (cells, months.where("month_idx = 0"))):
        with pytest.raises(Exception, match="is not known"):
            sinks.release_product(panel, c, m).collect()


def test_publish_is_all_or_nothing(spark):
    path = scratch_path(spark, "publish-test")
    cells = spark.createDataFrame([(1,), (2,)], "grid_id LONG")
    months = spark.createDataFrame([(0, "a"), (1, "b")], "month_idx INT, month_label STRING")
    full = cells.crossJoin(months).select("grid_id", "month_idx", F.lit(1995).alias("year"), F.lit(1.0).alias("wtd"))

    def go(panel):
        check = lambda s: sinks.require_dense(s["panel"], s["cells"], s["months"])
        sinks.publish(path, {"panel": panel, "cells": cells, "months": months}, check)

    go(full)
    for bad in (full.where("grid_id = 1"), full.where("grid_id = 1 OR month_idx = 0"), full.withColumn("wtd", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="cannot be released"):
            go(bad)
    stored = sinks.published(spark, path)
    assert set(stored) == {"panel", "cells", "months"} and stored["panel"].count() == 4
    go(full.withColumn("wtd", F.lit(2.0)))
    assert {r["wtd"] for r in sinks.published(spark, path)["panel"].collect()} == {2.0}


def test_extra_trees_of_hard_cases(spark):
    """Missing values, a feature without values, a constant one, repeated values and a node that cannot be split."""
    rows = spark.createDataFrame(
        [(i, i % 2, float(i >= 40), float(i) if i % 7 else None, None, 5.0, float(i % 3)) for i in range(80)], "grid_id LONG, fold INT, y DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE"
    )
    settings = trees.TreeSettings(trees=8, min_leaf=5)
    found = {r["grid_id"]: r for r in trees.block_validated_trees(rows, ["a", "b", "c", "d"], "y", 2, settings).collect()}
    assert len(found) == 80 and all(0 <= r["p_oof"] <= 1 and 0 <= r["p_final"] <= 1 for r in found.values())
    assert found[3]["p_final"] < 0.2 and found[78]["p_final"] > 0.8
    shares = {r["feature"]: r["importance"] for r in trees.feature_importances(rows, ["a", "b", "c", "d"], "y", settings).collect()}
    assert set(shares) <= {"a", "d"} and shares["a"] > 0.7 and abs(sum(shares.values()) - 1) < 1e-9
    one_class = rows.withColumn("y", F.lit(1.0))
    assert {r["p_oof"] for r in trees.block_validated_trees(one_class, ["a", "d"], "y", 2, settings).collect()} == {1.0}
    assert trees.block_validated_trees(rows.limit(0), ["a", "d"], "y", 2, settings).count() == 0


def test_trees_of_small_groups_equal_those_of_levels(spark):
    """A bound of 1 row leaves all nodes to grouped aggregations, one of 40 rows mixes both: same leaves and splits."""
    rows = spark.range(150).selectExpr("id AS grid_id", "CAST(id % 3 AS INT) AS fold", "CAST(id % 7 < 3 OR id > 120 AS DOUBLE) AS y", "CAST(id * 37 % 101 AS DOUBLE) AS a", "IF(id % 9 = 0, NULL, CAST(id AS DOUBLE)) AS b", "CAST(id % 4 AS DOUBLE) AS c")
    inputs = trees.forest_inputs(rows, ["a", "b", "c"], "y", [0, trees.FINAL], "grid_id").localCheckpoint()
    found = []
    for bound in (1, 40, 150):
        leaves, splits = trees.grow(inputs, 3, trees.TreeSettings(trees=3, min_leaf=4, local_values=3 * bound))
        found.append((sorted(map(tuple, leaves.select("forest", "tree", "id", "p").collect())), sorted(map(tuple, splits.select("forest", "tree", "node", "feature", "decrease").collect()))))
    assert len(found[0][0]) == 2 * 3 * 150 and len(found[0][1]) > 20
    assert found[0] == found[1] == found[2]


def test_small_forests_grow_in_a_few_jobs(spark):
    """500 trees of a small table took jobs for every level of the deepest tree, and broadcasts in each."""
    rows = spark.range(400).selectExpr("id AS grid_id", "CAST(id % 2 AS INT) AS fold", "CAST(id * 13 % 5 < 2 AS DOUBLE) AS y", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 61 % 211 AS DOUBLE) AS b")
    inputs = trees.forest_inputs(rows, ["a", "b"], "y", [0, 1, trees.FINAL], "grid_id").localCheckpoint()
    spark.sparkContext.setJobGroup("small-forests", "")
    leaves, _ = trees.grow(inputs, 2, trees.TreeSettings())
    n = leaves.count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == 3 * 500 * 400
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small-forests")) < 15


def test_forests_above_four_million_values_are_not_copied_per_tree(spark, monkeypatch):
    """such forests went by levels, which copied the features of every row once per tree and wrote a row per row and tree."""
    monkeypatch.setattr(trees, "_by_levels", None)
    names = [f"f{i}" for i in range(70)]
    values = [F.expr(f"CAST(id * {2 * i + 37} % {1009 + i} AS DOUBLE)").alias(n) for i, n in enumerate(names)]
    rows = spark.range(60_000).select(F.col("id").alias("grid_id"), F.expr("CAST(id % 2 AS INT)").alias("fold"), F.expr("CAST(id * 13 % 5 < 2 AS DOUBLE)").alias("y"), *values)
    settings, written, stored = trees.TreeSettings(trees=2, min_leaf=20_000), [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: written.append((name, df.columns, stored(df, name).count())) or stored(df, name))
    assert trees.probabilities(rows, names, "y", [0, 1], settings).count() == 2 * 60_000
    assert written[-1] == ("trees", ["forest", "trees", "ids", "p"], 2 * 2)


def test_large_nodes_split_as_near_ones(monkeypatch):
    """A node too large for a copy of its rows is split a feature at a time, with the same cuts."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random(3000).astype(np.float32), rng.random(3000), rng.integers(0, 3, 3000), np.where(rng.random(3000) < 0.2, np.nan, rng.random(3000)), np.ones(3000)])
    y, train = rng.random(3000) < x[:, 1], rng.random(3000) < 0.7
    found = []
    for near in (8192, 500, 64):
        monkeypatch.setattr(trees, "NEAR", near)
        p, splits = trees._tree(trees._of_matrix(x), y, train, 12345, "", trees.TreeSettings(min_leaf=7))
        found.append((p.tolist(), sorted(splits)))
    assert len(found[0][1]) > 50 and found[0] == found[1] == found[2]
