"""Extremely randomised trees: queries and their recursive SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import classify, profiles, trees
from gridloom.plans.panel_q import NATIVE, PUMPING
from gridloom.plans.registry import query
from gridloom.plans.sqlbase import with_blocks
from gridloom.plans.tables import DEPTHS, FIRST_ORD, Tables
from gridloom.session import cut_lineage

FOLDS = 5
#: the twins grow the same trees, but only twenty of them
TWIN = trees.TreeSettings(trees=20)


def forest_rows(t: Tables) -> tuple[DataFrame, list[str]]:
    """Native layers and pumping logs per labelled cell, with its spatial fold."""
    native = profiles.native_columns(t.profiles, DEPTHS)
    pumping = profiles.pumping_features(t.forcing_sparse, FIRST_ORD, 1996)
    names = [c for c in native.columns if c != "grid_id"]
    logs = ["log1p_mean_annual", "log1p_mean_growing", "log1p_event_sum", "log1p_peak_month"]
    cells = t.profiles.select(
        "grid_id", (F.pmod(F.col("grid_id"), F.lit(20)) * F.lit(1000.0)).alias("x"), (F.floor(F.col("grid_id") / 20) * F.lit(1000.0)).alias("y")
    )
    folds = classify.block_folds(classify.spatial_blocks(cells, 5000.0), 5).select("grid_id", "fold")
    target = t.raw("embeddings").select(F.col("vec_id").alias("grid_id"), (F.col("label") <= 2).cast("double").alias("y"))
    rows = native.join(target, "grid_id").join(folds, "grid_id").join(pumping.select("grid_id", *logs), "grid_id", "left")
    return rows, names + logs


@query("l04_forest_probabilities", "grid_id:i fold:i y:f p_oof:f p_final:f")
def l04(t: Tables) -> DataFrame:
    rows, features = forest_rows(t)
    return trees.block_validated_trees(cut_lineage(rows), features, "y", FOLDS)


@query("l04_forest_evaluation", "n_rows:i n_pos:i cutoff:f tp:i fp:i fn:i precision:f recall:f roc_auc:f average_precision:f brier:f")
def l04_evaluation(t: Tables) -> DataFrame:
    rows, features = forest_rows(t)
    rows = cut_lineage(rows)
    p = trees.probabilities(rows, features, "y", range(FOLDS), trees.TreeSettings())
    return classify.binary_evaluation(trees.out_of_fold(rows, p, "y"), "p_oof", "y")


@query("f04_top_importances", "feature:s importance:f")
def f04(t: Tables) -> DataFrame:
    rows, features = forest_rows(t)
    return trees.feature_importances(cut_lineage(rows), features, "y", top=15)


NAMES = [*NATIVE, "log1p_mean_annual", "log1p_mean_growing", "log1p_event_sum", "log1p_peak_month"]


def scrambled_sql(x: str) -> str:
    """The keyed draw of :mod:`gridloom.operators.trees`."""
    p = trees.PRIME
    return f"[(c * c + 7) % {p} FOR c IN [(b * 48271 + 11) % {p} FOR b IN [(a * a + 1013904223) % {p} FOR a IN [CAST({x} AS BIGINT)]]]][1]"


def _growth_sql(settings: trees.TreeSettings, forests: str) -> tuple[tuple[str, str], ...]:
    p, m = trees.PRIME, settings.min_leaf
    still = f"{{n}} >= {2 * m} AND {{pos}} > 0 AND {{pos}} < {{n}}"
    members = "SELECT g.forest, g.tree, g.id, g.node, g.key, g.n, g.pos, train, y, x FROM grow g JOIN fi USING (forest, id) WHERE g.open"
    draws = f"""SELECT forest, tree, node, i, lo + {scrambled_sql(f'(key + (i + 1) * 40503001) % {p}')} / {p}.0::DOUBLE * (hi - lo) AS cut FROM
        (SELECT forest, tree, node, key, i, min(v) AS lo, max(v) AS hi FROM (SELECT forest, tree, node, key, unnest(range({len(NAMES)})) AS i, unnest(x) AS v FROM ({members}) WHERE train) GROUP BY ALL)
        WHERE lo < hi QUALIFY row_number() OVER (PARTITION BY forest, tree, node ORDER BY {scrambled_sql(f'(key + (i + 1) * 69621007) % {p}')}) <= {settings.drawn(len(NAMES))}"""
    purity = lambda pos, n: f"({pos} * {pos} + ({n} - {pos}) * ({n} - {pos})) / ({n})"
    sides = f"""SELECT forest, tree, node, n, pos, i, cut, CAST(count(*) FILTER (x[i + 1] <= cut) AS BIGINT) AS nl, CAST(coalesce(sum(y) FILTER (x[i + 1] <= cut), 0) AS BIGINT) AS pl
        FROM ({members}) JOIN ({draws}) USING (forest, tree, node) WHERE train GROUP BY ALL"""
    best = f"""SELECT *, {purity('pl', 'nl')} + {purity('(pos - pl)', '(n - nl)')} AS gain FROM ({sides}) WHERE nl >= {m} AND n - nl >= {m}
        QUALIFY row_number() OVER (PARTITION BY forest, tree, node ORDER BY gain DESC, i) = 1"""
    step = f"""SELECT lvl + 1 AS lvl, forest, tree, id, node || CASE WHEN r THEN '1' ELSE '0' END AS node, {scrambled_sql(f'(key * 16807 + CAST(r AS BIGINT) + 1) % {p}')} AS key, n, pos, {still.format(n='n', pos='pos')} AS open, node AS parent, i AS feature, decrease FROM
        (SELECT g.lvl, g.forest, g.tree, g.id, g.node, g.key, NOT (x[i + 1] <= cut) AS r, CASE WHEN r THEN b.n - nl ELSE nl END AS n, CASE WHEN r THEN b.pos - pl ELSE pl END AS pos, i, gain - {purity('b.pos', 'b.n')} AS decrease
        FROM grow g JOIN fi USING (forest, id) JOIN ({best}) b ON b.forest = g.forest AND b.tree = g.tree AND b.node = g.node WHERE g.open)"""
    start = f"""SELECT 0 AS lvl, forest, CAST(tree AS INTEGER) AS tree, id, '' AS node, {scrambled_sql(f'((forest + 2) * 1000003 + tree * 7919 + {settings.seed} * 104729) % {p}')} AS key, n, pos,
        {still.format(n='n', pos='pos')} AS open, '' AS parent, CAST(NULL AS BIGINT) AS feature, CAST(NULL AS DOUBLE) AS decrease
        FROM fi JOIN (SELECT forest, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM fi WHERE train GROUP BY 1) USING (forest), range({settings.trees}) z(tree)"""
    return (
        ("nat", "SELECT vec_id AS grid_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(NATIVE)) + " FROM embeddings"),
        ("pmp", "SELECT grid_id, " + ", ".join(f"ln(1 + {n.removeprefix('log1p_')}) AS {n}" for n in NAMES[len(NATIVE) :]) + f" FROM ({PUMPING})"),
        ("blk", "SELECT grid_id, CAST(floor((x - min(x) OVER ()) / 5000.0) * 1000 + floor((y - min(y) OVER ()) / 5000.0) AS BIGINT) AS block FROM (SELECT vec_id AS grid_id, vec_id % 20 * 1000.0 AS x, vec_id // 20 * 1000.0 AS y FROM embeddings)"),
        ("fld", f"SELECT grid_id, CASE WHEN pos % {2 * FOLDS} < {FOLDS} THEN pos % {2 * FOLDS} ELSE {2 * FOLDS - 1} - pos % {2 * FOLDS} END AS fold FROM blk JOIN (SELECT block, row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS pos FROM blk GROUP BY block) USING (block)"),
        ("lab", f"SELECT e.vec_id AS id, fold, CAST(label <= 2 AS BIGINT) AS y, {', '.join(NAMES)} FROM embeddings e JOIN nat ON nat.grid_id = vec_id JOIN fld ON fld.grid_id = vec_id LEFT JOIN pmp ON pmp.grid_id = vec_id"),
        ("fst", f"SELECT forest, lab.* FROM lab, (VALUES {forests}) f(forest)"),
        ("med", f"SELECT forest, {', '.join(f'median({c}) AS m{i}' for i, c in enumerate(NAMES))} FROM fst WHERE fold <> forest GROUP BY 1"),
        ("fi", f"SELECT forest, id, fold, y, fold <> forest AS train, [{', '.join(f'coalesce({c}, m{i}, 0.0)::DOUBLE' for i, c in enumerate(NAMES))}] AS x FROM fst JOIN med USING (forest)"),
        ("grow", f"RECURSIVE ALL {start} UNION ALL {step}"),
    )


LAST = ("lst", "SELECT forest, tree, id, arg_max(pos / n, lvl) AS p FROM grow GROUP BY ALL")
FOREST_P = ("fp", "SELECT forest, id, avg(p) AS p FROM lst GROUP BY ALL")
ALL_FORESTS = ", ".join(f"({k})" for k in (*range(FOLDS), trees.FINAL))


@query(
    "l04_extra_trees",
    "grid_id:i fold:i y:f p_oof:f p_final:f",
    with_blocks(
        "forcing_sparse calendar",
        f"SELECT lab.id AS grid_id, fold, y, o.p AS p_oof, z.p AS p_final FROM lab JOIN fp o ON o.id = lab.id AND o.forest = fold JOIN fp z ON z.id = lab.id AND z.forest = {trees.FINAL}",
        *_growth_sql(TWIN, ALL_FORESTS), LAST, FOREST_P,
    ),
)
def l04_extra_trees(t: Tables) -> DataFrame:
    rows, features = forest_rows(t)
    return trees.block_validated_trees(cut_lineage(rows), features, "y", FOLDS, TWIN)


@query(
    "f04_extra_trees_importances",
    "feature:s importance:f",
    with_blocks(
        "forcing_sparse calendar",
        f"""SELECT [{', '.join(f"'{n}'" for n in NAMES)}][feature + 1] AS feature, sum(d / t) / (SELECT count(*) FROM tot) AS importance FROM
        (SELECT tree, feature, sum(decrease) AS d FROM cutted GROUP BY ALL) JOIN tot USING (tree) GROUP BY 1""",
        *_growth_sql(TWIN, f"({trees.FINAL})"),
        ("cutted", "SELECT DISTINCT tree, parent, feature, decrease FROM grow WHERE lvl > 0"),
        ("tot", "SELECT tree, sum(decrease) AS t FROM cutted GROUP BY 1 HAVING t > 0"),
    ),
)
def f04_extra_trees(t: Tables) -> DataFrame:
    rows, features = forest_rows(t)
    return trees.feature_importances(cut_lineage(rows), features, "y", TWIN)
