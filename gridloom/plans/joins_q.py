"""Queries for joins and graph operators (groups C, G and I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregates, graph, joins, samples, setops, windows
from gridloom.plans.registry import query
from gridloom.plans.sources import space_time_samples, st_sql
from gridloom.plans.sqlbase import with_blocks
from gridloom.plans.tables import N_MONTHS, SEEDS, Tables


@query(
    "c01_calendar_join",
    "grid_id:i month_label:s month_idx:i year:i wtd:f",
    with_blocks("obs calendar", "SELECT grid_id, month_label, month_idx, year, wtd FROM obs JOIN calendar USING (month_idx)"),
)
def c01(t: Tables) -> DataFrame:
    from gridloom.functions.calendar import label_of_ord
    from gridloom.plans.tables import FIRST_ORD

    facts = t.obs.select("grid_id", label_of_ord(F.col("month_idx") + FIRST_ORD).alias("month_label"), "wtd")
    return joins.with_calendar(facts, t.calendar)


@query(
    "c02_static_attributes",
    "grid_id:i elevation:f slope:f",
    with_blocks(
        "cells",
        """SELECT grid_id, coalesce(elevation, avg(elevation) OVER ()) AS elevation, coalesce(slope, avg(slope) OVER ()) AS slope FROM cells LEFT JOIN
        (SELECT c_custkey AS grid_id, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS elevation, c_acctbal * 0.003 + c_nationkey AS slope
         FROM customer WHERE c_mktsegment <> 'BUILDING') USING (grid_id)""",
    ),
)
def c02(t: Tables) -> DataFrame:
    attrs = t.raw("customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("node_id"),
        F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("elevation"),
        (F.col("c_acctbal") * F.lit(0.003) + F.col("c_nationkey")).alias("slope"),
    )
    return joins.with_static(t.cells, attrs, ["elevation", "slope"], id_name="node_id")


@query(
    "c03_baseline_coverage",
    "grid_id:i cell_id:i base_wtd:f fill_source:s",
    with_blocks("cells baseline", "SELECT c.grid_id, cell_id, base_wtd, fill_source FROM cells c JOIN baseline b USING (cell_id)"),
)
def c03(t: Tables) -> DataFrame:
    return joins.with_full_coverage(t.cells, t.baseline.drop("grid_id"), ["cell_id"], "base_wtd")


@query(
    "c04_membership_filter",
    "grid_id:i month_idx:i wtd:f",
    with_blocks(
        "obs baseline calendar",
        """SELECT grid_id, month_idx, wtd FROM obs WHERE grid_id IN (SELECT grid_id FROM baseline WHERE fill_source <> 'unknown')
        AND month_idx IN (SELECT month_idx FROM calendar WHERE year BETWEEN 1996 AND 2000)""",
    ),
)
def c04(t: Tables) -> DataFrame:
    return joins.in_domain(
        t.obs, (t.baseline.where("fill_source <> 'unknown'"), ["grid_id"]), (t.calendar.where("year BETWEEN 1996 AND 2000"), ["month_idx"])
    )


@query(
    "c05_horizon_self_join",
    "grid_id:i start_idx:i target_idx:i h:i wtd_t:f wtd_target:f delta_wtd:f delta_h:f",
    with_blocks("pairs", "SELECT grid_id, start_idx, target_idx, h, wtd_t, wtd_target, wtd_target - wtd_t AS delta_wtd, delta_h FROM pairs"),
)
def c05(t: Tables) -> DataFrame:
    return t.pairs


AHEAD = (
    "ahead",
    """SELECT f.grid_id, f.month_idx AS start_idx, h, sum(g.infiltration) AS sum_infiltration, sum(g.pumping) AS sum_pumping
    FROM forcing f, (VALUES (1), (3), (6)) hz(h), forcing g
    WHERE g.grid_id = f.grid_id AND g.month_idx > f.month_idx AND g.month_idx <= f.month_idx + h AND f.month_idx + h <= 83 GROUP BY ALL""",
)


@query(
    "c06_forward_range_sums",
    "grid_id:i start_idx:i h:i sum_infiltration:f sum_pumping:f log1p_sum_pumping:f",
    with_blocks(
        "pairs forcing",
        """SELECT p.grid_id, p.start_idx, p.h, sum_infiltration, sum_pumping, ln(1 + greatest(sum_pumping, 0)) AS log1p_sum_pumping
        FROM pairs p JOIN ahead USING (grid_id, start_idx, h)""",
        AHEAD,
    ),
)
def c06(t: Tables) -> DataFrame:
    from gridloom.functions.scalars import log1p_nonneg

    packed = t.pairs.join(t.forcing_months, "grid_id").where(joins.inside_months(N_MONTHS))
    sums = packed.withColumns({f"sum_{c}": joins.packed_sum(c, [1, 3, 6]) for c in ("infiltration", "pumping")}).drop("months")
    return sums.withColumn("log1p_sum_pumping", log1p_nonneg(F.col("sum_pumping")))


@query(
    "c07_forward_sequences",
    "grid_id:i start_idx:i h:i step:i infiltration:f pumping:f",
    with_blocks(
        "pairs forcing",
        """SELECT p.grid_id, p.start_idx, p.h, s AS step, CASE WHEN s < p.h THEN f.infiltration ELSE 0 END AS infiltration,
        CASE WHEN s < p.h THEN f.pumping ELSE 0 END AS pumping FROM pairs p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) r(s)
        LEFT JOIN forcing f ON f.grid_id = p.grid_id AND f.month_idx = p.start_idx + 1 + s""",
    ),
)
def c07(t: Tables) -> DataFrame:
    packed = t.pairs.select("grid_id", "start_idx", "h").join(t.forcing_months, "grid_id").where(joins.inside_months(N_MONTHS))
    return (
        packed.select("grid_id", "start_idx", "h", joins.packed_sequence(["infiltration", "pumping"], 6).alias("sequence"))
        .select("grid_id", "start_idx", "h", F.posexplode("sequence").alias("step", "_s"))
        .select("*", "_s.*")
    )


def adjacency_sql(cells: str, connectivity: int = 8) -> str:
    extra = "" if connectivity == 8 else " AND (a.grid_row = b.grid_row OR a.grid_col = b.grid_col)"
    return f"""SELECT a.grid_id AS src, b.grid_id AS dst, CASE WHEN a.grid_row = b.grid_row OR a.grid_col = b.grid_col THEN 1000.0::DOUBLE
    ELSE sqrt(2.0::DOUBLE) * 1000 END AS dist FROM {cells} a JOIN {cells} b ON b.grid_row BETWEEN a.grid_row - 1 AND a.grid_row + 1
    AND b.grid_col BETWEEN a.grid_col - 1 AND a.grid_col + 1 AND a.grid_id <> b.grid_id{extra}"""


@query(
    "c08_grid_adjacency",
    "connectivity:i src:i dst:i dist:f",
    with_blocks(
        "cells",
        f"SELECT 8 AS connectivity, * FROM ({adjacency_sql('cells')}) UNION ALL SELECT 4, * FROM ({adjacency_sql('cells', 4)})",
    ),
)
def c08(t: Tables) -> DataFrame:
    return (
        graph.grid_adjacency(t.cells, 8).withColumn("connectivity", F.lit(8))
        .unionByName(graph.grid_adjacency(t.cells, 4).withColumn("connectivity", F.lit(4)))
    )


KNN = (
    "knn",
    """SELECT src, dst, sqrt(d2) AS dist, rank FROM (SELECT a.grid_id AS src, b.grid_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
    row_number() OVER (PARTITION BY a.grid_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.grid_id) - 1 AS rank
    FROM CELLS a JOIN CELLS b ON a.grid_id <> b.grid_id) WHERE rank < K""",
)


def knn_cte(cells: str, k: int) -> tuple[str, str]:
    return KNN[0], KNN[1].replace("CELLS", cells).replace("rank < K", f"rank < {k}")


@query(
    "c09_knn_self_join",
    "src:i dst:i dist:f rank:i",
    with_blocks("cells", "SELECT * FROM knn", knn_cte("cells", 6)),
)
def c09(t: Tables) -> DataFrame:
    return graph.knn_edges(t.cells, 6)


# level_pos is a strictly positive scattered coordinate per user event table
@query(
    "c09_knn_scattered",
    "src:i dst:i dist:f rank:i",
    with_blocks(
        "",
        "SELECT * FROM knn",
        ("pts", "SELECT c_custkey AS grid_id, floor(c_acctbal) AS x, c_nationkey * 40.0::DOUBLE AS y FROM customer"),
        knn_cte("pts", 8),
    ),
)
def c09_scattered(t: Tables) -> DataFrame:
    pts = t.raw("customer").select(
        F.col("c_custkey").alias("grid_id"), F.floor("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * F.lit(40.0)).alias("y")
    )
    return graph.knn_edges(pts, 8)


@query(
    "c10_nearest_axis",
    "grid_id:i axis_idx:i axis_coord:f",
    with_blocks(
        "cells",
        """SELECT grid_id, axis_idx, axis_coord FROM (SELECT grid_id, axis_idx, axis_coord,
        row_number() OVER (PARTITION BY grid_id ORDER BY abs(axis_coord - x), axis_coord) AS r FROM cells JOIN axis ON TRUE) WHERE r = 1""",
        ("axis", "SELECT CAST(c_nationkey AS INTEGER) AS axis_idx, min(c_nationkey) * 900.0::DOUBLE + (c_nationkey % 3) * 300 + 1500 AS axis_coord FROM customer GROUP BY c_nationkey"),
    ),
)
def c10(t: Tables) -> DataFrame:
    n = F.col("c_nationkey")
    axis = t.raw("customer").select(n).distinct().select(
        n.alias("axis_idx"), (n * F.lit(900.0) + (n % 3) * 300 + 1500).alias("axis_coord")
    )
    return joins.nearest_on_axis(t.cells.select("grid_id", "x"), "x", axis, "axis_coord", "axis_idx")


ADJ = ("adj", adjacency_sql("cells"))


@query(
    "c11_khop_neighbourhood",
    "root:i node:i hop:i",
    with_blocks(
        "cells",
        """SELECT root, node, min(hop) AS hop FROM (SELECT grid_id AS root, grid_id AS node, 0 AS hop FROM cells UNION ALL SELECT src, dst, 1 FROM adj
        UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM adj a JOIN adj b ON a.dst = b.src) GROUP BY ALL""",
        ADJ,
    ),
)
def c11(t: Tables) -> DataFrame:
    return graph.khop(t.cells, graph.grid_adjacency(t.cells, 8), 2)


@query(
    "c11_induced_subgraph",
    "root:i n_nodes:i n_edges:i",
    with_blocks(
        "cells_small",
        """SELECT r.root, count(DISTINCT r.node) AS n_nodes, count(e.src) AS n_edges FROM reach r LEFT JOIN
        (SELECT a.root, src, dst FROM reach a JOIN adj ON adj.src = a.node JOIN reach b ON b.root = a.root AND b.node = adj.dst) e
        ON e.root = r.root AND e.src = r.node GROUP BY 1""",
        ("adj", adjacency_sql("cells_small")),
        (
            "reach",
            """SELECT DISTINCT root, node FROM (SELECT grid_id AS root, grid_id AS node FROM cells_small UNION ALL SELECT src, dst FROM adj
            UNION ALL SELECT a.src, b.dst FROM adj a JOIN adj b ON a.dst = b.src)""",
        ),
    ),
)
def c11_induced(t: Tables) -> DataFrame:
    edges = graph.grid_adjacency(t.cells_small, 8)
    reach = graph.khop(t.cells_small, edges, 2)
    counts = graph.induced_edges(reach, edges).groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = reach.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"))
    return nodes.join(counts, "root", "left").na.fill(0, ["n_edges"])


@query(
    "c12_alignment_check",
    "only_left:i only_right:i value_mismatches:i matched:i",
    with_blocks(
        "obs",
        """SELECT count(*) FILTER (r.grid_id IS NULL) AS only_left, count(*) FILTER (l.grid_id IS NULL) AS only_right,
        count(*) FILTER (l.grid_id IS NOT NULL AND r.grid_id IS NOT NULL AND abs(l.wtd - r.wtd) > 1e-8) AS value_mismatches,
        count(*) FILTER (l.grid_id IS NOT NULL AND r.grid_id IS NOT NULL) AS matched
        FROM (SELECT * FROM obs WHERE n_days > 1 OR wtd > 2) l FULL OUTER JOIN
        (SELECT grid_id, month_idx, CASE WHEN n_sites > 1 THEN wtd + 1e-6 ELSE wtd + 1e-10 END AS wtd FROM obs WHERE wtd < 4) r USING (grid_id, month_idx)""",
    ),
)
def c12(t: Tables) -> DataFrame:
    left = t.obs.where("n_days > 1 OR wtd > 2")
    right = t.obs.where("wtd < 4").withColumn("wtd", F.col("wtd") + F.when(F.col("n_sites") > 1, F.lit(1e-6)).otherwise(F.lit(1e-10)))
    return joins.alignment_report(left, right, ["grid_id", "month_idx"], ["wtd"])


@query(
    "c13_densify",
    "grid_id:i month_idx:i wtd:f present:b",
    with_blocks(
        "cells calendar obs",
        """SELECT c.grid_id, m.month_idx, o.wtd, o.wtd IS NOT NULL AS present FROM cells c CROSS JOIN calendar m
        LEFT JOIN obs o ON o.grid_id = c.grid_id AND o.month_idx = m.month_idx""",
    ),
)
def c13(t: Tables) -> DataFrame:
    return joins.densify(t.cells.select("grid_id"), t.obs, N_MONTHS).withColumn("present", F.col("wtd").isNotNull())


@query(
    "c14_ensemble_alignment",
    "sample_key:i h:i split:s ens_mean:f n_members:i",
    with_blocks(
        "predictions",
        """SELECT sample_key, h, split, avg(y_pred) AS ens_mean, count(*) AS n_members FROM predictions
        WHERE NOT (seed = 33 AND n_sites_t = 2) GROUP BY ALL HAVING count(DISTINCT seed) = 5""",
    ),
)
def c14(t: Tables) -> DataFrame:
    incomplete = t.predictions.where(~((F.col("seed") == 33) & (F.col("n_sites_t") == 2)))
    return aggregates.ensemble_summary(incomplete, ["sample_key", "h", "split"], len(SEEDS))


COARSE = (
    "coarse",
    """SELECT grid_row // 4 AS lat_idx, grid_col // 4 AS lon_idx, month_idx, CASE WHEN month_idx % 6 <> 0 OR grid_col // 4 > 1 THEN avg(wtd) END AS lwe
    FROM obs JOIN cells USING (grid_id) GROUP BY month_idx, grid_row // 4, grid_col // 4""",
)
CROSSWALK = (
    "xwalk",
    "SELECT grid_row // 4 AS lat_idx, grid_col // 4 AS lon_idx, sum(n_points) + 0.5 AS weight FROM cells JOIN baseline USING (grid_id) GROUP BY ALL",
)


def coarse_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    pos = t.cells.select("grid_id", F.floor(F.col("grid_row") / 4).alias("lat_idx"), F.floor(F.col("grid_col") / 4).alias("lon_idx"))
    values = t.obs.join(pos, "grid_id").groupBy("lat_idx", "lon_idx", "month_idx").agg(F.avg("wtd").alias("_v")).withColumn(
        "lwe", F.when((F.col("month_idx") % 6 != 0) | (F.col("lon_idx") > 1), F.col("_v"))
    )
    weights = t.baseline.join(pos, "grid_id").groupBy("lat_idx", "lon_idx").agg((F.sum("n_points") + F.lit(0.5)).alias("weight"))
    return values, weights


@query(
    "c15_crosswalk_join",
    "month_idx:i lwe:f",
    with_blocks(
        "obs cells baseline",
        """SELECT month_idx, sum(weight * lwe) / nullif(sum(CASE WHEN lwe IS NOT NULL THEN weight END), 0) AS lwe
        FROM coarse JOIN xwalk USING (lat_idx, lon_idx) GROUP BY 1""",
        COARSE,
        CROSSWALK,
    ),
)
def c15(t: Tables) -> DataFrame:
    values, weights = coarse_tables(t)
    return joins.crosswalk_mean(values, weights, ["lat_idx", "lon_idx"], ["month_idx"], "lwe", "weight")


@query(
    "c16_spread_regional",
    "grid_id:i month_idx:i contribution:f",
    with_blocks(
        "baseline panel",
        """SELECT b.grid_id, month_idx, (0.65 + 0.35 * (1 - n_points / 25.0)) * r AS contribution FROM baseline b,
        (SELECT month_idx, avg(wtd) AS r FROM panel GROUP BY 1)""",
    ),
)
def c16(t: Tables) -> DataFrame:
    cells = t.baseline.select("grid_id", (F.lit(0.65) + F.lit(0.35) * (1 - F.col("n_points") / F.lit(25.0))).alias("sensitivity"))
    series = t.panel.groupBy("month_idx").agg(F.avg("wtd").alias("r"))
    return joins.spread_regional(cells, "sensitivity", series, "r")


@query(
    "c17_driver_table",
    "month_idx:i month_label:s storage:f infiltration:f pumping:f precip:f",
    with_blocks(
        "calendar panel forcing obs",
        """SELECT c.month_idx, month_label, storage, infiltration, pumping, precip FROM calendar c
        LEFT JOIN (SELECT month_idx, avg(wtd) AS storage FROM panel GROUP BY 1) USING (month_idx)
        LEFT JOIN (SELECT month_idx, avg(infiltration) AS infiltration, sum(pumping) AS pumping FROM forcing GROUP BY 1) USING (month_idx)
        LEFT JOIN (SELECT month_idx, avg(wtd) AS precip FROM obs GROUP BY 1) USING (month_idx)""",
    ),
)
def c17(t: Tables) -> DataFrame:
    by = "month_idx"
    return joins.join_series(
        t.calendar, by,
        t.panel.groupBy(by).agg(F.avg("wtd").alias("storage")),
        t.forcing.groupBy(by).agg(F.avg("infiltration").alias("infiltration"), F.sum("pumping").alias("pumping")),
        t.obs.groupBy(by).agg(F.avg("wtd").alias("precip")),
    )


@query(
    "c19_bracket_asof",
    "grid_id:i month_idx:i prev_t:i prev_wtd:f next_t:i next_wtd:f",
    with_blocks(
        "obs cells calendar",
        """SELECT q.grid_id, q.month_idx, p.month_idx AS prev_t, p.wtd AS prev_wtd, n.month_idx AS next_t, n.wtd AS next_wtd
        FROM (SELECT grid_id, month_idx FROM cells, calendar WHERE month = 1 OR month_idx = 83) q
        ASOF LEFT JOIN obs p ON p.grid_id = q.grid_id AND p.month_idx <= q.month_idx
        ASOF LEFT JOIN obs n ON n.grid_id = q.grid_id AND n.month_idx >= q.month_idx""",
    ),
)
def c19(t: Tables) -> DataFrame:
    from gridloom.operators.anchors import anchor_grid, anchor_months

    q = anchor_grid(t.cells, anchor_months(t.calendar))
    b = joins.bracket_asof(q, t.obs, "grid_id", "month_idx", ["wtd"])
    return b.select(
        "grid_id", "month_idx", F.col("prev.t").alias("prev_t"), F.col("prev.wtd").alias("prev_wtd"),
        F.col("next.t").alias("next_t"), F.col("next.wtd").alias("next_wtd"),
    )


@query(
    "c20_observation_mask",
    "grid_id:i month_idx:i observed:b",
    with_blocks(
        "dense_panel",
        "SELECT grid_id, month_idx, wtd IS NOT NULL AS observed FROM dense_panel",
    ),
)
def c20(t: Tables) -> DataFrame:
    return joins.densify(t.cells_small.select("grid_id"), t.panel, N_MONTHS).select(
        "grid_id", "month_idx", F.col("wtd").isNotNull().alias("observed")
    )


# --- G: set operations ----------------------------------------------------------

@query(
    "g01_combined_test",
    "split:s n:i delta_sum:f4",
    st_sql(
        """SELECT split, count(*) AS n, sum(delta_h) AS delta_sum FROM (SELECT split, delta_h FROM sst WHERE split IS NOT NULL UNION ALL
        SELECT 'test', delta_h FROM sst WHERE split IN ('test_temporal', 'test_spatial')) GROUP BY split"""
    ),
)
def g01(t: Tables) -> DataFrame:
    both = samples.combined_test(space_time_samples(t).where("split IS NOT NULL"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_h").alias("delta_sum"))


@query(
    "g02_undirected_edges",
    "src:i dst:i dist:f",
    with_blocks(
        "cells",
        "SELECT src, dst, avg(dist) AS dist FROM (SELECT src, dst, dist + rank AS dist FROM knn UNION ALL SELECT dst, src, dist + rank FROM knn) GROUP BY ALL",
        knn_cte("cells", 6),
    ),
)
def g02(t: Tables) -> DataFrame:
    e = graph.knn_edges(t.cells, 6).withColumn("dist", F.col("dist") + F.col("rank"))
    return graph.undirected(e, ["dist"])


#: steps of 6 first, then of 3, then of 1
PLAN_SQL = """(SELECT gap, list_concat(list_concat(list_transform(range(gap // 6), lambda i: 6), list_transform(range((gap % 6) // 3), lambda i: 3)), list_transform(range(gap % 3), lambda i: 1)) AS path
    FROM range(1, 84) r(gap)) gp"""
STEPS = (
    "steps",
    f"""SELECT l.left_idx, l.left_idx + gap AS target_idx, u.pos AS pos, len(path) AS n_steps, l.left_idx + coalesce(list_sum(path[1:u.pos - 1]), 0) AS start_idx, path[u.pos] AS h
    FROM leaf l JOIN {PLAN_SQL} ON gap <= l.right_idx - l.left_idx, unnest(range(1, len(path) + 1)) u(pos)""",
)
LEAF = (
    "leaf",
    """SELECT month_idx AS left_idx, lead(month_idx) OVER (ORDER BY month_idx) AS right_idx FROM
    (SELECT month_idx FROM calendar WHERE month = 1 OR month_idx = 83) QUALIFY right_idx IS NOT NULL""",
)


#: Januaries between the first and the last observed month, and the last one
LEAF_SEEN = (
    "leaf",
    """SELECT month_idx AS left_idx, lead(month_idx) OVER (ORDER BY month_idx) AS right_idx FROM
    (SELECT month_idx FROM calendar WHERE month_idx BETWEEN (SELECT min(month_idx) FROM obs) AND (SELECT max(month_idx) FROM obs)
     AND (month = 1 OR month_idx = (SELECT max(month_idx) FROM obs))) QUALIFY right_idx IS NOT NULL""",
)
LEAF_SEEN_24 = (LEAF_SEEN[0], LEAF_SEEN[1].replace("month = 1", "month_idx % 24 = 0"))


def seen_steps(t: Tables, every: int | None) -> DataFrame:
    """Steps of the plans between the anchors of the observed span."""
    from gridloom.operators.anchors import anchor_months
    from gridloom.operators.uncertainty import greedy_paths, leaf_segments, plan_steps, required_steps

    span = t.obs.agg(F.struct(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))).scalar()
    months = t.calendar.withColumn("_e", span).where((F.col("month_idx") >= F.col("_e.a")) & (F.col("month_idx") <= F.col("_e.b"))).drop("_e")
    leaves = leaf_segments(anchor_months(months, every=every))
    largest = leaves.agg(F.max(F.col("right_idx") - F.col("left_idx"))).first()[0]
    return required_steps(plan_steps(leaves, greedy_paths(largest)))


@query("g03_required_steps", "start_idx:i h:i", with_blocks("calendar obs", "SELECT DISTINCT start_idx, h FROM steps", LEAF_SEEN, STEPS))
def g03(t: Tables) -> DataFrame:
    return seen_steps(t, None)


@query("g03_required_steps_long_gaps", "start_idx:i h:i", with_blocks("calendar obs", "SELECT DISTINCT start_idx, h FROM steps", LEAF_SEEN_24, STEPS))
def g03_long(t: Tables) -> DataFrame:
    return seen_steps(t, 24)


@query(
    "g04_missing_steps",
    "start_idx:i h:i",
    with_blocks(
        "pairs calendar obs",
        "SELECT DISTINCT start_idx, h FROM steps WHERE (start_idx, h) NOT IN (SELECT (start_idx, h) FROM pairs WHERE n_days_t >= 3)",
        LEAF_SEEN,
        STEPS,
    ),
)
def g04(t: Tables) -> DataFrame:
    have = t.pairs.where("n_days_t >= 3").select("start_idx", "h").distinct()
    return setops.missing_keys(g03(t), have, ["start_idx", "h"])


@query(
    "g05_concatenate_blocks",
    "source:s n:i month_min:i month_max:i",
    with_blocks(
        "obs panel",
        """SELECT 'obs' AS source, count(*) AS n, min(month_idx) AS month_min, max(month_idx) AS month_max FROM obs
        UNION ALL SELECT 'panel', count(*), min(month_idx), max(month_idx) FROM panel""",
    ),
)
def g05(t: Tables) -> DataFrame:
    both = setops.concatenate({"obs": t.obs.select("grid_id", "month_idx", "wtd"), "panel": t.panel})
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("month_idx").alias("month_min"), F.max("month_idx").alias("month_max")
    )


# --- I: graph -------------------------------------------------------------------

DIST_W = (
    "gw",
    """SELECT src, dst, dist, greatest(w / max(w) OVER (), 1e-6) AS weight FROM (SELECT src, dst, avg(dist) AS dist, avg(exp(-dist / 2500.0)) AS w
    FROM (SELECT src, dst, dist FROM knn UNION ALL SELECT dst, src, dist FROM knn) GROUP BY ALL)""",
)


def dist_graph(t: Tables) -> DataFrame:
    return graph.distance_graph(graph.knn_edges(t.cells, 6), 2500.0)


@query(
    "i01_distance_graph",
    "src:i dst:i dist:f weight:f",
    with_blocks("cells", "SELECT * FROM gw", knn_cte("cells", 6), DIST_W),
)
def i01(t: Tables) -> DataFrame:
    return dist_graph(t)


PROFILE_BLOCKS = (
    ("pcells", "SELECT vec_id AS grid_id, (vec_id % 20) * 1000.0::DOUBLE AS x, (vec_id // 20) * 1000.0::DOUBLE AS y FROM embeddings"),
    knn_cte("pcells", 8),
    (
        "pd",
        """SELECT src, dst, dist, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) / 64 AS rdist
        FROM knn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst""",
    ),
)


def profile_cells(t: Tables) -> DataFrame:
    g = F.col("grid_id")
    return t.profiles.select(g, (F.pmod(g, F.lit(20)) * F.lit(1000.0)).alias("x"), (F.floor(g / 20) * F.lit(1000.0)).alias("y"))


@query("h09_profile_distance", "src:i dst:i dist:f rdist:f", with_blocks("", "SELECT * FROM pd", *PROFILE_BLOCKS))
def h09(t: Tables) -> DataFrame:
    return graph.profile_distance(graph.knn_edges(profile_cells(t), 8), t.profiles)


@query(
    "i02_profile_graph",
    "src:i dst:i dist:f rdist:f weight:f",
    with_blocks(
        "",
        """SELECT src, dst, dist, rdist, greatest(w / max(w) OVER (), 1e-6) AS weight FROM (SELECT src, dst, avg(dist) AS dist, avg(rdist) AS rdist,
        avg(exp(-dist / 5000.0) * exp(-rdist / 0.25)) AS w FROM (SELECT src, dst, dist, rdist FROM pd UNION ALL SELECT dst, src, dist, rdist FROM pd) GROUP BY ALL)""",
        *PROFILE_BLOCKS,
    ),
)
def i02(t: Tables) -> DataFrame:
    return graph.profile_graph(graph.knn_edges(profile_cells(t), 8), t.profiles, 5000.0, 0.25)


SYM = ("sym", "SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight / 2 AS weight FROM gw UNION ALL SELECT dst, src, weight / 2 FROM gw) GROUP BY ALL")


@query(
    "i03_laplacian",
    "src:i dst:i value:f",
    with_blocks(
        "cells",
        "SELECT src, src AS dst, sum(weight) AS value FROM sym GROUP BY 1 UNION ALL SELECT src, dst, -weight FROM sym",
        knn_cte("cells", 6), DIST_W, SYM,
    ),
)
def i03(t: Tables) -> DataFrame:
    return graph.laplacian_entries(dist_graph(t))


@query(
    "i03_laplacian_matvec",
    "grid_id:i lx:f",
    with_blocks(
        "cells baseline",
        """SELECT src AS grid_id, sum(weight * (a.base_wtd - b.base_wtd)) AS lx FROM sym JOIN baseline a ON a.grid_id = src JOIN baseline b ON b.grid_id = dst GROUP BY 1""",
        knn_cte("cells", 6), DIST_W, SYM,
    ),
)
def i03_matvec(t: Tables) -> DataFrame:
    return graph.matvec(graph.laplacian_entries(dist_graph(t)), t.baseline, "base_wtd", "lx")


def smooth_sql(x: str, nxt: str) -> tuple[str, str]:
    return nxt, f"SELECT src AS grid_id, sum(w * a) AS a, sum(w * b) AS b FROM nrm JOIN {x} ON {x}.grid_id = dst GROUP BY 1"


@query(
    "i07_feature_smoothing",
    "grid_id:i a:f b:f",
    with_blocks(
        "cells baseline",
        "SELECT * FROM x2",
        knn_cte("cells", 6), DIST_W,
        ("fl", "SELECT src, dst, weight FROM gw UNION ALL SELECT grid_id, grid_id, 1.0 FROM cells"),
        ("dg", "SELECT src, 1 / sqrt(sum(weight)) AS i FROM fl GROUP BY 1"),
        ("nrm", "SELECT fl.src, fl.dst, weight * p.i * q.i AS w FROM fl JOIN dg p ON p.src = fl.src JOIN dg q ON q.src = fl.dst"),
        ("x0", "SELECT grid_id, base_wtd AS a, n_points AS b FROM baseline"),
        smooth_sql("x0", "x1"),
        smooth_sql("x1", "x2"),
    ),
)
def i07(t: Tables) -> DataFrame:
    feats = t.baseline.select("grid_id", F.col("base_wtd").alias("a"), F.col("n_points").alias("b"))
    return graph.smooth_features(dist_graph(t), feats, ["a", "b"], rounds=2)
