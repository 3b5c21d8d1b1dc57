"""Neighbour graphs: adjacency, exact kNN, k-hop sets, weights, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import spatial
from gridloom.session import cut_lineage

# The four straight and the four diagonal offsets of a grid.
STRAIGHT = ((-1, 0), (1, 0), (0, -1), (0, 1))
DIAGONAL = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def _offsets(pairs) -> "F.Column":
    return F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a, b in pairs])


def grid_adjacency(cells: DataFrame, connectivity: int = 8, spacing: float = 1000.0) -> DataFrame:
    """Directed edges between touching cells, by an equi join on shifted positions."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    around = STRAIGHT + (DIAGONAL if connectivity == 8 else ())
    probe = cells.select(F.col("grid_id").alias("src"), "grid_row", "grid_col", F.inline(_offsets(around))).select(
        "src",
        (F.col("grid_row") + F.col("da")).alias("grid_row"),
        (F.col("grid_col") + F.col("db")).alias("grid_col"),
        F.when((F.col("da") == 0) | (F.col("db") == 0), F.lit(spacing)).otherwise(F.lit(math.sqrt(2.0) * spacing)).alias("dist"),
    )
    target = cells.select(F.col("grid_id").alias("dst"), "grid_row", "grid_col")
    return probe.join(target, ["grid_row", "grid_col"]).select("src", "dst", "dist")


def knn_edges(points: DataFrame, k: int, leaf_places: int = 64) -> DataFrame:
    """Exact k nearest neighbours in the plane, ties by smaller id.

    Points sharing a position are folded into one place that keeps its k+1
    smallest ids, so heaps of copies cost one place.  Places are searched
    through a tree of boxes of at most ``leaf_places`` (see ``spatial.py``).
    Points without a position (null or NaN) have no neighbours and are none.
    """
    located = points.select("grid_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )
    per_place = Window.partitionBy("x", "y").orderBy("grid_id")
    places = (
        located.withColumn("_r", F.row_number().over(per_place))
        .where(F.col("_r") <= k + 1)
        .groupBy("x", "y")
        .agg(F.sort_array(F.collect_list("grid_id")).alias("ids"))
    )
    lists = spatial.nearest_lists(cut_lineage(places), k + 1, leaf_places)
    mine = F.slice(F.filter("near", lambda s: s["dst"] != F.col("grid_id")), 1, k)
    return (
        located.withColumnsRenamed({"x": "qx", "y": "qy"})
        .join(lists, ["qx", "qy"])
        .select(F.col("grid_id").alias("src"), F.posexplode(mine).alias("rank", "_s"))
        .select("src", F.col("_s.dst").alias("dst"), F.sqrt("_s.d2").alias("dist"), F.col("rank"))
    )


def khop(roots: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop): nodes within ``hops`` steps, with the smallest hop.

    The loop is bounded by ``hops``; each round joins only the newest frontier.
    """
    reached = roots.select(F.col("grid_id").alias("root"), F.col("grid_id").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    for h in range(1, hops + 1):
        frontier = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct().withColumn("hop", F.lit(h))
        reached = reached.unionByName(frontier)
    return reached.groupBy("root", "node").agg(F.min("hop").alias("hop"))


def induced_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends lie in the same root's neighbourhood."""
    nodes = reached.select("root", "node")
    return (
        nodes.withColumnRenamed("node", "src")
        .join(edges, "src")
        .join(nodes.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi")
    )


def undirected(edges: DataFrame, values: Sequence[str]) -> DataFrame:
    """E and its reverse, duplicates merged by the mean of each value.

    Both directions come from one scan of the edge list.
    """
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return edges.select(F.inline(ends), *values).groupBy("src", "dst").agg(*[F.avg(v).alias(v) for v in values])


def normalise_weights(edges: DataFrame, weight: str = "weight", floor: float = 1e-6) -> DataFrame:
    top = edges.agg(F.max(weight)).scalar()
    w = F.when(top <= 0, F.lit(1.0)).otherwise(F.greatest(F.col(weight) / top, F.lit(floor)))
    return edges.withColumn(weight, w)


def distance_graph(edges: DataFrame, length_scale: float) -> DataFrame:
    w = F.exp(-F.col("dist") / F.lit(length_scale))
    return normalise_weights(undirected(edges.select("src", "dst", "dist", w.alias("weight")), ["dist", "weight"]))


def profile_distance(edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean absolute difference of the two end profiles of each edge."""
    a = profiles.select(F.col("grid_id").alias("src"), F.col("values").alias("_a"))
    b = profiles.select(F.col("grid_id").alias("dst"), F.col("values").alias("_b"))
    total = F.aggregate(F.zip_with("_a", "_b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)
    return edges.join(a, "src").join(b, "dst").withColumn("rdist", total / F.size("_a")).drop("_a", "_b")


def profile_graph(edges: DataFrame, profiles: DataFrame, length_scale: float, rho_scale: float) -> DataFrame:
    d = profile_distance(edges, profiles)
    w = F.exp(-F.col("dist") / F.lit(length_scale)) * F.exp(-F.col("rdist") / F.lit(rho_scale))
    return normalise_weights(undirected(d.select("src", "dst", "dist", "rdist", w.alias("weight")), ["dist", "rdist", "weight"]))


def symmetric(edges: DataFrame) -> DataFrame:
    """A = (A + A^T) / 2 as an edge list with both directions."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return edges.select(F.inline(ends), (F.col("weight") / 2).alias("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def laplacian_entries(edges: DataFrame) -> DataFrame:
    """L = D - A as (src, dst, value); one aggregation holds degree and entries."""
    sym = symmetric(edges)
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("value")),
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), (-F.col("weight")).alias("value")),
    )
    return sym.select(F.inline(both)).groupBy("src", "dst").agg(F.sum("value").alias("value"))


def matvec(entries: DataFrame, x: DataFrame, value: str, out: str) -> DataFrame:
    """Row sums of matrix entries times a vector keyed by grid_id."""
    return (
        entries.join(x.select(F.col("grid_id").alias("dst"), value), "dst")
        .groupBy(F.col("src").alias("grid_id"))
        .agg(F.sum(F.col("value") * F.col(value)).alias(out))
    )


def smooth_features(edges: DataFrame, features: DataFrame, columns: Sequence[str], rounds: int = 1) -> DataFrame:
    """x' = D^-1/2 (A + I) D^-1/2 x, repeated ``rounds`` times.

    Weights are normalised once; each round is one join and one partial-summed
    aggregation over all feature columns together.
    """
    nodes = features.select("grid_id")
    loops = nodes.select(F.col("grid_id").alias("src"), F.col("grid_id").alias("dst"), F.lit(1.0).alias("weight"))
    full = edges.select("src", "dst", "weight").unionByName(loops)
    degree = full.groupBy("src").agg(F.sum("weight").alias("_d"))
    inv = degree.select(F.col("src").alias("_n"), F.when(F.col("_d") > 0, 1 / F.sqrt("_d")).otherwise(F.lit(0.0)).alias("_i"))
    norm = (
        full.join(inv.select(F.col("_n").alias("src"), F.col("_i").alias("_is")), "src")
        .join(inv.select(F.col("_n").alias("dst"), F.col("_i").alias("_id")), "dst")
        .select("src", "dst", (F.col("weight") * F.col("_is") * F.col("_id")).alias("_w"))
    )
    x = features.select("grid_id", *columns)
    for _ in range(rounds):
        x = (
            norm.join(x.withColumnRenamed("grid_id", "dst"), "dst")
            .groupBy(F.col("src").alias("grid_id"))
            .agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in columns])
        )
    return x
