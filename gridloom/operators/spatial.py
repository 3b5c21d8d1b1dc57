"""A tree of boxes over scattered places, and exact neighbour search on it.

A box that holds too many places is cut at quantiles of its own places, along
its wider side, until every box fits.  Dense regions get many small boxes and
empty ones few, whatever the extent of the whole, so a far outlier changes
neither their number nor their size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

PARTS = 64  # most boxes that one cut makes
INF = float("inf")


@dataclass
class Tree:
    """``leaves``: path, chain of ancestors, own region, places; ``kids``: inner box -> its boxes."""

    leaves: DataFrame
    kids: DataFrame
    depth: int


def _cuts(leaf_places: int) -> Column:
    """Ascending cut values of an over-full box, never its largest value, at least one.

    A box of few leaves is cut into them at once, a larger one into strips.
    """
    wanted = F.ceil(F.col("n") / F.lit(max(leaf_places // 2, 1)))
    fan = F.greatest(F.lit(2), F.least(F.lit(PARTS), F.when(wanted <= PARTS // 2, wanted).otherwise(F.ceil(F.sqrt(wanted)))))
    picked = F.transform(
        F.sequence(F.lit(1), fan.cast("int") - 1),
        lambda j: F.element_at(F.when(F.col("along_x"), F.col("qx")).otherwise(F.col("qy")), F.round(j * F.lit(PARTS) / fan).cast("int")),
    )
    low = F.when(F.col("along_x"), F.col("bx0")).otherwise(F.col("by0"))
    high = F.when(F.col("along_x"), F.col("bx1")).otherwise(F.col("by1"))
    below = F.array_sort(F.array_distinct(F.filter(picked, lambda c: c < high)))
    middle = low + (high - low) / 2
    return F.when(F.size(below) > 0, below).otherwise(F.array(F.when(middle < high, middle).otherwise(low)))


def _digit(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def box_tree(places: DataFrame, leaf_places: int = 64) -> Tree:
    """Boxes of at most ``leaf_places`` rows of (x, y, ids); positions must be distinct.

    A round counts the open boxes (map-side combined) and cuts those that are
    over-full; the places of finished boxes leave the loop.  Cut boxes are
    half-open and tile the plane (``r*``); ``b*`` bounds the places inside.
    """
    spark = places.sparkSession
    fractions = [i / PARTS for i in range(1, PARTS)]
    none = "array<struct<path:string,rx0:double,rx1:double,ry0:double,ry1:double,bx0:double,bx1:double,by0:double,by1:double,m:bigint>>"
    open_boxes = spark.range(1).select(
        F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(-INF).alias("rx0"), F.lit(INF).alias("rx1"),
        F.lit(-INF).alias("ry0"), F.lit(INF).alias("ry1"), F.array().cast(none).alias("chain"),
    )
    active = places.select("x", "y", "ids", F.lit("").alias("path"))
    nodes, done, depth = [], [], 0
    while True:
        counts = active.groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m"),
            F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"),
            F.percentile_approx("x", fractions, 1000).alias("qx"), F.percentile_approx("y", fractions, 1000).alias("qy"),
        )
        level = cut_lineage(
            open_boxes.join(counts, "path")
            .withColumn("along_x", F.col("bx1") - F.col("bx0") >= F.col("by1") - F.col("by0"))
            .withColumn("cuts", F.when(F.col("n") > leaf_places, _cuts(leaf_places)))
            .drop("qx", "qy")
        )
        nodes.append(level)
        over = level.where(F.col("cuts").isNotNull())
        if over.isEmpty():
            done.append(active)
            break
        depth += 1
        cut = over.select("path", "along_x", "cuts")
        stepped = cut_lineage(
            active.join(cut, "path", "left").select(
                "x", "y", "ids", F.col("cuts").isNotNull().alias("cut"),
                F.when(
                    F.col("cuts").isNotNull(),
                    F.concat("path", F.lit("/"), _digit(F.col("cuts"), F.when(F.col("along_x"), F.col("x")).otherwise(F.col("y"))).cast("string")),
                ).otherwise(F.col("path")).alias("path"),
            )
        )
        done.append(stepped.where(~F.col("cut")).drop("cut"))
        active = stepped.where("cut").drop("cut")
        edges = F.concat(F.array(F.lit(-INF)), "cuts", F.array(F.lit(INF)))
        own = F.struct("path", "rx0", "rx1", "ry0", "ry1", "bx0", "bx1", "by0", "by1", "m")
        lo, hi = F.element_at("edges", F.col("pos") + 1), F.element_at("edges", F.col("pos") + 2)
        open_boxes = (
            over.withColumn("chain", F.concat("chain", F.array(own)))
            .withColumn("edges", edges)
            .select("*", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("pos"))
            .select(
                F.concat("path", F.lit("/"), F.col("pos").cast("string")).alias("path"),
                F.col("path").alias("parent"),
                F.when(F.col("along_x"), F.greatest("rx0", lo)).otherwise(F.col("rx0")).alias("rx0"),
                F.when(F.col("along_x"), F.least("rx1", hi)).otherwise(F.col("rx1")).alias("rx1"),
                F.when(F.col("along_x"), F.col("ry0")).otherwise(F.greatest("ry0", lo)).alias("ry0"),
                F.when(F.col("along_x"), F.col("ry1")).otherwise(F.least("ry1", hi)).alias("ry1"),
                "chain",
            )
        )
    boxes = reduce(DataFrame.unionByName, nodes)
    held = reduce(DataFrame.unionByName, done).groupBy("path").agg(F.collect_list(F.struct("x", "y", "ids")).alias("places"))
    leaves = boxes.where(F.col("cuts").isNull()).select("path", "chain", "rx0", "rx1", "ry0", "ry1").join(held, "path")
    kids = (
        boxes.where(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("node"))
        .agg(F.collect_list(F.struct("path", "bx0", "bx1", "by0", "by1", "m")).alias("boxes"))
    )
    return Tree(leaves, kids, depth)


def _square(v: Column) -> Column:
    return v * v


def _nearest(box: Column) -> Column:
    """Squared distance to a box.  Rounding is monotone: no place inside computes to less."""
    gap = lambda q, a, b: F.greatest(box[a] - F.col(q), F.col(q) - box[b], F.lit(0.0))
    return _square(gap("qx", "bx0", "bx1")) + _square(gap("qy", "by0", "by1"))


def _farthest(box: Column) -> Column:
    """Squared distance to a box's farthest corner: no place inside computes to more."""
    gap = lambda q, a, b: F.greatest(F.col(q) - box[a], box[b] - F.col(q))
    return _square(gap("qx", "bx0", "bx1")) + _square(gap("qy", "by0", "by1"))


def _way_out(region: Column) -> Column:
    """Squared distance to the nearest side of a region around the query."""
    sides = (F.col("qx") - region["rx0"], region["rx1"] - F.col("qx"), F.col("qy") - region["ry0"], region["ry1"] - F.col("qy"))
    return F.least(*[_square(s) for s in sides])


def _closest_ids(count: int) -> Column:
    """The ``count`` smallest (d2, id) of the places of one leaf, none farther than r2."""
    per_place = F.transform(
        "places",
        lambda p: F.transform(p["ids"], lambda i: F.struct((_square(p["x"] - F.col("qx")) + _square(p["y"] - F.col("qy"))).alias("d2"), i.alias("dst"))),
    )
    return F.slice(F.sort_array(F.filter(F.flatten(per_place), lambda s: s["d2"] <= F.col("r2"))), 1, count)


def nearest_lists(places: DataFrame, count: int, leaf_places: int = 64) -> DataFrame:
    """(qx, qy, near): the ``count`` nearest ids of every place, itself included.

    A place reads its own leaf first, which certifies a radius.  Only if that
    circle leaves the leaf's region does the place go on: to the smallest box
    around its circle, and from there down, in rounds, to boxes that the circle
    touches.  A place whose leaf holds too few ids takes its radius from the
    farthest corner of a box with enough, which shrinks at every step down, so
    a lone place reads the near edge of a cluster only.
    """
    tree = box_tree(places, leaf_places)
    own = tree.leaves.select(
        "path", "chain", F.struct("rx0", "rx1", "ry0", "ry1").alias("region"), "places", F.explode("places").alias("q")
    ).select("path", "chain", "region", "places", F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), F.lit(INF).alias("r2"))
    own = own.withColumn("near", _closest_ids(count)).drop("places", "r2")
    full = F.filter("chain", lambda b: b["m"] >= count)
    radius = (
        F.when(F.size("near") >= count, F.element_at("near", -1)["d2"])
        .when(F.size(full) > 0, _farthest(F.element_at(full, -1)))
        .otherwise(F.lit(INF))
    )
    own = cut_lineage(own.withColumn("r2", radius))
    around = F.filter("chain", lambda b: _way_out(b) > F.col("r2"))
    front = own.where((F.size("chain") > 0) & (_way_out(F.col("region")) <= F.col("r2"))).select(
        "qx", "qy", "r2", F.col("path").alias("home"),
        F.when(F.size(around) > 0, F.element_at(around, -1)["path"]).otherwise(F.lit("")).alias("node"),
    )
    for step in range(tree.depth):
        tighter = F.array_min(F.transform(F.filter("boxes", lambda b: b["m"] >= count), _farthest))
        front = (
            front.join(tree.kids, "node", "left")
            .withColumn("r2", F.least("r2", tighter))  # least() passes over null
            .withColumn("next", F.transform(F.filter("boxes", lambda b: (_nearest(b) <= F.col("r2")) & (b["path"] != F.col("home"))), lambda b: b["path"]))
            .select("qx", "qy", "r2", "home", F.explode(F.when(F.col("boxes").isNull(), F.array("node")).otherwise(F.col("next"))).alias("node"))
        )
        if step % 4 == 3:
            front = cut_lineage(front)
    beyond = (
        front.join(tree.leaves.select(F.col("path").alias("node"), "places"), "node")
        .select("qx", "qy", F.inline(_closest_ids(count)))
    )
    best = Window.partitionBy("qx", "qy").orderBy("d2", "dst")
    return (
        own.select("qx", "qy", F.inline("near"))
        .unionByName(beyond)
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= count)
        .groupBy("qx", "qy")
        .agg(F.sort_array(F.collect_list(F.struct("d2", "dst"))).alias("near"))
    )
