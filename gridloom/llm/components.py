"""Connected components of a table of links by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written


ROWS_PER_TASK = 20_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour (itself included)."""
    near = _both(links)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
    return near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    moved = down.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links (columns ``a`` and ``b``).

    ``component`` is the smallest node that can be reached.  Links of a node to
    itself are ignored; repeated links count once.  The number of rounds grows
    with the logarithm of the longest path; each is written to the shared
    folder, by as many tasks as its rows need.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    tasks, mark = 2 + links.count() // ROWS_PER_TASK, None
    links = links.coalesce(tasks)
    while True:
        # stable when every node hangs on one smaller node that hangs on none
        links = written(_small_star(_large_star(links, tasks), tasks).distinct().coalesce(tasks))
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
