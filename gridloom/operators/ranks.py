"""Exact ranks and quantiles without a single-task sort.

Spark's ``percentile`` and an un-partitioned ``rank()`` both put one whole group
into one task.  That is fine for a cell (bounded by its months) but not for a
month, a split or the whole table.  Here the group is first reduced to value
counts (map-side combined), which are dealt by value range.  A range partition
is a bucket; its number is written down with the counts, so a recomputed task
sees the same buckets.  Bucket totals give each bucket its offset, and only rows
inside a bucket are sorted.  Distinct values cannot be skewed, a group may have
any number of buckets, and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

_ALL = "_all"
SALTS = 8


def _bucketed(df: DataFrame, groups: Sequence[str], value: str, measures: Mapping[str, Column], buckets: int | None) -> DataFrame:
    """Counts per distinct value and the range bucket they are in, written once (they are read several times)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[m.alias(name) for name, m in measures.items()])
    dealt = counts.repartitionByRange(*([buckets] if buckets else []), *groups, value)
    return cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))


def _bucket_offsets(bucketed: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals before each bucket; there are as many buckets as range partitions."""
    totals = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return totals.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.col(m).alias(f"_in_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )


def _keyed(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if groups:
        return df, list(groups)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def value_cdf(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: Mapping[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Distinct values with ``below_m`` (sum over smaller values) and ``total_m``."""
    measures = dict(measures or {"n": F.count(F.lit(1))})
    df, keys = _keyed(df, groups)
    bucketed = _bucketed(df, keys, value, measures, buckets)
    offsets = _bucket_offsets(bucketed, keys, list(measures))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"below_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )
    return out if groups else out.drop(_ALL)


def pick_ranks(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    buckets: int | None = None,
) -> DataFrame:
    """Order statistics: ``ranks[name](n)`` is a 0-based position in the group.

    Only buckets that contain a wanted position are sorted.
    """
    df, keys = _keyed(df, groups)
    bucketed = _bucketed(df, keys, value, {"n": F.count(F.lit(1))}, buckets)
    offsets = _bucket_offsets(bucketed, keys, ["n"])
    wanted = {name: fn(F.col("total_n")).cast("long") for name, fn in ranks.items()}
    hit = F.lit(False)
    for pos in wanted.values():
        hit = hit | ((pos >= F.col("_off_n")) & (pos < F.col("_off_n") + F.col("_in_n")))
    offsets = offsets.where(hit)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    located = bucketed.join(offsets, [*keys, "_bucket"]).withColumn(
        "_lo", F.col("_off_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    out = located.groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        *[
            F.max(F.when((pos >= F.col("_lo")) & (pos < F.col("_lo") + F.col("n")), F.col(value))).alias(name)
            for name, pos in wanted.items()
        ],
    )
    return out if groups else out.drop(_ALL)


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of unbounded groups; columns ``n`` + names."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"_{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        ranks[f"_{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    picked = pick_ranks(df, groups, value, ranks, buckets)
    cols = []
    for name, p in probs.items():
        t = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (t - F.floor(t))).alias(name))
    return picked.select(*groups, "n", *cols)


def percentile_ranks(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Average-tie percentile rank (0..1] of several columns in one pass.

    Missing values meet no rank and skip the join; the ranks are repeated per
    salt, so the rows of a frequent value are spread.
    """
    long = df.unpivot(list(keys), list(columns), "_name", "_value").withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    cdf = value_cdf(long, ["_name"], "_value", buckets=buckets)
    rank = (F.col("below_n") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total_n")
    salted = cdf.select("_name", "_value", rank.alias("_rank"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    present = long.where(F.col("_value").isNotNull()).join(salted, ["_name", "_value", "_salt"]).select(*keys, "_name", "_rank")
    missing = long.where(F.col("_value").isNull()).select(*keys, "_name", F.lit(None).cast("double").alias("_rank"))
    return present.unionByName(missing).groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_rank"))).alias(f"{c}_rank") for c in columns])


def row_ids(
    df: DataFrame, coarse: Sequence[str], fine: str, order: Sequence[str], out: str, fine_width: int = 65_536
) -> DataFrame:
    """Consecutive 0-based ids in the total order ``coarse, order``.

    ``coarse`` columns take few values (calendar or label bounded), ``fine`` is
    the integer that leads ``order``.  Counting per (coarse, fine range) yields
    offsets, so no task ever sorts more than one fine range.
    """
    ranged = df.withColumn("_fine", F.floor(F.col(fine) / fine_width).cast("long"))
    blocks = ranged.groupBy(*coarse, "_fine").agg(F.count(F.lit(1)).alias("_n"))
    in_coarse = Window.partitionBy(*coarse).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    coarse_totals = blocks.groupBy(*coarse).agg(F.sum("_n").alias("_c"))
    ordered = Window.orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    coarse_off = coarse_totals.select(*coarse, F.coalesce(F.sum("_c").over(ordered), F.lit(0)).alias("_coff"))
    offsets = blocks.select(
        *coarse, "_fine", F.coalesce(F.sum("_n").over(in_coarse), F.lit(0)).alias("_foff")
    ).join(coarse_off, list(coarse))
    inside = Window.partitionBy(*coarse, "_fine").orderBy(*order)
    return (
        ranged.join(offsets, [*coarse, "_fine"])
        .withColumn(out, F.col("_coff") + F.col("_foff") + F.row_number().over(inside) - 1)
        .drop("_fine", "_coff", "_foff")
    )
