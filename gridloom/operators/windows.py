"""Ordered operators over calendar-bounded series and over the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate_linear(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """Linear interpolation by position; the ends hold the nearest value.

    A partition is one series (one row per month).
    """
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    marked = df.withColumn("_k", known).withColumns(
        {"_p": F.last("_k", ignorenulls=True).over(back), "_n": F.first("_k", ignorenulls=True).over(ahead)}
    )
    p, n = F.col("_p"), F.col("_n")
    share = (F.col(time) - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0))
    filled = (
        F.when(p.isNull(), n["v"])
        .when(n.isNull() | (p["t"] == n["t"]), p["v"])
        .otherwise(p["v"] + (n["v"] - p["v"]) * share)
    )
    return marked.withColumn(out, filled).drop("_k", "_p", "_n")


def centred_mean(value: str, keys: Sequence[str], time: str, reach: int = 1) -> Column:
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(time).rowsBetween(-reach, reach)
    return F.avg(value).over(w)


def regional_fill(series: DataFrame, value: str, out: str) -> DataFrame:
    """Interpolate a monthly series both ways, then smooth over three months."""
    filled = interpolate_linear(series, [], "month_idx", value, "_filled")
    return filled.withColumn(out, centred_mean("_filled", [], "month_idx")).drop("_filled")


def smooth_3x3(field: DataFrame, value: str) -> DataFrame:
    """3x3 median on the grid; edges are replicated, missing centres stay missing.

    Each cell looks up nine clamped positions by equi join.
    """
    ext = field.agg(
        F.struct(
            F.min("grid_row").alias("r0"), F.max("grid_row").alias("r1"),
            F.min("grid_col").alias("c0"), F.max("grid_col").alias("c1"),
        ).alias("e")
    ).scalar()
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    around = (
        field.where(F.col(value).isNotNull())
        .select("grid_id", "grid_row", "grid_col", F.inline(offsets))
        .withColumn("_e", ext)
        .select(
            "grid_id",
            F.least(F.greatest(F.col("grid_row") + F.col("dr"), F.col("_e.r0")), F.col("_e.r1")).alias("grid_row"),
            F.least(F.greatest(F.col("grid_col") + F.col("dc"), F.col("_e.c0")), F.col("_e.c1")).alias("grid_col"),
        )
    )
    values = field.select("grid_row", "grid_col", value)
    medians = around.join(values, ["grid_row", "grid_col"]).groupBy("grid_id").agg(F.median(value).alias("smoothed"))
    return field.join(medians, "grid_id", "left")


def first_at_min(value: Column, index: Column) -> Column:
    """Index of the smallest value, first index on ties (NULLs ignored)."""
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), index.alias("i"))))["i"]


def first_at_max(value: Column, index: Column) -> Column:
    return -F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-index).alias("i"))))["i"]


def keep_last(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Deduplicate by key, keeping the row with the highest sequence number.

    ``max_by`` combines map side, so a key with many copies never lands whole
    in one task.
    """
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
        .select(*key, *[F.col("_r").getField(c).alias(c) for c in rest])
    )
