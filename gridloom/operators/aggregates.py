"""Aggregations: roll-ups, weighted means, metrics, scalers, fill statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import group_quantiles, percentile_ranks


def monthly_rollup(daily: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Daily -> monthly sum (0 when all missing), mean, and best 7-day total.

    Works on a daily table with one row per (cell, day), so a window partition
    is one month of one cell.  Fewer than seven days fall back to the plain sum.
    """
    week = Window.partitionBy(key, "_month").orderBy(day).rowsBetween(-6, 0)
    pos = Window.partitionBy(key, "_month").orderBy(day)
    rolled = daily.withColumn("_month", F.trunc(day, "month")).select(
        key,
        "_month",
        value,
        F.row_number().over(pos).alias("_n"),
        F.coalesce(F.sum(value).over(week), F.lit(0.0)).alias("_w"),
    )
    return (
        rolled.groupBy(key, "_month")
        .agg(
            F.coalesce(F.sum(value), F.lit(0.0)).alias("monthly_sum"),
            F.avg(value).alias("monthly_mean"),
            F.coalesce(F.max(F.when(F.col("_n") >= 7, F.col("_w"))), F.sum(value), F.lit(0.0)).alias("monthly_max_7day"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .withColumnRenamed("_month", "month_start")
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Weights of missing values are left out of the denominator."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(w))


def fill_with_group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Missing values take the mean of their group; without a group they stay missing."""
    means = df.groupBy(group).agg(F.avg(value).alias("_mean"))
    return df.join(means, group, "left").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def fill_with_medians(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Missing feature values take the exact global median of the feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])).alias("_s")).select("_s.*")
    med = group_quantiles(long, ["f"], "v", {"med": 0.5})
    lookup = med.agg(F.map_from_entries(F.collect_list(F.struct("f", "med"))).alias("m")).scalar()
    return df.withColumn("_m", lookup).withColumns(
        {c: F.coalesce(F.col(c), F.try_element_at(F.col("_m"), F.lit(c)), F.lit(default)) for c in columns}
    ).drop("_m")


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is NULL for a constant side (``corr`` divides by zero in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    scale = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(scale, F.lit(0.0))


def regression_metrics(pred: str, true: str) -> list[Column]:
    """RMSE, MAE, Pearson r, R2, bias and n as plain aggregate columns.

    r is NULL for one row or a constant side, R2 for constant truth.
    """
    p, y = F.col(pred), F.col(true)
    e = p - y
    n = F.count(e)
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(n > 1, pearson(p, y)).alias("pearson_r"),
        (F.lit(1.0) - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.avg(e).alias("bias"),
    ]


def metric_report(predictions: DataFrame, sets: Sequence[Sequence[str]], pred: str, true: str) -> DataFrame:
    """All metric groupings in one pass via grouping sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return (
        predictions.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
        .agg(F.grouping_id().alias("grouping"), *regression_metrics(pred, true))
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with their share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def ensemble_summary(predictions: DataFrame, keys: Sequence[str], members: int) -> DataFrame:
    """Member mean and spread; samples lacking a member are left out.

    One aggregation over the stacked members replaces a chain of member joins.
    """
    return (
        predictions.groupBy(*keys)
        .agg(
            F.avg("y_pred").alias("ens_mean"),
            F.coalesce(F.stddev_samp("y_pred"), F.lit(0.0)).alias("ens_std"),
            F.stddev_pop("y_pred").alias("ens_std_pop"),
            F.count(F.lit(1)).alias("n_members"),
            F.size(F.collect_set("seed")).alias("_seeds"),
        )
        .where(F.col("_seeds") == members)
        .drop("_seeds")
    )


def scaler_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(feature, mean, population std + 1e-6), optionally per group."""
    stats = [
        F.struct(
            F.lit(c).alias("feature"), F.avg(c).alias("mean"), (F.stddev_pop(c) + F.lit(1e-6)).alias("std")
        )
        for c in columns
    ]
    return df.groupBy(*by).agg(F.array(*stats).alias("_a")).select(*by, F.inline("_a"))


def sequence_scaler_rows(df: DataFrame, sequence: str, length: str, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scalers of the fields of padded sequences over all real steps; padding takes no part.

    Steps are streamed out of the arrays into partial moments, never shuffled.
    A sequence of length zero or null adds nothing.
    """
    real = F.slice(sequence, 1, F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)))
    return scaler_rows(df.select(*by, F.inline(real)), fields, by)


def robust_spread(q25: Column, q75: Column, std: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).when(q75 > q25, (q75 - q25) / F.lit(1.349)).otherwise(std)


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman over rows where both are present (NULL below 3 rows)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = both.join(percentile_ranks(both, keys, [x, y]), list(keys))
    enough = F.count(F.lit(1)) >= 3
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, pearson(F.col(x), F.col(y))).alias("pearson_r"),
        F.when(enough, pearson(F.col(f"{x}_rank"), F.col(f"{y}_rank"))).alias("spearman_rho"),
    )


DISTRIBUTION_PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p98_5": 0.985}


def distribution_report(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Long (group, metric, value, unit) description of a distribution."""
    v = F.col(value)
    share = {f"gt_{k}m_pct": 100 * F.avg(F.when(v.isNotNull(), (v > k).cast("double"))) for k in (1, 2, 3)}
    share["le_0m_pct"] = 100 * F.avg(F.when(v.isNotNull(), (v <= 0).cast("double")))
    plain = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n_cells"),
        F.count(v).cast("double").alias("n_valid"),
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        *[c.alias(n) for n, c in share.items()],
    )
    wide = plain.join(group_quantiles(df, by, value, DISTRIBUTION_PROBS), list(by), "left")
    names = ["n_cells", "n_valid", "mean", "max", *share, *DISTRIBUTION_PROBS]
    units = {n: "%" for n in share} | {n: "m" for n in ["mean", "max", *DISTRIBUTION_PROBS]}
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(units.get(n, "")).alias("unit")) for n in names]
    return wide.select(*by, F.inline(F.array(*entries)))


def box_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles and 5/95 % whiskers per group, infinities left out."""
    finite = df.where(F.abs(F.col(value)) < float("inf"))
    return group_quantiles(
        finite, by, value, {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    )


def weighted_fit(x: Column, y: Column, w: Column, floor: float = 1e-6) -> tuple[Column, Column]:
    """Slope and intercept of a weighted line as aggregate expressions.

    Uses moments, so it needs one pass; the spread of x is floored.
    """
    sw, swx, swy = F.sum(w), F.sum(w * x), F.sum(w * y)
    xm, ym = swx / sw, swy / sw
    sxy = F.sum(w * x * y) - sw * xm * ym
    sxx = F.sum(w * x * x) - sw * xm * xm
    slope = sxy / F.greatest(sxx, F.lit(floor))
    return slope, ym - slope * xm


def pooled_limits(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Robust limits of a pooled column with flags for values outside them."""
    q = group_quantiles(df, [], value, {"lo": lo, "hi": hi})
    ends = df.agg(F.struct(F.min(value).alias("a"), F.max(value).alias("b")).alias("e")).scalar()
    return (
        q.withColumn("_e", ends)
        .withColumns({"below": F.col("_e.a") < F.col("lo"), "above": F.col("_e.b") > F.col("hi")})
        .drop("_e")
    )
