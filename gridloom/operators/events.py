"""Event metrics per cell: decline, first passage, recovery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import guarded_ratio
from gridloom.operators.windows import first_at_max, first_at_min


@dataclass(frozen=True)
class DroughtWindows:
    """Month windows as inclusive month ordinals (12 * year + month)."""

    pre: tuple[int, int]
    drought: tuple[int, int]
    recovery: tuple[int, int]
    base_year: int
    deficit_year: int
    recovery_year: int
    min_decline: float = 0.30
    min_deficit: float = 0.10

    @staticmethod
    def of_year(year: int, base_year: int, recovery_year: int, **kw) -> "DroughtWindows":
        """Jan-Apr before, May-Oct drought, Nov-Apr recovery of ``year``."""
        o = 12 * year
        return DroughtWindows((o + 1, o + 4), (o + 5, o + 10), (o + 11, o + 16), base_year, year, recovery_year, **kw)


def season(ordinal: Column, window: tuple[int, int]) -> Column:
    return ordinal.between(*window)


def require_months(calendar: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Calendar rows of a window; an empty window fails the job."""
    kept = calendar.where(season(F.col("month_ord"), window))
    n = kept.agg(F.count(F.lit(1))).scalar()
    guard = F.when(n == 0, F.raise_error(F.lit(f"no months in window {window}")).cast("long")).otherwise(n)
    return kept.withColumn("n_in_window", guard)


def drought_metrics(panel: DataFrame, windows: DroughtWindows, first_ord: int) -> DataFrame:
    """Five response metrics per cell.

    One conditional aggregation finds peaks and troughs.  The first passage
    after the peak needs the series once more: the months travel as one array
    per cell (calendar bounded), so there is no second shuffle.  Yearly means
    are summed along that array in month order: equal cells get equal bits, so
    ranks made from them keep their ties.
    """
    o, v, i = F.col("month_ord"), F.col("wtd"), F.col("month_idx")
    p = panel.where(v.isNotNull()).withColumn("month_ord", i + first_ord)
    year = F.floor((o - 1) / 12)

    def during(window, x=v):
        return F.when(season(o, window), x)

    def in_year(y):
        return F.when(year == y, v)

    def mean_of_year(y):
        picked = F.filter("_series", lambda s: F.floor((s["i"] + (first_ord - 1)) / 12) == y)
        return F.aggregate(picked, F.lit(0.0), lambda a, s: a + s["v"]) / F.nullif(F.size(picked), F.lit(0))

    w = windows
    agg = p.groupBy("grid_id").agg(
        F.min(during(w.pre)).alias("pre_wtd"),
        first_at_min(during(w.pre), i).alias("pre_idx"),
        F.max(during(w.drought)).alias("peak_wtd"),
        first_at_max(during(w.drought), i).alias("peak_idx"),
        F.min(during(w.recovery)).alias("early_recovery_wtd"),
        first_at_min(during(w.recovery), i).alias("early_recovery_idx"),
        F.max(in_year(w.deficit_year)).alias("annual_peak_wtd"),
        F.sort_array(F.collect_list(F.struct(i.alias("i"), v.cast("double").alias("v")))).alias("_series"),
    ).withColumns({"baseline_wtd": mean_of_year(w.base_year), "_late": mean_of_year(w.recovery_year)})
    decline = F.col("peak_wtd") - F.col("pre_wtd")
    agg = agg.withColumns(
        {
            "_decline": decline,
            "months_to_peak": F.greatest(F.col("peak_idx") - F.col("pre_idx"), F.lit(1)),
            "deficit": F.col("annual_peak_wtd") - F.col("baseline_wtd"),
            "residual_deficit": F.col("_late") - F.col("baseline_wtd"),
            "valid_decline": F.coalesce(decline >= w.min_decline, F.lit(False)),
        }
    )
    threshold = F.col("peak_wtd") - F.lit(0.5) * F.col("_decline")
    passed = F.filter("_series", lambda s: (s["i"] > F.col("peak_idx")) & (s["v"] <= threshold))
    ok = F.col("valid_decline")
    ok_deficit = F.coalesce(F.col("deficit") >= w.min_deficit, F.lit(False))
    recovered = F.col("peak_wtd") - F.col("early_recovery_wtd")
    return agg.select(
        "grid_id",
        "pre_wtd",
        "peak_wtd",
        "pre_idx",
        "peak_idx",
        "months_to_peak",
        F.when(ok, F.col("_decline")).alias("decline_m"),
        F.when(ok, F.col("_decline") / F.col("months_to_peak")).alias("rdown"),
        "early_recovery_wtd",
        "early_recovery_idx",
        F.when(ok, recovered).alias("early_recovery_m"),
        guarded_ratio(recovered, F.col("_decline"), ok).alias("rr_early"),
        F.when(ok, F.array_min(F.transform(passed, lambda s: s["i"])) - F.col("peak_idx")).alias("t50"),
        "baseline_wtd",
        "annual_peak_wtd",
        "deficit",
        "residual_deficit",
        guarded_ratio(F.col("deficit") - F.col("residual_deficit"), F.col("deficit"), ok_deficit).alias("rr_late"),
        "valid_decline",
        ok_deficit.alias("valid_deficit"),
    )


def peak_declines(
    panel: DataFrame, windows: Mapping[int, tuple[Sequence[int], Sequence[int]]], first_ord: int
) -> DataFrame:
    """Peak decline per listed year, each with its own pre and drawdown months."""
    o = F.col("month_idx") + first_ord
    year, month = F.floor((o - 1) / 12).cast("int"), (F.pmod(o - 1, F.lit(12)) + 1).cast("int")
    pre, draw = F.lit(False), F.lit(False)
    for y, (a, b) in windows.items():
        pre = pre | ((year == y) & month.between(*a))
        draw = draw | ((year == y) & month.between(*b))
    v = F.col("wtd")
    return (
        panel.where(pre | draw)
        .groupBy("grid_id", year.alias("year"))
        .agg((F.max(F.when(draw, v)) - F.min(F.when(pre, v))).alias("decline"))
    )
