"""Depth-profile operators: views, bands, regridding, layer statistics.

Layers are long rows ``(grid_id, layer, depth_m, value)`` or one array per cell;
a profile has a few dozen layers, so per-cell windows and arrays are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile_view(profiles: DataFrame, depths: Sequence[float], max_depth: float | None = None, first: int | None = None) -> DataFrame:
    """Keep layers down to ``max_depth`` or the first N; an empty view is an error."""
    if max_depth is not None:
        keep = [d for d in depths if d <= max_depth]
    else:
        keep = list(depths)[: max(1, min(first or len(depths), len(depths)))]
    if not keep:
        raise ValueError(f"no layer at or above {max_depth} m")
    if list(depths[: len(keep)]) != keep:
        chosen = [i for i, d in enumerate(depths) if d in keep]
        kept = F.array(*[F.col("values")[i] for i in chosen])
    else:
        kept = F.slice("values", 1, len(keep))
    return profiles.withColumn("values", kept).withColumn("depths_m", F.array(*[F.lit(d) for d in keep]))


def check_bands(bands: Sequence[tuple[float, float]], depths: Sequence[float] | None = None) -> None:
    last = float("-inf")
    for lo, hi in bands:
        if not hi > lo or lo < last or hi == float("inf"):
            raise ValueError(f"depth bands must be finite, ordered and disjoint: {bands}")
        if depths is not None and not any(lo <= d < hi for d in depths):
            raise ValueError(f"depth band [{lo}, {hi}) holds no layer")
        last = hi


def band_label(depth: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open band holding ``depth`` (NULL outside)."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bands):
        out = F.when((depth >= lo) & (depth < hi), F.lit(i)).otherwise(out)
    return out


def band_means(layers: DataFrame, bands: Sequence[tuple[float, float]], depths: Sequence[float] | None = None) -> DataFrame:
    """Mean per cell and band; a band without values takes the mean of that band.

    Bands are disjoint literals, so a label column replaces the range join.
    """
    check_bands(bands, depths)
    per_cell = (
        layers.withColumn("band", band_label(F.col("depth_m"), bands))
        .where("band IS NOT NULL")
        .groupBy("grid_id", "band")
        .agg(F.avg("value").alias("mean"))
    )
    overall = per_cell.groupBy("band").agg(F.avg("mean").alias("_band_mean"))
    return per_cell.join(F.broadcast(overall), "band").select("grid_id", "band", F.coalesce("mean", "_band_mean").alias("mean"))


def regrid_profile(layers: DataFrame, top: int, step: int = 1) -> DataFrame:
    """Linear interpolation to regular depths 0..top; NULL outside the valid range.

    Every pair of neighbouring valid layers emits the depths between them, so no
    join of depths with layers is needed.  Fewer than two valid layers give
    NULLs only.
    """
    w = Window.partitionBy("grid_id").orderBy("depth_m")
    valid = layers.where(F.col("value").isNotNull()).select(
        "grid_id",
        F.col("depth_m").alias("d0"),
        F.col("value").alias("v0"),
        F.lead("depth_m").over(w).alias("d1"),
        F.lead("value").over(w).alias("v1"),
        F.lead("depth_m", 2).over(w).isNull().alias("_last"),
    ).where("d1 IS NOT NULL")
    first = F.greatest(F.ceil(F.col("d0") / step), F.lit(0)) * step
    last = F.least(F.floor(F.col("d1") / step) * step, F.lit(top))
    points = (
        valid.where(first <= last)
        .select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(step))).alias("z"))
        .where(F.col("_last") | (F.col("z") < F.col("d1")))
        .select(
            "grid_id", "z",
            (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("z") - F.col("d0")) / (F.col("d1") - F.col("d0"))).alias("value"),
        )
    )
    grid = layers.select("grid_id").distinct().select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(step))).alias("z"))
    return grid.join(points, ["grid_id", "z"], "left")


def mean_between(lo: float, hi: float) -> Column:
    return F.avg(F.when((F.col("z") >= lo) & (F.col("z") < hi), F.col("value")))


def thickness(condition: Column, lo: float = 0, hi: float = 400) -> Column:
    return F.count_if(condition & (F.col("z") >= lo) & (F.col("z") < hi))


def longest_run(flags: Column) -> Column:
    """Longest stretch of TRUE in a boolean array."""
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(acc, flag):
        cur = F.when(flag, acc["cur"] + 1).otherwise(F.lit(0))
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc["best"])


def structure_features(regridded: DataFrame, high: float, low: float, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """All profile structure predictors from one aggregation of the 1-m rows."""
    v, z = F.col("value"), F.col("z")
    in_range = (z >= 0) & (z < 400)
    deficit = F.when((z >= 50) & (z < 200), F.greatest(F.lit(low) - v, F.lit(0.0)))
    flags = F.transform(
        F.sort_array(F.collect_list(F.struct(z.alias("z"), F.coalesce((v >= high) & in_range, F.lit(False)).alias("f")))), lambda s: s["f"]
    )
    agg = regridded.groupBy("grid_id").agg(
        *[mean_between(a, b).alias(f"band_{a}_{b}") for a, b in bands],
        mean_between(0, 50).alias("shallow"),
        mean_between(50, 150).alias("middle"),
        mean_between(150, 300).alias("deep"),
        thickness(v >= high).alias("high_thickness"),
        thickness(v <= low).alias("low_thickness"),
        longest_run(flags).alias("longest_high_run"),
        F.coalesce(F.sum(deficit), F.lit(0.0)).alias("barrier_strength"),
    )
    names = [f"band_{a}_{b}" for a, b in bands]
    deltas = {f"delta_{i}": F.col(b) - F.col(a) for i, (a, b) in enumerate(zip(names[:-1], names[1:]))}
    return agg.withColumns(
        deltas
        | {
            "sandwich_contrast": F.lit(0.5) * (F.col("shallow") + F.col("deep")) - F.col("middle"),
            "shallow_minus_middle": F.col("shallow") - F.col("middle"),
            "middle_minus_deep": F.col("middle") - F.col("deep"),
            "shallow_minus_deep": F.col("shallow") - F.col("deep"),
        }
    )


def layer_statistics(layers: DataFrame) -> DataFrame:
    return layers.groupBy("grid_id").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (F.max("value") - F.min("value")).alias("value_range"),
        (F.count("value") / F.count(F.lit(1))).alias("valid_fraction"),
        F.max(F.when(F.col("value").isNotNull(), F.col("depth_m"))).alias("max_valid_depth"),
    )


def native_columns(profiles: DataFrame, depths: Sequence[float]) -> DataFrame:
    """One column per native layer, named by its depth."""
    return profiles.select(
        "grid_id", *[F.try_element_at("values", F.lit(i + 1)).alias(f"native_{d:.1f}m".replace(".", "p")) for i, d in enumerate(depths)]
    )


def pumping_features(monthly: DataFrame, first_ord: int, event_year: int, value: str = "pumping") -> DataFrame:
    """Two-level pumping predictors per cell: yearly sums first, then their means.

    The first level leaves at most one row per cell and year.
    """
    o = F.col("month_idx") + first_ord
    year = F.floor((o - 1) / 12).cast("int")
    month = F.pmod(o - 1, F.lit(12)) + 1
    v = F.col(value)
    growing = month.between(4, 10)
    yearly = monthly.groupBy("grid_id", year.alias("_year")).agg(
        F.sum(v).alias("_sum"),
        F.count(v).alias("_n"),
        F.max(v).alias("_peak"),
        F.sum(F.when(growing, v)).alias("_growing"),
        F.max(F.when(growing, F.lit(1))).alias("_grows"),
        F.sum(F.when((year == event_year) & month.between(5, 10), v)).alias("_event"),
    )
    out = yearly.groupBy("grid_id").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_monthly"),
        F.max("_peak").alias("peak_month"),
        (F.sum("_sum") / F.count(F.lit(1))).alias("mean_annual"),
        F.try_divide(F.sum("_growing"), F.count("_grows")).alias("mean_growing"),
        F.sum("_event").alias("event_sum"),
    )
    names = ["mean_monthly", "peak_month", "mean_annual", "mean_growing", "event_sum"]
    out = out.na.fill(0.0, names)
    return out.withColumns({f"log1p_{n}": F.log1p(F.greatest(F.col(n), F.lit(0.0))) for n in names[1:]})
