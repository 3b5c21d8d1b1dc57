"""Regional storage proxies and the mass correction of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import clip
from gridloom.operators.ranks import group_quantiles
from gridloom.operators.windows import regional_fill


def valid_solutions(monthly: DataFrame, value: str, flag: Column) -> DataFrame:
    """Anomaly against the mean of valid months; invalid months get NULL."""
    ok = flag & F.col(value).isNotNull()
    mean = monthly.where(ok).agg(F.avg(value)).scalar()
    return monthly.withColumn("valid", ok).withColumn("anomaly", F.when(F.col(value).isNotNull(), F.col(value) - mean))


def storage_proxy(panel: DataFrame, yields: DataFrame, valid_months: DataFrame) -> DataFrame:
    """-100 * mean over cells of Sy * (level - cell reference), in cm per month.

    The reference is the cell mean over valid months.  The hint keeps the cells
    on the hashed side of the join: a panel exploded from a small table is
    estimated at that table's size and would be broadcast through the driver.
    """
    months = valid_months.agg(F.collect_set("month_idx")).scalar()
    panel = panel.select("grid_id", "month_idx", "wtd")
    ref = (
        panel.withColumn("_ok", F.array_contains(months, F.col("month_idx")))
        .groupBy("grid_id")
        .agg(F.avg(F.when(F.col("_ok"), F.col("wtd"))).alias("_ref"))
        .join(yields.select("grid_id", "sy"), "grid_id")
    )
    return (
        panel.join(ref.hint("shuffle_hash"), "grid_id")
        .groupBy("month_idx")
        .agg((F.lit(-100.0) * F.avg((F.col("wtd") - F.col("_ref")) * F.col("sy"))).alias("storage_cm"))
    )


def well_storage_target(
    obs: DataFrame, baseline: DataFrame, yields: DataFrame, calendar: DataFrame, valid_months: DataFrame
) -> DataFrame:
    """Storage target from observations: anomalies, demeaned per cell, Sy weighted.

    Monthly means are filled over the calendar, smoothed, scaled to cm and
    centred on the valid months.
    """
    anom = obs.join(baseline.select("grid_id", "base_wtd"), "grid_id").withColumn("_a", F.col("wtd") - F.col("base_wtd"))
    med = anom.groupBy("grid_id").agg(F.median("_a").alias("_med")).join(yields.select("grid_id", "sy"), "grid_id")
    monthly = (
        anom.join(med, "grid_id")
        .groupBy("month_idx")
        .agg(F.avg((F.col("_a") - F.col("_med")) * F.col("sy")).alias("mean_m"), F.count(F.lit(1)).alias("n_obs"))
    )
    series = calendar.select("month_idx").join(monthly, "month_idx", "left").na.fill(0, ["n_obs"])
    filled = regional_fill(series, "mean_m", "_smooth").withColumn("_cm", F.lit(-100.0) * F.col("_smooth"))
    centre = filled.join(valid_months.select("month_idx"), "month_idx", "left_semi").agg(F.avg("_cm")).scalar()
    return filled.select("month_idx", "n_obs", "mean_m", (F.col("_cm") - centre).alias("target_cm"))


def correction_weight(support: Column) -> Column:
    return clip(F.lit(1.0) - support, 0.15, 1.0)


def mass_correction(
    panel: DataFrame, cells: DataFrame, obs: DataFrame, source: DataFrame, target: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Shift unobserved cells so that the storage proxy meets its target.

    ``cells`` carries ``sy`` and ``base_weight``.  Returns the corrected panel (a
    new table, the input stays as it is) and the monthly shift table.  Observed
    months travel as one calendar-bounded array per cell, so the panel is
    shuffled once, by cell, and never broadcast.
    """
    seen = obs.groupBy("grid_id").agg(F.collect_set("month_idx").alias("_seen"))
    known = cells.select("grid_id", "sy", "base_weight").join(seen, "grid_id", "left")
    observed = F.coalesce(F.array_contains("_seen", F.col("month_idx")), F.lit(False))
    weighted = (
        panel.join(known.hint("shuffle_hash"), "grid_id")
        .withColumn("weight", F.when(observed, F.lit(0.0)).otherwise(F.col("base_weight")))
        .drop("_seen")
    )
    shift = (
        weighted.groupBy("month_idx")
        .agg(F.avg(F.col("weight") * F.col("sy")).alias("weighted_sy"), F.count_if(F.col("weight") == 0).alias("preserved"))
        .join(source, "month_idx")
        .join(target.select("month_idx", "target_cm"), "month_idx")
        .withColumn("diff_cm", F.col("target_cm") - F.col("storage_cm"))
        .withColumn(
            "shift_m",
            F.when(F.col("weighted_sy") > 1e-6, -F.col("diff_cm") / (F.lit(100.0) * F.col("weighted_sy"))).otherwise(F.lit(0.0)),
        )
    )
    moved = weighted.join(F.broadcast(shift.select("month_idx", "shift_m")), "month_idx").withColumn("applied", F.col("shift_m") * F.col("weight"))
    return moved.withColumn("corrected", F.col("wtd") + F.col("applied")), shift


def shift_diagnostics(corrected: DataFrame, shift: DataFrame) -> DataFrame:
    ends = corrected.groupBy("month_idx").agg(F.min("applied").alias("shift_min"), F.max("applied").alias("shift_max"))
    mid = group_quantiles(corrected, ["month_idx"], "applied", {"shift_p50": 0.5}).drop("n")
    return shift.join(ends, "month_idx").join(mid, "month_idx")
