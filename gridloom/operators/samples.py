"""Horizon samples: pairing, splitting, weighting and quality control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import step_weight


def horizon_pairs(obs: DataFrame, horizons: Sequence[int], columns: Sequence[str], level: str = "wtd") -> DataFrame:
    """(cell, t) paired with (cell, t+H) for every H, as one shifted equi join.

    ``(grid_id, month_idx)`` is unique, so each start row meets at most one
    target row per horizon.
    """
    start = obs.select(
        "grid_id",
        F.col("month_idx").alias("start_idx"),
        *[F.col(c).alias(f"{c}_t") for c in columns],
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"),
    ).withColumn("target_idx", F.col("start_idx") + F.col("h"))
    target = obs.select(
        "grid_id", F.col("month_idx").alias("target_idx"), *[F.col(c).alias(f"{c}_target") for c in columns]
    )
    delta = F.col(f"{level}_target") - F.col(f"{level}_t")
    return start.join(target, ["grid_id", "target_idx"]).withColumns({"delta_wtd": delta, "delta_h": -delta})


def seeded_cell_split(cells: DataFrame, seed: int, fractions: Sequence[tuple[str, float]]) -> DataFrame:
    """Reproducible split of cells with largest-remainder counts.

    Cells are ordered by an integer hash of (id + seed); positions come from
    bucket offsets, so the order never passes through one task.
    """
    from gridloom.operators.ranks import value_cdf

    total = sum(f for _, f in fractions)
    mixed = F.pmod((F.col("grid_id") + F.lit(seed)) * F.lit(2654435761), F.lit(2**32))
    # the id breaks ties: hash in the high part, id rank inside a hash by the struct order
    keyed = cells.select("grid_id").distinct().select("grid_id", F.struct(mixed.alias("m"), "grid_id").alias("_k"))
    placed = value_cdf(keyed, [], "_k").select(
        F.col("_k.grid_id").alias("grid_id"), F.col("below_n").alias("_pos"), F.col("total_n").alias("_n")
    )
    n = F.col("_n")
    raw = [n * F.lit(f / total) for _, f in fractions]
    floors = [F.floor(r) for r in raw]
    left_over = n - sum(floors[1:], floors[0])
    order = F.array_sort(
        F.array(*[F.struct((fl - r).alias("neg_frac"), F.lit(i).alias("i")) for i, (r, fl) in enumerate(zip(raw, floors))])
    )
    winners = F.transform(F.slice(order, 1, F.greatest(left_over, F.lit(0)).cast("int")), lambda s: s["i"])
    label, edge = F.lit(None).cast("string"), F.lit(0)
    edges = []
    for i, fl in enumerate(floors):
        edge = edge + fl + F.array_contains(winners, i).cast("int")
        edges.append(edge)
    for (name, _), e in zip(reversed(list(fractions)), reversed(edges)):
        label = F.when(F.col("_pos") < e, F.lit(name)).otherwise(label)
    return placed.where(n > 0).select("grid_id", label.alias("grid_split"))


def quality_flag(min_days: int, splits: Sequence[str]) -> Column:
    return F.coalesce(
        F.col("split").isin(*splits)
        & ((F.col("n_days_t") < min_days) | (F.col("n_days_target") < min_days)),
        F.lit(False),
    )


def quality_filter(samples: DataFrame, min_days: int, splits: Sequence[str]) -> DataFrame:
    return samples.where(~quality_flag(min_days, splits))


def quality_report(samples: DataFrame, min_days: int, splits: Sequence[str]) -> DataFrame:
    bad = quality_flag(min_days, splits)
    return samples.groupBy("split").agg(
        F.count_if(bad).alias("removed"), F.count_if(~bad).alias("kept"), F.count(F.lit(1)).alias("total")
    )


def sample_weights(
    samples: DataFrame,
    horizon_weights: dict[int, float],
    day_steps: tuple[Sequence[float], Sequence[float]],
    site_steps: tuple[Sequence[float], Sequence[float]],
) -> DataFrame:
    """Horizon x days x sites weight, scaled to mean one inside each split.

    The split mean comes from a pre-aggregated table of one row per split label,
    which is broadcast; a window would pull a whole split into one task.
    """
    hw = F.lit(1.0)
    for h, w in horizon_weights.items():
        hw = F.when(F.col("h") == h, F.lit(float(w))).otherwise(hw)
    days = F.least("n_days_t", "n_days_target")
    sites = F.least("n_sites_t", "n_sites_target")
    raw = samples.withColumn("raw_weight", hw * step_weight(days, *day_steps) * step_weight(sites, *site_steps))
    means = raw.groupBy("split").agg(F.avg("raw_weight").alias("_mean"))
    return raw.join(F.broadcast(means), "split").withColumn("weight", F.col("raw_weight") / F.col("_mean")).drop("_mean")


def finite_ahead(panel: DataFrame, columns: Sequence[str], horizon: int) -> DataFrame:
    """Start months whose next ``horizon`` months all carry every listed column."""
    w = Window.partitionBy("grid_id").orderBy("month_idx").rowsBetween(1, horizon)
    full = F.lit(True)
    for c in columns:
        full = full & (F.count(c).over(w) == horizon)
    return panel.withColumn("finite_window", full)


def combined_test(table: DataFrame, parts: Sequence[str] = ("test_temporal", "test_spatial")) -> DataFrame:
    """Append the union of the partial test splits under the label ``test``.

    One pass: each partial-test row is emitted twice instead of scanning twice.
    """
    labels = F.when(F.col("split").isin(*parts), F.array(F.col("split"), F.lit("test"))).otherwise(F.array(F.col("split")))
    return table.withColumn("split", F.explode(labels))
