"""Step plans and propagation of prediction radii along them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HORIZONS = (6, 3, 1)


def greedy_paths(largest: int) -> dict[int, tuple[int, ...]]:
    """A plan per gap up to the largest one present: horizons 6, 3 and 1, longest first."""
    paths = {}
    for gap in range(1, largest + 1):
        left, path = gap, []
        for h in HORIZONS:
            path += [h] * (left // h)
            left %= h
        paths[gap] = tuple(path)
    return paths


def leaf_segments(anchors: DataFrame) -> DataFrame:
    """Consecutive anchor months as (left_idx, right_idx); calendar bounded."""
    w = Window.orderBy("month_idx")
    return (
        anchors.select(F.col("month_idx").alias("left_idx"), F.lead("month_idx").over(w).alias("right_idx"))
        .where("right_idx IS NOT NULL")
    )


def split_leaves(summary: DataFrame) -> DataFrame:
    """Leaf segments of an adaptive split: those that were not split again."""
    return summary.where(~F.col("was_split")).select("left_idx", "right_idx").distinct()


def plan_steps(segments: DataFrame, paths: Mapping[int, Sequence[int]]) -> DataFrame:
    """(left, target, pos, n_steps, start_idx, h): the steps leading to each month.

    The plan has a few rows per month of the longest gap and travels as a
    literal array.  A segment longer than the longest path is an error.
    """
    rows = []
    for gap, path in paths.items():
        at = 0
        for pos, h in enumerate(path, start=1):
            rows.append((gap, pos, len(path), at, h))
            at += h
    names = ("gap", "pos", "n_steps", "offset", "h")
    plan = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    span = F.col("right_idx") - F.col("left_idx")
    span = F.when(span <= max(paths), span).otherwise(F.raise_error(F.lit("a gap has no path")).cast("int"))
    return (
        segments.select("left_idx", "right_idx", span.alias("_span"), F.inline(plan))
        .where(F.col("gap") <= F.col("_span"))
        .select(
            "left_idx", (F.col("left_idx") + F.col("gap")).alias("target_idx"), "pos", "n_steps",
            (F.col("left_idx") + F.col("offset")).alias("start_idx"), "h",
        )
    )


def required_steps(steps: DataFrame) -> DataFrame:
    return steps.select("start_idx", "h").distinct()


def step_radius(spread: DataFrame, qhat: DataFrame) -> DataFrame:
    """q-hat of the horizon times the population spread of the members' predictions.

    ``spread`` has a row per (grid_id, start_idx, h), ``qhat`` one per horizon.
    """
    return spread.join(F.broadcast(qhat.select("h", "qhat")), "h").select("grid_id", "start_idx", "h", (F.col("qhat") * F.col("spread")).alias("radius"))


def discounted_rss(cells: DataFrame, steps: DataFrame, radii: DataFrame, gamma: float = 0.55) -> DataFrame:
    """sqrt of the discounted sum of squared step radii per (cell, target month).

    Every cell gets every target month of the plan.  A path with a missing step
    has no radius; ``steps_found`` tells how many of ``n_steps`` there are.
    """
    weight = F.pow(F.lit(gamma), F.col("n_steps") - F.col("pos"))
    plan = steps.agg(F.collect_list(F.struct("target_idx", "pos", "n_steps", "start_idx", "h"))).scalar()
    key = F.struct(F.col("start_idx").cast("int").alias("start_idx"), F.col("h").cast("int").alias("h"))
    packed = by_cell(radii, key, F.col("radius"), "_radii")
    # the steps of a cell meet its radii where the cell is; the groups need no further shuffle
    return (
        cells.select("grid_id").join(packed, "grid_id", "left")
        .select("grid_id", "_radii", F.inline(plan))
        .select("grid_id", "target_idx", "pos", "n_steps", F.element_at("_radii", key).alias("radius"))
        .groupBy("grid_id", F.col("target_idx").alias("month_idx"))
        .agg(
            F.sqrt(F.sum(F.pow(weight * F.col("radius"), F.lit(2.0)))).alias("_rss"),
            F.count("radius").alias("steps_found"),
            F.max("n_steps").alias("n_steps"),
        )
        .withColumn("radius", F.when(F.col("steps_found") == F.col("n_steps"), F.col("_rss")))
        .drop("_rss")
    )


def by_cell(rows: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """``grid_id`` and a map of its rows, which a calendar bounds."""
    return rows.groupBy("grid_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), value.alias("v")))).alias(name))


def require_full_paths(radius: DataFrame) -> DataFrame:
    """Fail when a path lacks a step."""
    ok = F.when(F.col("steps_found") == F.col("n_steps"), F.lit(True)).otherwise(F.raise_error(F.lit("a path lacks a step radius")).cast("boolean"))
    return radius.where(ok)


def observed_month_radius(cells: DataFrame, n_months: int, radius: DataFrame, obs: DataFrame, one_step: DataFrame, h: int) -> DataFrame:
    """Dense radius per (cell, month).

    Observed months take the one-step radius of horizon ``h`` (0 before month
    h), other months that of their path, and months outside all paths 0.
    """
    month = F.col("month_idx").cast("int")
    planned = by_cell(radius, month, F.struct("radius"), "_planned")
    once = by_cell(one_step.where(F.col("h") == h), (F.col("start_idx") + h).cast("int"), F.col("radius"), "_one")
    seen = obs.groupBy("grid_id").agg(F.collect_list(month).alias("_seen"))
    packed = cells.select("grid_id").join(planned, "grid_id", "left").join(once, "grid_id", "left").join(seen, "grid_id", "left")
    m = F.col("month_idx")
    single = F.when(m < h, F.lit(0.0)).otherwise(F.element_at("_one", m))
    at = F.element_at("_planned", m)
    path = F.when(at.isNotNull(), at["radius"]).otherwise(F.lit(0.0))
    return packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("month_idx")).select(
        "grid_id", "month_idx", F.when(F.array_contains("_seen", m), single).otherwise(path).alias("radius")
    )
