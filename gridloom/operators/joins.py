"""Joins over cells, months and regular grids.

Range-shaped joins are rewritten as equi joins on a bucket, an offset or a
shifted key, so none of them plans as a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(cells: DataFrame, facts: DataFrame, n_months: int, key: str = "grid_id") -> DataFrame:
    """Every cell x every month, facts attached.

    Months come from a literal sequence per cell, so there is no cross join and
    the cell table keeps its partitioning.
    """
    grid = cells.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("month_idx"))
    return grid.join(facts, [key, "month_idx"], "left")


def with_calendar(facts: DataFrame, calendar: DataFrame, on: str = "month_label") -> DataFrame:
    """Attach calendar columns; the calendar has one row per month."""
    return facts.join(F.broadcast(calendar), on, "left")


def with_static(
    cells: DataFrame, attributes: DataFrame, columns: Sequence[str], id_name: str | None = None
) -> DataFrame:
    """Cell <- static attributes; a missing value takes the column mean."""
    if id_name:
        attributes = attributes.withColumnRenamed(id_name, "grid_id")
    missing = [c for c in ["grid_id", *columns] if c not in attributes.columns]
    if missing:
        raise KeyError(f"attribute table lacks columns {missing}")
    joined = cells.join(attributes.select("grid_id", *columns), "grid_id", "left")
    means = joined.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_m"))
    return joined.withColumn("_m", means.scalar()).select(
        *[c for c in joined.columns if c not in columns],
        *[F.coalesce(F.col(c), F.col("_m").getField(c)).alias(c) for c in columns],
    )


def with_full_coverage(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left join that fails the job when a left row finds no value."""
    hole = F.raise_error(F.concat(F.lit(f"no {value} for "), *[F.col(k).cast("string") for k in on]))
    return left.join(right, list(on), "left").withColumn(
        value, F.when(F.col(value).isNull(), hole.cast("double")).otherwise(F.col(value))
    )


def in_domain(facts: DataFrame, *domains: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Keep facts whose keys occur in every domain table."""
    return reduce(lambda d, dom: d.join(dom[0].select(*dom[1]).distinct(), list(dom[1]), "left_semi"), domains, facts)


def forward_sums(panel: DataFrame, columns: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Sums over (t, t+H] per start month and horizon of a dense panel.

    A cell has one row per month, so the window partition is calendar bounded.
    Windows reaching past the last month are dropped.
    """
    per_cell = Window.partitionBy("grid_id").orderBy("month_idx")
    wide = panel.select(
        "grid_id",
        F.col("month_idx").alias("start_idx"),
        *[
            F.struct(
                F.lit(h).alias("h"),
                F.count(F.lit(1)).over(per_cell.rowsBetween(1, h)).alias("_rows"),
                *[F.sum(c).over(per_cell.rowsBetween(1, h)).alias(f"sum_{c}") for c in columns],
                *[F.count(c).over(per_cell.rowsBetween(1, h)).alias(f"n_{c}") for c in columns],
            ).alias(f"_h{h}")
            for h in horizons
        ],
    )
    return (
        wide.select("grid_id", "start_idx", F.explode(F.array(*[f"_h{h}" for h in horizons])).alias("_s"))
        .select("grid_id", "start_idx", "_s.*")
        .where(F.col("_rows") == F.col("h"))
        .drop("_rows")
    )


def forward_sequences(
    panel: DataFrame, columns: Sequence[str], horizons: Sequence[int], pad: float = 0.0
) -> DataFrame:
    """The H following monthly vectors, zero padded to the longest horizon."""
    longest = max(horizons)
    per_cell = Window.partitionBy("grid_id").orderBy("month_idx")
    step = F.struct(*[F.col(c) for c in columns])
    empty = F.struct(*[F.lit(pad).alias(c) for c in columns])
    ahead = panel.select(
        "grid_id",
        F.col("month_idx").alias("start_idx"),
        F.collect_list(step).over(per_cell.rowsBetween(1, longest)).alias("_ahead"),
    )
    # exploded after the window: a generator in the same projection would run first
    by_horizon = ahead.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).where(
        F.size("_ahead") >= F.col("h")
    )
    return by_horizon.select(
        "grid_id",
        "start_idx",
        "h",
        F.concat(F.slice("_ahead", 1, F.col("h")), F.array_repeat(empty, F.lit(longest) - F.col("h"))).alias("sequence"),
        F.col("h").alias("sequence_length"),
    )


def pack_months(cells: DataFrame, facts: DataFrame, columns: Sequence[str], n_months: int, key: str = "grid_id") -> DataFrame:
    """``key, months``: per cell a dense array ``(month_idx, columns)``, zero where a month or a value is missing.

    An array is calendar bounded, and what is exploded from it stays where the
    cell is: steps ahead need neither another shuffle nor a window.
    """
    given = F.struct(F.col("month_idx").cast("int").alias("month_idx"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    packed = facts.where(F.col("month_idx").between(0, n_months - 1)).groupBy(key).agg(F.collect_list(given).alias("_given"))
    months = F.sequence(F.lit(0), F.lit(n_months - 1))
    zero = lambda m: F.struct(m.alias("month_idx"), *[F.lit(0.0).alias(c) for c in columns])
    rest = F.transform(F.array_except(months, F.col("_given")["month_idx"]), zero)
    dense = F.when(F.col("_given").isNull(), F.transform(months, zero)).otherwise(F.array_sort(F.concat("_given", rest)))
    return cells.select(key).join(packed, key, "left").select(key, dense.alias("months"))


def inside_months(n_months: int) -> Column:
    """Starts whose window ends inside the calendar, for rows joined with :func:`pack_months`."""
    return (F.col("start_idx") >= 0) & (F.col("start_idx") + F.col("h") < n_months)


def packed_sum(column: str, horizons: Sequence[int]) -> Column:
    """Sum over (start, start + h] of a packed panel, added in month order."""

    def total(h: int) -> Column:
        out = F.lit(0.0)
        for k in range(1, h + 1):
            out = out + F.get("months", F.col("start_idx") + k)[column]
        return out

    return F.coalesce(*[F.when(F.col("h") == h, total(h)) for h in horizons])


def packed_sequence(columns: Sequence[str], longest: int, pad: float = 0.0) -> Column:
    """The ``h`` following vectors of a packed panel, padded to the longest horizon."""
    empty = F.struct(*[F.lit(pad).alias(c) for c in columns])
    ahead = [F.get("months", F.col("start_idx") + k) for k in range(1, longest + 1)]
    return F.array(*[F.when(F.col("h") >= k, F.struct(*[m[c].alias(c) for c in columns])).otherwise(empty) for k, m in enumerate(ahead, start=1)])


def interval_join(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, width: Column) -> DataFrame:
    """Match ``lo < value <= hi`` through buckets of ``width`` (an equi join)."""
    spread = intervals.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    return (
        points.withColumn("_b", F.floor(F.col(value) / width))
        .join(spread, "_b")
        .where((F.col(value) > F.col(lo)) & (F.col(value) <= F.col(hi)))
        .drop("_b")
    )


def nearest_on_axis(points: DataFrame, value: str, axis: DataFrame, coord: str, index: str) -> DataFrame:
    """Nearest axis coordinate per point: clamped at the ends, ties to the lower.

    Each axis entry owns the interval between the midpoints to its neighbours.
    ``axis`` is grid metadata (one row per coordinate); the points are matched by
    distinct coordinate value, so repeated coordinates are looked up once.
    """
    along = Window.orderBy(coord)
    mid_lo = (F.lag(coord).over(along) + F.col(coord)) / 2
    mid_hi = (F.lead(coord).over(along) + F.col(coord)) / 2
    step = axis.agg(
        F.greatest((F.max(coord) - F.min(coord)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1)), F.lit(1e-9))
    ).scalar()
    # points beyond the axis are looked up at its end, so no interval leaves it
    owned = axis.select(coord, index, mid_lo.alias("_lo"), mid_hi.alias("_hi")).withColumns(
        {"_lo": F.coalesce("_lo", F.col(coord) - step), "_hi": F.coalesce("_hi", F.col(coord))}
    )
    ends = axis.agg(F.struct(F.min(coord).alias("lo"), F.max(coord).alias("hi"))).scalar()
    clamped = points.withColumn("_e", ends).withColumn("_at", F.least(F.greatest(F.col(value), F.col("_e.lo")), F.col("_e.hi"))).drop("_e")
    distinct = clamped.select("_at").distinct()
    found = interval_join(distinct, "_at", owned, "_lo", "_hi", step).drop("_lo", "_hi")
    return clamped.join(found, "_at", "left").drop("_at")


def bracket_asof(queries: DataFrame, facts: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Previous and next fact around each query time (facts at the time count as both).

    Union plus two running windows per cell, one in falling order: linear in the
    rows, no range join.  The key goes through the union as a struct: if both sides
    come dealt by it, Spark 4.1 takes their union for dealt as well (and drops a
    repartition), but may put the parts side by side, so that rows do not meet.
    """
    payload = F.struct(F.col(time).alias("t"), *[F.col(c) for c in columns])
    whole = F.struct(F.col(key)).alias("_k")
    both = facts.select(whole, time, payload.alias("_f"), F.lit(0).alias("_q")).unionByName(
        queries.select(whole, time).withColumn("_q", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy("_k").orderBy(time)
    back = Window.partitionBy("_k").orderBy(F.col(time).desc())
    marked = both.select(
        F.col("_k")[key].alias(key),
        time,
        "_q",
        F.last("_f", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("prev"),
        F.last("_f", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0)).alias("next"),
    )
    return marked.where("_q = 1").drop("_q")


def alignment_report(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """One row: keys only left, only right, and rows whose values differ by more than ``tol``."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    differs = reduce(
        lambda x, y: x | y,
        [
            ~F.coalesce(
                F.abs(F.col(f"_a.{v}") - F.col(f"_b.{v}")) <= tol, F.col(f"_a.{v}").isNull() & F.col(f"_b.{v}").isNull()
            )
            for v in values
        ],
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(both & differs).alias("value_mismatches"),
        F.count_if(both).alias("matched"),
    )


def spread_regional(cells: DataFrame, sensitivity: str, series: DataFrame, value: str) -> DataFrame:
    """Regional monthly series scaled by each cell's sensitivity.

    The series travels as one calendar-bounded array instead of a join.
    """
    months = series.agg(F.sort_array(F.collect_list(F.struct("month_idx", value))).alias("_s")).scalar()
    return cells.select("*", F.inline(months)).withColumn("contribution", F.col(sensitivity) * F.col(value))


def crosswalk_mean(values: DataFrame, weights: DataFrame, on: Sequence[str], by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of gridded values over a weight table, ignoring missing values."""
    from gridloom.operators.aggregates import weighted_mean

    return values.join(weights, list(on)).groupBy(*by).agg(weighted_mean(value, weight).alias(value))


def join_series(base: DataFrame, on: str, *series: DataFrame) -> DataFrame:
    """Chain of left joins of monthly series onto one month table."""
    return reduce(lambda d, s: d.join(s, on, "left"), series, base)
