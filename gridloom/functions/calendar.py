"""Month arithmetic as column expressions.

``month_ord = 12 * year + month`` is the arithmetic key, ``month_idx`` the
0-based join key relative to the first month of a calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_ord(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def month_start_of(ordinal: Column) -> Column:
    """Inverse of :func:`month_ord`; month 0 of a year is December before it."""
    zero = ordinal - 1
    return F.make_date(F.floor(zero / 12).cast("int"), (F.pmod(zero, F.lit(12)) + 1).cast("int"), F.lit(1))


def shift_months(month_start: Column, n: Column | int) -> Column:
    return F.add_months(F.trunc(month_start, "month"), n)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def label_of_ord(ordinal: Column) -> Column:
    zero = ordinal - 1
    year = F.floor(zero / 12).cast("string")
    month = F.lpad((F.pmod(zero, F.lit(12)) + 1).cast("int").cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), month)


def month_cycle(month: Column, enabled: bool = True) -> tuple[Column, Column]:
    """Sine and cosine of the calendar month; (0, 1) when switched off."""
    if not enabled:
        return F.lit(0.0), F.lit(1.0)
    angle = F.lit(2.0 * math.pi) * (month - 1) / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def calendar_columns(ordinal: Column, first_ord: Column | int) -> list[Column]:
    return [
        ordinal.cast("int").alias("month_ord"),
        (ordinal - first_ord).cast("int").alias("month_idx"),
        month_start_of(ordinal).alias("month_start"),
        label_of_ord(ordinal).alias("month_label"),
        F.floor((ordinal - 1) / 12).cast("int").alias("year"),
        (F.pmod(ordinal - 1, F.lit(12)) + 1).cast("int").alias("month"),
    ]


def month_calendar(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per month between two date columns of a one-row table."""
    lo, hi = month_ord(F.col(first)), month_ord(F.col(last))
    return bounds.select(lo.alias("_lo"), F.explode(F.sequence(lo, hi)).alias("_o")).select(
        *calendar_columns(F.col("_o"), F.col("_lo"))
    )


def observed_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Calendar spanning the first to the last month present in ``df``."""
    return month_calendar(df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")), "_a", "_b")
