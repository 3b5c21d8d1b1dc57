"""Query registry: one entry pairs a Spark plan with its SQL twin.

The column spec (``"grid_id:i wtd:f"``) is the output contract.  It is applied
to both sides, so the two engines return the same names, types and rounding:
``i`` integer, ``f`` double rounded to 6 decimals (``f3`` to 3), ``s`` string,
``b`` boolean.  Rounding is ``floor(x * 10^d + 0.5) / 10^d`` on both engines
because their ``round`` functions treat ties differently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[_spark_column(c, k) for c, k in parse_spec(self.spec)])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_column(c, k) for c, k in parse_spec(self.spec))
        return f"SELECT {cols} FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]  # type: ignore[misc]


def _digits(kind: str) -> int:
    return int(kind[1:]) if len(kind) > 1 else 6


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    d = F.lit(float(10 ** _digits(kind)))
    c = c.cast("double")
    rounded = F.floor(c * d + F.lit(0.5)).cast("double") / d
    return F.when(F.isnan(c), F.lit(None)).otherwise(rounded).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    d = f"1e{_digits(kind)}"
    x = f"CAST({name} AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL ELSE floor({x} * {d} + 0.5) / {d} END AS {name}"


def query(name: str, spec: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, spec, fn, sql)
        return fn

    return wrap
