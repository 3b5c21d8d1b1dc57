"""Panel-shaped tables derived from the given star-schema tables.

Each method mirrors one named block of :mod:`gridloom.plans.sqlbase`.  Values
are built from exact integer sums (cents), so both engines start from identical
doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import calendar as cal
from gridloom.session import written

FIRST_ORD = 12 * 1995 + 1
N_MONTHS = 84
HORIZONS = (1, 3, 6)
SEEDS = (11, 22, 33, 44, 55)
DEPTHS = tuple(2.5 + 5.0 * i for i in range(64))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def month_idx_of(ts: str) -> Column:
    return (cal.month_ord(F.col(ts)) - FIRST_ORD).cast("int")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}
        self.made: dict[str, object] = {}  # fitted models of a few rows

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage table: written once to the shared folder, read by later steps."""
        if name not in self._stages:
            self._stages[name] = written(build(), name)
        return self._stages[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def calendar(self) -> DataFrame:
        o = F.col("id").cast("int") + FIRST_ORD
        return self.spark.range(N_MONTHS, numPartitions=1).select(*cal.calendar_columns(o, FIRST_ORD))

    @staticmethod
    def _grid(df: DataFrame, key: str, width: int, *extra: Column) -> DataFrame:
        row = F.floor(F.col(key) / width).cast("int")
        col = F.pmod(F.col(key), F.lit(width)).cast("int")
        return df.select(
            F.col(key).alias("grid_id"),
            row.alias("grid_row"),
            col.alias("grid_col"),
            (row.cast("long") * 100000 + col).alias("cell_id"),
            (col * F.lit(1000.0)).alias("x"),
            (row * F.lit(1000.0)).alias("y"),
            *extra,
        )

    @cached_property
    def cells(self) -> DataFrame:
        return self._grid(self.raw("customer"), "c_custkey", 32)

    @cached_property
    def cells_small(self) -> DataFrame:
        return self._grid(self.raw("supplier"), "s_suppkey", 10)

    @cached_property
    def baseline(self) -> DataFrame:
        """Long-term level per cell with the provenance of its value."""
        k = F.pmod(F.col("c_nationkey"), F.lit(4))
        return self.raw("customer").select(
            F.col("c_custkey").alias("grid_id"),
            (F.floor(F.col("c_custkey") / 32) * 100000 + F.pmod(F.col("c_custkey"), F.lit(32))).alias("cell_id"),
            (cents("c_acctbal") / F.lit(123456.7)).alias("base_wtd"),
            F.when(k == 0, "direct").when(k == 1, "linear").when(k == 2, "nearest").otherwise("unknown")
            .alias("fill_source"),
            F.col("c_nationkey").cast("double").alias("n_points"),
        )

    @cached_property
    def connectivity(self) -> DataFrame:
        """Class in -3..3; 0 stands for a missing class."""
        c = (F.pmod(F.col("c_nationkey"), F.lit(7)) - 3).cast("int")
        return self.raw("customer").select(
            F.col("c_custkey").alias("grid_id"), F.when(c != 0, c).alias("cls")
        )

    # -- facts --------------------------------------------------------------
    @cached_property
    def obs(self) -> DataFrame:
        """Sparse observations, one row per (cell, month) with orders."""
        o = self.raw("orders").select(
            F.col("o_custkey").alias("grid_id"),
            month_idx_of("o_orderdate").alias("month_idx"),
            F.dayofmonth("o_orderdate").alias("_day"),
            "o_orderpriority",
            cents("o_totalprice").alias("_c"),
        )
        return o.groupBy("grid_id", "month_idx").agg(
            (F.sum("_c").cast("double") / F.count(F.lit(1)).cast("double") / F.lit(9876543.21)).alias("wtd"),
            # a month has at most 31 days, so a bit set replaces a distinct
            F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_day")))).cast("int").alias("n_days"),
            F.count_distinct("o_orderpriority").cast("int").alias("n_sites"),
            F.count(F.lit(1)).cast("int").alias("n_site_days"),
        )

    @property
    def stored_obs(self) -> DataFrame:
        """The observations as a stage table, for plans that read them several times."""
        return self.stage("obs", lambda: self.obs)

    @cached_property
    def panel(self) -> DataFrame:
        """Nearly dense monthly panel on the small grid (gaps are absent rows)."""
        li = self.raw("lineitem").select(
            F.col("l_suppkey").alias("grid_id"),
            month_idx_of("l_shipdate").alias("month_idx"),
            cents("l_extendedprice").alias("_c"),
        )
        return li.groupBy("grid_id", "month_idx").agg(
            (F.sum("_c").cast("double") / F.count(F.lit(1)).cast("double") / F.lit(987654.321)).alias("wtd")
        )

    @cached_property
    def dense_panel(self) -> DataFrame:
        from gridloom.operators.joins import densify

        return densify(self.cells_small.select("grid_id"), self.panel, N_MONTHS)

    @cached_property
    def forcing_sparse(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("grid_id"))
        li = self.raw("lineitem").select(
            "l_orderkey",
            month_idx_of("l_shipdate").alias("month_idx"),
            F.col("l_quantity").cast("long").alias("_q"),
            cents("l_extendedprice").alias("_c"),
        )
        return (
            li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("grid_id", "month_idx")
            .agg(
                (F.sum("_q").cast("double") / F.lit(7.3)).alias("infiltration"),
                (F.sum("_c").cast("double") / F.lit(12345678.9)).alias("pumping"),
            )
            .where(F.col("month_idx").between(0, N_MONTHS - 1))
        )

    @cached_property
    def forcing_months(self) -> DataFrame:
        """Dense forcing as one array per cell; a month without data is zero."""
        from gridloom.operators.joins import pack_months

        return pack_months(self.cells, self.forcing_sparse, ["infiltration", "pumping"], N_MONTHS)

    @cached_property
    def forcing(self) -> DataFrame:
        """Dense forcing; a month without data is zero."""
        return self.forcing_months.select("grid_id", F.inline("months"))

    @cached_property
    def daily(self) -> DataFrame:
        """Daily sums per user, shifted so that they span two calendar months."""
        e = self.raw("events").select(
            F.col("user_id").alias("grid_id"), F.date_add(F.to_date("ts"), 17).alias("day"), cents("value").alias("_c")
        )
        return e.groupBy("grid_id", "day").agg((F.sum("_c").cast("double") / F.lit(73.1)).alias("inches"))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("grid_id"), F.col("embedding").cast("array<double>").alias("values")
        )

    @cached_property
    def profile_layers(self) -> DataFrame:
        """Long layers; every 13th (cell + layer) is a missing reading."""
        return self.profiles.select("grid_id", F.posexplode("values").alias("layer", "v")).select(
            "grid_id",
            "layer",
            (F.lit(2.5) + F.lit(5.0) * F.col("layer")).alias("depth_m"),
            F.when(F.pmod(F.col("grid_id") + F.col("layer"), F.lit(13)) != 0, F.col("v")).alias("value"),
        )

    # -- samples and predictions -------------------------------------------
    @cached_property
    def pairs(self) -> DataFrame:
        from gridloom.operators.samples import horizon_pairs

        return self.keyed(horizon_pairs(self.stored_obs, HORIZONS, ["wtd", "n_days", "n_sites", "n_site_days"]))

    @staticmethod
    def keyed(pairs: DataFrame) -> DataFrame:
        """Pairs of a start and a target month with their key and split."""
        from gridloom.functions.scalars import split_by_ord

        target_ord = F.col("target_idx") + FIRST_ORD
        return pairs.withColumn(
            "sample_key", (F.col("grid_id") * 1000 + F.col("start_idx")) * 10 + F.col("h")
        ).withColumn("split", split_by_ord(target_ord, TRAIN_END, VALIDATION, TEST))

    @cached_property
    def predictions(self) -> DataFrame:
        """Five seeded members per sample (deterministic arithmetic)."""
        noise = F.pmod(F.col("sample_key") * 7919 + F.col("seed") * 104729, F.lit(1000)) - 500
        return (
            self.pairs.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
            .withColumn("y_true", F.col("delta_h"))
            .withColumn("y_pred", F.col("delta_h") * F.lit(0.8) + noise / F.lit(2531.7))
        )

    @cached_property
    def ensemble(self) -> DataFrame:
        from gridloom.operators.aggregates import ensemble_summary

        return ensemble_summary(
            self.predictions, ["sample_key", "grid_id", "start_idx", "target_idx", "h", "split", "y_true"], len(SEEDS)
        )


TRAIN_END = 12 * 1998 + 12
VALIDATION = (12 * 1999 + 1, 12 * 1999 + 12)
TEST = (12 * 2000 + 1, 12 * 2001 + 12)
