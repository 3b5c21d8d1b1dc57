"""Readers that turn files and gridded tables into long panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.calendar import month_ord


def read_panel_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    rename: Mapping[str, str],
    keep: Sequence[str],
    date: str = "month_start",
) -> DataFrame:
    """CSV panel with a declared schema; only ``keep`` columns are parsed out.

    Rows are not globally sorted: a panel is keyed, and a consumer that needs an
    order asks for it (:func:`ordered`).
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    df = df.withColumnsRenamed(dict(rename))
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise KeyError(f"{path} lacks columns {missing}")
    return df.select(*keep).withColumn(date, F.to_date(date)).withColumn("month_ord", month_ord(F.col(date)))


def read_cells(
    spark: SparkSession, path: str, schema: StructType | str, rename: Mapping[str, str], keep: Sequence[str]
) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.withColumnsRenamed(dict(rename)).select(*keep)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deterministic total order: a range-partitioned sort."""
    return df.orderBy(*keys)


def missing_to_null(value: Column, nodata: float) -> Column:
    """Sentinel and NaN become NULL at the scan, before any aggregate sees them."""
    return F.when((value != F.lit(nodata)) & ~F.isnan(value), value)


def pixels_to_cells(pixels: DataFrame, cells: DataFrame, height: int | Column, nodata: float) -> DataFrame:
    """Sample north-up raster pixels at south-up grid cells (every band)."""
    h = height if isinstance(height, Column) else F.lit(height)
    located = pixels.select(
        "band",
        (h - 1 - F.col("src_row")).cast("int").alias("grid_row"),
        F.col("src_col").alias("grid_col"),
        missing_to_null(F.col("value"), nodata).alias("value"),
    )
    return cells.select("grid_id", "grid_row", "grid_col").join(located, ["grid_row", "grid_col"]).select(
        "grid_id", "band", "value"
    )


def scan_named_files(spark: SparkSession, path: str, schema: str, pattern: str, fmt: str = "parquet") -> DataFrame:
    """Multi-file scan whose month (and variant) live in the file path.

    ``pattern`` has groups (variant, year, month abbreviation); paths that do
    not match are skipped.
    """
    p = F.col("_metadata.file_path")
    raw = spark.read.schema(schema).format(fmt).option("recursiveFileLookup", True).load(path)
    stamp = F.concat_ws(" ", F.regexp_extract(p, pattern, 2), F.initcap(F.regexp_extract(p, pattern, 3)), F.lit("1"))
    return (
        raw.withColumn("variant", F.regexp_extract(p, pattern, 1))
        .withColumn("_stamp", stamp)
        .where(F.col("variant") != "")
        .withColumn("month_start", F.to_date("_stamp", "yyyy MMM d"))
        .drop("_stamp")
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def long_to_wide(df: DataFrame, ids: Sequence[str], name: str, values: Sequence, value: str) -> DataFrame:
    """Pivot over a declared (bounded) list of names: one aggregation."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(F.first(value))


def read_depth_levels(df: DataFrame, json_column: str, ids: Sequence[str], expected: int) -> DataFrame:
    """JSON array of levels -> one row per layer; a wrong layer count fails."""
    levels = F.from_json(json_column, "array<double>")
    checked = F.when(F.size(levels) == expected, levels).otherwise(
        F.raise_error(F.lit(f"expected {expected} levels")).cast("array<double>")
    )
    return df.select(*ids, F.posexplode(checked).alias("layer", "level"))


def gridded_series_subset(
    series: DataFrame,
    picks: DataFrame,
    base_date: str,
    days: tuple[int, int],
    lat: tuple[float, float],
    lon: tuple[float, float],
) -> DataFrame:
    """Time and bounding-box slice (pushed to the scan), then listed cells only."""
    return (
        series.where(
            F.col("days_since").between(*days) & F.col("lat").between(*lat) & F.col("lon").between(*lon)
        )
        .join(picks.select("lat_idx", "lon_idx"), ["lat_idx", "lon_idx"], "left_semi")
        .withColumn("date", F.date_add(F.lit(base_date).cast("date"), F.col("days_since")))
    )
