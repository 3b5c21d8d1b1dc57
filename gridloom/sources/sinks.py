"""Writers: partitioned samples, panel outputs, release product, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_partitioned_samples(samples: DataFrame, path: str, tests: Sequence[str] = ("test_temporal", "test_spatial")) -> dict[str, DataFrame]:
    """One folder per split; the combined test table is a pruned read of it."""
    samples.write.mode("errorifexists").partitionBy("split").parquet(path)
    stored = samples.sparkSession.read.schema(samples.schema).parquet(path)
    splits = {"all": stored, "test": stored.where(F.col("split").isin(*tests))}
    return splits


def write_named_files(df: DataFrame, path: str, file: str, spread_by: Sequence[str], rows_per_file: int = 5_000_000) -> None:
    """One folder per name in ``file``; a name with many rows is written by many tasks.

    Names are counted first (map-side combined).  Rows of a name are dealt by a
    hash of ``spread_by`` over as many parts as its count asks for, so neither a
    task nor a file grows with a hot name.
    """
    parts = df.groupBy(file).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_parts"))
    named = df.withColumnRenamed(file, "_file").join(parts, F.col("_file").eqNullSafe(parts[file]))
    (
        named.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.col("_parts")))
        .repartition(file, "_part")
        .drop("_file", "_parts", "_part")
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy(file)
        .parquet(path)
    )


def month_index(calendar: DataFrame, anchors: DataFrame, obs: DataFrame) -> DataFrame:
    """Month table with anchor flag, interval id and observation count.

    An interval is numbered by the anchors at or before its first month; the
    last anchor closes the last interval.
    """
    counts = obs.groupBy("month_idx").agg(F.count(F.lit(1)).alias("direct_observation_count"))
    marks = anchors.agg(F.sort_array(F.collect_list("month_idx")).alias("a")).scalar()
    before = F.size(F.filter("_a", lambda a: a < F.col("month_idx")))
    return (
        calendar.select("month_idx", "month_label")
        .withColumn("_a", marks)
        .join(counts, "month_idx", "left")
        .select(
            "month_idx",
            "month_label",
            F.array_contains("_a", F.col("month_idx")).cast("int").alias("is_anchor_month"),
            F.when(F.col("month_idx") > F.array_max("_a"), F.lit(-1))
            .otherwise(F.greatest(before - 1, F.lit(0)))
            .alias("interval_id"),
            F.coalesce("direct_observation_count", F.lit(0)).alias("direct_observation_count"),
        )
    )


def save_panel_outputs(
    path: str, panel: DataFrame, cells: DataFrame, months: DataFrame, segments: DataFrame
) -> dict[str, str]:
    """Four tables: panel (by year, clustered by cell), cells, months, segments."""
    out = {n: f"{path}/{n}" for n in ("panel", "cell_lookup", "month_index", "segment_summary")}
    write_panel(panel, out["panel"])
    cells.write.parquet(out["cell_lookup"])
    months.write.parquet(out["month_index"])
    segments.write.parquet(out["segment_summary"])
    return out


def publish(path: str, tables: Mapping[str, DataFrame], check: Callable[[Mapping[str, DataFrame]], None], panel: str = "panel") -> None:
    """Write tables together or not at all.

    All of them go to a fresh folder below ``path`` and are read from there by
    ``check``, which raises if they must not be released.  Only then a list of
    the tables is written, and :func:`published` knows no other tables than
    those on the list: a run that fails leaves what was there before.
    """
    spark = tables[panel].sparkSession
    folder = f"{path}/run-{uuid.uuid4().hex}"
    for name, df in tables.items():
        if name == panel:
            write_panel(df, f"{folder}/{name}")
        else:
            df.write.parquet(f"{folder}/{name}")
    stored = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    check(stored)
    entries = [(name, f"{folder}/{name}", df.schema.json(), stored[name].count()) for name, df in tables.items()]
    listed = spark.createDataFrame(entries, "name string, folder string, columns string, n_rows long")
    listed.coalesce(1).write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last complete :func:`publish`, each with the number of rows it was released with."""
    listed = spark.read.parquet(f"{path}/published").select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    last = listed.agg(F.max(F.struct("at", "file")).alias("m")).first()["m"]
    rows = listed.where((F.col("at") == F.lit(last["at"])) & (F.col("file") == F.lit(last["file"]))).collect()  # one per table
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["columns"]))).parquet(r["folder"]) for r in rows}


def require_dense(panel: DataFrame, cells: DataFrame, months: DataFrame) -> None:
    """Raise unless the panel has one finite value for every cell and month."""
    if "radius" not in panel.columns:
        panel = panel.withColumn("radius", F.lit(0.0))
    found = release_violations(panel, cells.count(), months.count()).first().asDict()
    found.pop("n_rows"), found.pop("n_cells")
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise ValueError(f"the panel cannot be released: {wrong}")


def write_panel(panel: DataFrame, path: str, cell_block: int = 4096) -> None:
    """Year partitions, files ordered by blocks of 12 months x ``cell_block`` cells."""
    block = F.floor(F.col("grid_id") / cell_block)
    (
        panel.withColumn("_block", block)
        .repartitionByRange("year", "_block")
        .sortWithinPartitions("year", "_block", "month_idx", "grid_id")
        .drop("_block")
        .write.partitionBy("year")
        .parquet(path)
    )


def release_violations(panel: DataFrame, n_cells: Column | int, n_months: Column | int) -> DataFrame:
    """One pass over the panel: shape, finiteness and sign checks as counts."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    per_cell = panel.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~finite("wtd")).alias("bad_value"),
        F.count_if(~finite("radius")).alias("bad_radius"),
        F.count_if(F.col("radius") < 0).alias("negative_radius"),
    )
    return per_cell.agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("rows") != as_col(n_months)).alias("cells_with_wrong_month_count"),
        (as_col(n_cells) - F.count(F.lit(1))).alias("missing_cells"),
        F.sum("bad_value").alias("nonfinite_values"),
        F.sum("bad_radius").alias("nonfinite_radii"),
        F.sum("negative_radius").alias("negative_radii"),
    )


def release_product(panel: DataFrame, cells: DataFrame, months: DataFrame, required: Sequence[str] = ("grid_id", "month_idx", "wtd", "radius")) -> DataFrame:
    """Self-describing table: value, radius, month label, cell position.

    A row whose month or cell is not known is an error, as is an invalid value.
    """
    missing = [c for c in required if c not in panel.columns]
    if missing:
        raise KeyError(f"panel lacks {missing}")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in ("wtd", "radius")]) | (F.col("radius") < 0)
    guarded = F.when(bad, F.raise_error(F.lit("invalid value in release")).cast("double")).otherwise(F.col("wtd"))
    stray = lambda flag, what: F.when(F.col(flag).isNull(), F.raise_error(F.lit(f"{what} of the panel is not known")).cast("double"))
    return (
        panel.withColumn("wtd", guarded)
        .join(F.broadcast(months.select("month_idx", "month_label", "year", F.lit(True).alias("_month"))), "month_idx", "left")
        .join(cells.withColumn("_cell", F.lit(True)), "grid_id", "left")
        .withColumn("wtd", F.coalesce(stray("_month", "a month"), stray("_cell", "a cell"), "wtd"))
        .select(
            "grid_id", "month_idx", "month_label", "year", "x", "y", "lon", "lat", "wtd", "radius",
            (F.col("wtd") - F.col("radius")).alias("lower"), (F.col("wtd") + F.col("radius")).alias("upper"),
        )
    )


def content_manifest(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Order-free digest per partition: xor and sum of row digests plus a count.

    A row's digest is the start of the MD5 of its columns, joined by ``|``;
    fractions count in millionths, so any engine can repeat it.  The sum guards
    against pairs of equal rows cancelling in the xor.
    """
    kinds = dict(df.dtypes)
    whole = [F.floor(F.col(c) * 1e6 + 0.5) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    line = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in whole])
    h = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return df.groupBy(by).agg(F.bit_xor(h).alias("xor_digest"), F.sum(h).alias("sum_digest"), F.count(F.lit(1)).alias("n_rows"))


def summary_sidecar(samples: DataFrame, by: str) -> DataFrame:
    """Counts per split as a JSON document per row."""
    agg = samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start_idx").alias("first_start"),
        F.max("target_idx").alias("last_target"),
    )
    return agg.select(by, "n", F.to_json(F.struct(by, "n", "first_start", "last_target")).alias("document"))


def write_samples_with_sidecar(samples: DataFrame, path: str, splits: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Write the rows that have a split; one document per split, counted by the write itself.

    Rows without a split are omitted and counted as such.  The counts are
    metrics observed while the rows pass to the files, so nothing is read twice.
    A split that is not listed, or a feature that is not there, is an error.
    """
    missing = [c for c in features if c not in samples.columns]
    if missing:
        raise KeyError(f"samples lack {missing}")
    seen = Observation()
    named = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    stray = F.count_if(F.col("split").isNotNull() & ~F.col("split").isin(*splits))
    (
        samples.observe(seen, *named, F.count_if(F.col("split").isNull()).alias("_omitted"), stray.alias("_stray"))
        .where(F.col("split").isNotNull())
        .write.partitionBy("split")
        .parquet(path)
    )
    counts = seen.get
    if counts["_stray"]:
        raise ValueError(f"{counts['_stray']} rows have a split that is not one of {list(splits)}")
    rows = [(s, counts[s], counts["_omitted"], list(features)) for s in splits]
    table = samples.sparkSession.createDataFrame(rows, "split string, n long, omitted long, features array<string>")
    return table.withColumn("document", F.to_json(F.struct("split", "n", "omitted", "features")))
