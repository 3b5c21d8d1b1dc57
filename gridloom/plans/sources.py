"""Queries for scans, sinks and scalar functions (groups A and B)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar as cal
from gridloom.functions import scalars as sc
from gridloom.operators import joins, samples
from gridloom.operators.events import require_months
from gridloom.plans.registry import query
from gridloom.plans.sqlbase import with_blocks
from gridloom.plans.tables import FIRST_ORD, N_MONTHS, TEST, TRAIN_END, VALIDATION, Tables, month_idx_of
from gridloom.session import scratch_path
from gridloom.sources import scans, sinks


def month_start():
    return cal.month_start_of(F.col("month_idx") + FIRST_ORD)


# --- A: scans and sinks -------------------------------------------------------

@query(
    "a01_read_panel_csv",
    "grid_id:i month_start:s month_ord:i wtd_m:f n_days:i",
    with_blocks(
        "obs",
        """SELECT grid_id, make_date((month_idx + 23940) // 12, (month_idx + 23940) % 12 + 1, 1) AS month_start,
        month_idx + 23941 AS month_ord, wtd AS wtd_m, n_days FROM obs""",
    ),
)
def a01(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "panel_csv")
    t.obs.select(
        F.col("grid_id").alias("node_id"), month_start().cast("string").alias("month_start"), F.col("wtd").alias("mean_wtd_m"),
        "n_days", "n_sites",
    ).write.option("header", True).csv(path)
    return scans.read_panel_csv(
        t.spark, path, "node_id LONG, month_start STRING, mean_wtd_m DOUBLE, n_days INT, n_sites INT",
        {"node_id": "grid_id", "mean_wtd_m": "wtd_m"}, ["grid_id", "month_start", "wtd_m", "n_days"],
    )


@query(
    "a02_read_cells",
    "grid_id:i grid_row:i grid_col:i x:f y:f",
    with_blocks("cells", "SELECT * FROM cells"),
)
def a02(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cells_csv")
    t.cells.select(
        F.col("grid_id").alias("node_id"), "grid_row", "grid_col", F.col("x").alias("x_center"), F.col("y").alias("y_center")
    ).write.option("header", True).csv(path)
    return scans.read_cells(
        t.spark, path, "node_id LONG, grid_row INT, grid_col INT, x_center DOUBLE, y_center DOUBLE",
        {"node_id": "grid_id", "x_center": "x", "y_center": "y"}, ["grid_id", "grid_row", "grid_col", "x", "y"],
    )


@query(
    "a03_pixels_to_cells",
    "grid_id:i band:i value:f",
    with_blocks("obs", "SELECT grid_id, month_idx AS band, CASE WHEN month_idx % 7 <> 0 THEN wtd END AS value FROM obs"),
)
def a03(t: Tables) -> DataFrame:
    top = t.cells.agg(F.max("grid_row")).scalar()
    pixels = t.obs.join(t.cells, "grid_id").select(
        F.col("month_idx").alias("band"),
        (top - F.col("grid_row")).alias("src_row"),
        F.col("grid_col").alias("src_col"),
        F.when(F.col("month_idx") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("wtd")).alias("value"),
    )
    return scans.pixels_to_cells(pixels, t.cells, top + 1, -9999.0)


@query(
    "a04_scan_named_files",
    "variant:s grid_id:i month_start:s volume:f",
    with_blocks(
        "panel",
        """SELECT CAST(1 + month_idx % 2 AS VARCHAR) AS variant, grid_id,
        make_date((month_idx + 23940) // 12, (month_idx + 23940) % 12 + 1, 1) AS month_start, wtd AS volume
        FROM panel WHERE month_idx % 10 <> 9""",
    ),
)
def a04(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "named")
    stamp = F.date_format(month_start(), "yyyy_MMM")
    name = F.when(F.col("month_idx") % 10 == 9, F.concat(F.lit("notes_"), stamp)).otherwise(
        F.concat(F.lit("pump"), (1 + F.col("month_idx") % 2).cast("string"), F.lit("_1km_m3_"), stamp)
    )
    sinks.write_named_files(t.panel.select("grid_id", F.col("wtd").alias("volume"), name.alias("file")), path, "file", ["grid_id"])
    return scans.scan_named_files(
        t.spark, path, "grid_id LONG, volume DOUBLE", r"pump([12])_1km_m3_(\d{4})_([A-Za-z]{3})"
    )


@query(
    "a05_matrix_to_long",
    "grid_id:i year:i month:s wtd:f",
    with_blocks(
        "panel",
        """SELECT grid_id, (month_idx + 23940) // 12 AS year, CAST((month_idx + 23940) % 12 + 1 AS VARCHAR) AS month, wtd
        FROM panel""",
    ),
)
def a05(t: Tables) -> DataFrame:
    o = F.col("month_idx") + FIRST_ORD
    months = [str(m) for m in range(1, 13)]
    tall = t.panel.select(
        "grid_id", F.floor((o - 1) / 12).cast("int").alias("year"), (F.pmod(o - 1, F.lit(12)) + 1).cast("int").cast("string").alias("m"), "wtd"
    )
    wide = scans.long_to_wide(tall, ["grid_id", "year"], "m", months, "wtd")
    return scans.wide_to_long(wide, ["grid_id", "year"], months, "month", "wtd").where("wtd IS NOT NULL")


@query(
    "a06_read_depth_levels",
    "grid_id:i layer:i level:f",
    "SELECT vec_id AS grid_id, i AS layer, CAST(embedding[i + 1] AS DOUBLE) AS level FROM embeddings, range(64) t(i)",
)
def a06(t: Tables) -> DataFrame:
    docs = t.profiles.select("grid_id", F.to_json("values").alias("json"))
    return scans.read_depth_levels(docs, "json", ["grid_id"], 64)


@query(
    "a07_gridded_series_subset",
    "lat_idx:i lon_idx:i date:s value:f",
    with_blocks(
        "obs cells",
        """SELECT c.grid_row AS lat_idx, c.grid_col AS lon_idx, DATE '1995-01-01' + o.month_idx * 30 AS date, o.wtd AS value
        FROM obs o JOIN cells c USING (grid_id) JOIN customer ON c_custkey = o.grid_id
        WHERE o.month_idx * 30 BETWEEN 365 AND 2000 AND c.grid_row * 0.25 BETWEEN 1.0 AND 1e9
        AND c.grid_col * 0.25 BETWEEN 0.5 AND 7.0 AND c_mktsegment <> 'MACHINERY'""",
    ),
)
def a07(t: Tables) -> DataFrame:
    series = t.obs.join(t.cells, "grid_id").select(
        F.col("grid_row").alias("lat_idx"), F.col("grid_col").alias("lon_idx"),
        (F.col("grid_row") * F.lit(0.25)).alias("lat"), (F.col("grid_col") * F.lit(0.25)).alias("lon"),
        (F.col("month_idx") * 30).alias("days_since"), F.col("wtd").alias("value"),
    )
    picks = t.raw("customer").where(F.col("c_mktsegment") != "MACHINERY").join(
        t.cells, F.col("c_custkey") == F.col("grid_id")
    ).select(F.col("grid_row").alias("lat_idx"), F.col("grid_col").alias("lon_idx"))
    return scans.gridded_series_subset(series, picks, "1995-01-01", (365, 2000), (1.0, 1e9), (0.5, 7.0))


SPACE_TIME = """st AS MATERIALIZED (SELECT p.*, CASE WHEN grid_id % 5 = 4 THEN 'test_grid' WHEN grid_id % 11 <> 10 THEN 'train_grid' END AS grid_split,
  CASE split WHEN 'train' THEN 'train_years' WHEN 'validation' THEN 'validation_years' WHEN 'test' THEN 'test_years' END AS time_split
  FROM pairs p),
sst AS MATERIALIZED (SELECT * REPLACE (CASE WHEN grid_split = 'train_grid' AND time_split = 'train_years' THEN 'train'
  WHEN grid_split = 'train_grid' AND time_split = 'validation_years' THEN 'validation'
  WHEN grid_split = 'train_grid' AND time_split = 'test_years' THEN 'test_temporal'
  WHEN grid_split = 'test_grid' AND time_split = 'train_years' THEN 'test_spatial' END AS split) FROM st)"""


def space_time_samples(t: Tables) -> DataFrame:
    """Samples with cell/year splits; dropped combinations keep a NULL split."""
    g = F.col("grid_id")
    labelled = t.pairs.withColumns(
        {
            "grid_split": F.when(g % 5 == 4, F.lit("test_grid")).when(g % 11 != 10, F.lit("train_grid")),
            "time_split": F.when(F.col("split").isNotNull(), F.concat("split", F.lit("_years"))),
        }
    )
    split, case = sc.split_space_time(F.col("grid_split"), F.col("time_split"))
    return labelled.withColumns({"split": split, "eval_case": case})


def st_sql(body: str) -> str:
    return with_blocks("pairs", "").rstrip() + ",\n" + SPACE_TIME + "\n" + body


@query(
    "a08_partitioned_samples",
    "table_name:s split:s n:i delta_sum:f4",
    st_sql(
        """SELECT 'all' AS table_name, split, count(*) AS n, sum(delta_h) AS delta_sum FROM sst WHERE split IS NOT NULL GROUP BY split
        UNION ALL SELECT 'test', split, count(*), sum(delta_h) FROM sst WHERE split IN ('test_temporal', 'test_spatial') GROUP BY split"""
    ),
)
def a08(t: Tables) -> DataFrame:
    kept = space_time_samples(t).where("split IS NOT NULL").select("sample_key", "grid_id", "start_idx", "h", "delta_h", "split")
    stored = sinks.write_partitioned_samples(kept, scratch_path(t.spark, "samples"))
    parts = [
        df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_h").alias("delta_sum")).withColumn("table_name", F.lit(n))
        for n, df in stored.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "a10_panel_outputs",
    "month_idx:i month_label:s is_anchor_month:i interval_id:i direct_observation_count:i panel_rows:i",
    with_blocks(
        "calendar panel",
        """SELECT c.month_idx, c.month_label, CAST(c.month = 1 OR c.month_idx = 83 AS INTEGER) AS is_anchor_month,
        greatest((SELECT count(*) FROM calendar a WHERE (a.month = 1 OR a.month_idx = 83) AND a.month_idx < c.month_idx) - 1, 0) AS interval_id,
        coalesce(n, 0) AS direct_observation_count, coalesce(n, 0) AS panel_rows FROM calendar c
        LEFT JOIN (SELECT month_idx, count(*) AS n FROM panel GROUP BY 1) USING (month_idx)""",
    ),
)
def a10(t: Tables) -> DataFrame:
    from gridloom.operators.anchors import anchor_months

    anchors = anchor_months(t.calendar)
    months = sinks.month_index(t.calendar, anchors, t.panel)
    panel = t.panel.join(F.broadcast(t.calendar.select("month_idx", "year")), "month_idx")
    paths = sinks.save_panel_outputs(
        scratch_path(t.spark, "outputs"), panel, t.cells_small, months, anchors.select("month_idx", "month_label")
    )
    stored = t.spark.read.parquet(paths["panel"]).groupBy("month_idx").agg(F.count(F.lit(1)).alias("panel_rows"))
    return t.spark.read.parquet(paths["month_index"]).join(stored, "month_idx", "left").na.fill(0, ["panel_rows"])


RELEASE = (
    "rel",
    """SELECT d.grid_id, d.month_idx, coalesce(d.wtd, 3.75) AS wtd, abs(coalesce(d.wtd, 3.75)) * 0.07 + 0.011 AS radius FROM dense_panel d""",
)


def release_panel(t: Tables) -> DataFrame:
    v = F.coalesce("wtd", F.lit(3.75))
    return t.dense_panel.select("grid_id", "month_idx", v.alias("wtd"), (F.abs(v) * F.lit(0.07) + F.lit(0.011)).alias("radius"))


def lonlat_sql(x: str = "x", y: str = "y") -> str:
    """Inverse projection in SQL: five fixed Newton steps as nested subqueries."""
    p = sc.AlbersConic()
    r = repr
    q0 = f"SELECT *, ({r(p.c)} - ({x} * {x} + ({r(p.rho0)} - {y}) * ({r(p.rho0)} - {y})) * {r(p.n * p.n / (p.a * p.a))}) / {r(p.n)} AS q, {r(p.lon_0)} + degrees(atan2({x}, {r(p.rho0)} - {y}) / {r(p.n)}) AS lon FROM SRC"
    step = f"SELECT *, asin(q / 2.0) AS phi FROM ({q0})"
    for _ in range(5):
        es2 = f"(1.0 - {r(p.e2)} * sin(phi) * sin(phi))"
        step = (
            f"SELECT * REPLACE (phi + {es2} * {es2} / (2.0 * cos(phi)) * (q / {r(1.0 - p.e2)} - sin(phi) / {es2} + "
            f"ln((1.0 - {r(p.e)} * sin(phi)) / (1.0 + {r(p.e)} * sin(phi))) / {r(2.0 * p.e)}) AS phi) FROM ({step})"
        )
    return f"SELECT * EXCLUDE (q, phi), degrees(phi) AS lat FROM ({step})"


PROJ_X, PROJ_Y = 300000.0, 1200000.0
GEO_CELLS = ("geo", lonlat_sql().replace("FROM SRC", f"FROM (SELECT * REPLACE (x + {PROJ_X} AS x, y + {PROJ_Y} AS y) FROM CELLS)"))


def geo_cells(cells: DataFrame) -> DataFrame:
    lon, lat = sc.AlbersConic().inverse(F.col("x"), F.col("y"))
    moved = cells.withColumns({"x": F.col("x") + PROJ_X, "y": F.col("y") + PROJ_Y})
    return moved.withColumns({"lon": lon, "lat": lat})


@query(
    "a11_release_product",
    "grid_id:i month_label:s year:i x:f y:f lon:f lat:f wtd:f radius:f lower:f upper:f",
    with_blocks(
        "dense_panel",
        """SELECT r.grid_id, month_label, year, x, y, lon, lat, wtd, radius, wtd - radius AS lower, wtd + radius AS upper
        FROM rel r JOIN calendar USING (month_idx) JOIN geo USING (grid_id)""",
        RELEASE,
        (GEO_CELLS[0], GEO_CELLS[1].replace("CELLS", "cells_small")),
    ),
)
def a11(t: Tables) -> DataFrame:
    return sinks.release_product(release_panel(t), geo_cells(t.cells_small), t.calendar)


@query(
    "a11_release_checks",
    "n_rows:i n_cells:i cells_with_wrong_month_count:i missing_cells:i nonfinite_values:i nonfinite_radii:i negative_radii:i",
    with_blocks(
        "dense_panel",
        """SELECT count(*) AS n_rows, count(DISTINCT grid_id) AS n_cells, 0 AS cells_with_wrong_month_count,
        (SELECT count(*) FROM supplier) - count(DISTINCT grid_id) AS missing_cells, count(*) - count(wtd) AS nonfinite_values,
        count(*) - count(radius) AS nonfinite_radii, count(*) FILTER (radius < 0) AS negative_radii
        FROM (SELECT grid_id, month_idx, wtd, wtd - 3.0 AS radius FROM dense_panel)""",
    ),
)
def a11_checks(t: Tables) -> DataFrame:
    panel = t.dense_panel.withColumn("radius", F.col("wtd") - F.lit(3.0))
    return sinks.release_violations(panel, t.cells_small.agg(F.count(F.lit(1))).scalar(), N_MONTHS)


@query(
    "a12_content_manifest",
    "year:i xor_digest:i sum_digest:i n_rows:i",
    with_blocks(
        "dense_panel",
        """SELECT year, bit_xor(h) AS xor_digest, sum(h) AS sum_digest, count(*) AS n_rows FROM (SELECT year, CAST('0x' || substr(md5(grid_id || '|' || r.month_idx || '|' ||
        CAST(floor(wtd * 1e6 + 0.5) AS BIGINT) || '|' || CAST(floor(radius * 1e6 + 0.5) AS BIGINT)), 1, 8) AS BIGINT) AS h FROM rel r JOIN calendar USING (month_idx)) GROUP BY year""",
        RELEASE,
    ),
)
def a12(t: Tables) -> DataFrame:
    rel = release_panel(t).join(F.broadcast(t.calendar.select("month_idx", "year")), "month_idx")
    return sinks.content_manifest(rel, "year", ["grid_id", "month_idx", "wtd", "radius"])


@query(
    "a13_summary_sidecar",
    "split:s n:i document:s",
    with_blocks(
        "pairs",
        """SELECT split, count(*) AS n, '{"split":"' || split || '","n":' || count(*) || ',"first_start":' || min(start_idx)
        || ',"last_target":' || max(target_idx) || '}' AS document FROM pairs WHERE split IS NOT NULL GROUP BY split""",
    ),
)
def a13(t: Tables) -> DataFrame:
    return sinks.summary_sidecar(t.pairs.where("split IS NOT NULL"), "split")


@query(
    "a13_sample_sidecar",
    "split:s n:i omitted:i document:s",
    with_blocks(
        "pairs",
        """SELECT split, n, omitted, '{"split":"' || split || '","n":' || n || ',"omitted":' || omitted || ',"features":["wtd_t","n_days_t","h"]}' AS document
        FROM (SELECT split, count(*) AS n, (SELECT count(*) FROM pairs WHERE split IS NULL) AS omitted FROM pairs WHERE split IS NOT NULL GROUP BY split)""",
    ),
)
def a13_samples(t: Tables) -> DataFrame:
    return sinks.write_samples_with_sidecar(
        t.pairs, scratch_path(t.spark, "samples"), ["train", "validation", "test"], ["wtd_t", "n_days_t", "h"]
    )


# --- B: projections and scalar functions ---------------------------------------

@query(
    "b01_month_calendar",
    "month_idx:i month_ord:i month_start:s month_label:s year:i month:i",
    """WITH b AS (SELECT 12 * year(min(o_orderdate)) + month(min(o_orderdate)) AS lo, 12 * year(max(o_orderdate)) + month(max(o_orderdate)) AS hi FROM orders)
    SELECT o - lo AS month_idx, o AS month_ord, make_date((o - 1) // 12, (o - 1) % 12 + 1, 1) AS month_start,
    printf('%04d-%02d', (o - 1) // 12, (o - 1) % 12 + 1) AS month_label, (o - 1) // 12 AS year, (o - 1) % 12 + 1 AS month
    FROM b, unnest(range(lo, hi + 1)) u(o)""",
)
def b01(t: Tables) -> DataFrame:
    return cal.observed_calendar(t.raw("orders").select(F.to_date("o_orderdate").alias("d")), "d")


@query(
    "b02_month_ord",
    "o_orderkey:i month_ord:i back:s",
    """SELECT o_orderkey, 12 * year(o_orderdate) + month(o_orderdate) AS month_ord,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS back FROM orders""",
)
def b02(t: Tables) -> DataFrame:
    o = cal.month_ord(F.col("o_orderdate"))
    return t.raw("orders").select("o_orderkey", o.alias("month_ord"), cal.month_start_of(o).alias("back"))


@query(
    "b03_add_months",
    "o_orderkey:i later:s earlier:s",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 6 MONTH AS DATE) AS later,
    CAST(date_trunc('month', o_orderdate) - INTERVAL 14 MONTH AS DATE) AS earlier FROM orders""",
)
def b03(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.raw("orders").select("o_orderkey", cal.shift_months(d, 6).alias("later"), cal.shift_months(d, -14).alias("earlier"))


@query(
    "b04_month_cycle",
    "o_orderkey:i s:f c:f s_off:f c_off:f",
    """SELECT o_orderkey, sin(2 * pi() * (month(o_orderdate) - 1) / 12) AS s, cos(2 * pi() * (month(o_orderdate) - 1) / 12) AS c,
    0.0 AS s_off, 1.0 AS c_off FROM orders""",
)
def b04(t: Tables) -> DataFrame:
    s, c = cal.month_cycle(F.month("o_orderdate"))
    s0, c0 = cal.month_cycle(F.month("o_orderdate"), enabled=False)
    return t.raw("orders").select("o_orderkey", s.alias("s"), c.alias("c"), s0.alias("s_off"), c0.alias("c_off"))


@query(
    "b05_unit_conversion",
    "grid_id:i month_idx:i mm:f depth_mm:f",
    with_blocks("forcing_sparse", "SELECT grid_id, month_idx, infiltration * 25.4 AS mm, pumping * 1e4 / 1000.0 AS depth_mm FROM forcing_sparse"),
)
def b05(t: Tables) -> DataFrame:
    return t.forcing_sparse.select(
        "grid_id", "month_idx", sc.inch_to_mm(F.col("infiltration")).alias("mm"),
        sc.volume_per_km2_to_mm(F.col("pumping") * F.lit(1e4)).alias("depth_mm"),
    )


@query(
    "b06_log1p_clipped",
    "grid_id:i month_idx:i log_raw:f log_depth:f",
    with_blocks(
        "forcing_sparse",
        "SELECT grid_id, month_idx, ln(1 + greatest(pumping - 1.5, 0)) AS log_raw, ln(1 + greatest(pumping * 10.0, 0)) AS log_depth FROM forcing_sparse",
    ),
)
def b06(t: Tables) -> DataFrame:
    return t.forcing_sparse.select(
        "grid_id", "month_idx", sc.log1p_nonneg(F.col("pumping") - F.lit(1.5)).alias("log_raw"),
        sc.log1p_nonneg(F.col("pumping") * F.lit(10.0)).alias("log_depth"),
    )


@query(
    "b07_standardize",
    "grid_id:i month_idx:i z:f back:f flat:f",
    with_blocks(
        "obs",
        """SELECT grid_id, month_idx, (wtd - m) / (s + 1e-6) AS z, wtd AS back, wtd - m AS flat
        FROM obs, (SELECT avg(wtd) AS m, stddev_pop(wtd) AS s FROM obs)""",
    ),
)
def b07(t: Tables) -> DataFrame:
    stats = t.obs.agg(F.struct(F.avg("wtd").alias("m"), (F.stddev_pop("wtd") + F.lit(1e-6)).alias("s")).alias("st")).scalar()
    d = t.obs.withColumn("_st", stats)
    z = sc.standardize(F.col("wtd"), F.col("_st.m"), F.col("_st.s"))
    return d.select(
        "grid_id", "month_idx", z.alias("z"), sc.unstandardize(z, F.col("_st.m"), F.col("_st.s")).alias("back"),
        sc.standardize(F.col("wtd"), F.col("_st.m"), F.lit(0.0)).alias("flat"),
    )


@query(
    "b08_split_by_date",
    "sample_key:i by_target:s by_start:s",
    with_blocks(
        "pairs",
        """SELECT sample_key, split AS by_target, CASE WHEN start_idx + 23941 <= 23988 THEN 'train' WHEN start_idx + 23941 <= 24000 THEN 'validation'
        WHEN start_idx + 23941 BETWEEN 24001 AND 24012 THEN 'test' END AS by_start FROM pairs""",
    ),
)
def b08(t: Tables) -> DataFrame:
    by_start = sc.split_by_ord(F.col("start_idx") + FIRST_ORD, TRAIN_END, VALIDATION, (TEST[0], TEST[0] + 11))
    by_target = sc.split_by_ord(F.col("target_idx") + FIRST_ORD, TRAIN_END, VALIDATION, TEST)
    return t.pairs.select("sample_key", by_target.alias("by_target"), by_start.alias("by_start"))


@query(
    "b09_split_space_time",
    "split:s omitted_key:s n:i",
    st_sql(
        """SELECT split, CASE WHEN split IS NULL THEN coalesce(grid_split, 'unknown_grid') || '__' || coalesce(time_split, 'unknown_time') || '__' ||
        CASE WHEN grid_split IS NULL OR time_split IS NULL THEN 'unassigned' ELSE 'held_out_unused' END END AS omitted_key, count(*) AS n
        FROM sst GROUP BY ALL"""
    ),
)
def b09(t: Tables) -> DataFrame:
    key = F.when(
        F.col("split").isNull(),
        F.concat_ws(
            "__", F.coalesce("grid_split", F.lit("unknown_grid")), F.coalesce("time_split", F.lit("unknown_time")),
            F.coalesce("eval_case", F.lit("unassigned")),
        ),
    )
    return space_time_samples(t).groupBy("split", key.alias("omitted_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b10_quality_filter",
    "split:s removed:i kept:i total:i",
    with_blocks(
        "pairs",
        """SELECT split, count(*) FILTER (bad) AS removed, count(*) FILTER (NOT bad) AS kept, count(*) AS total FROM (
        SELECT split, coalesce(split IN ('validation', 'test') AND (n_days_t < 2 OR n_days_target < 2), FALSE) AS bad FROM pairs) GROUP BY split""",
    ),
)
def b10(t: Tables) -> DataFrame:
    return samples.quality_report(t.pairs, 2, ["validation", "test"])


@query(
    "b10_quality_filtered_rows",
    "sample_key:i split:s",
    with_blocks(
        "pairs",
        "SELECT sample_key, split FROM pairs WHERE NOT coalesce(split IN ('validation', 'test') AND (n_days_t < 2 OR n_days_target < 2), FALSE)",
    ),
)
def b10_rows(t: Tables) -> DataFrame:
    return samples.quality_filter(t.pairs, 2, ["validation", "test"])


STEP_SQL = "CASE WHEN {x} >= 3 THEN 1.3 WHEN {x} >= 2 THEN 1.0 ELSE 0.6 END"


@query(
    "b11_step_weight",
    "grid_id:i month_idx:i weight:f",
    with_blocks("obs", f"SELECT grid_id, month_idx, {STEP_SQL.format(x='n_days')} AS weight FROM obs"),
)
def b11(t: Tables) -> DataFrame:
    return t.obs.select("grid_id", "month_idx", sc.step_weight(F.col("n_days"), [2, 3], [0.6, 1.0, 1.3]).alias("weight"))


@query(
    "b12_sample_weight",
    "sample_key:i raw_weight:f weight:f",
    with_blocks(
        "pairs",
        """SELECT sample_key, raw_weight, raw_weight / avg(raw_weight) OVER (PARTITION BY split) AS weight FROM raw""",
        (
            "raw",
            f"""SELECT sample_key, split, CASE h WHEN 1 THEN 1.0 WHEN 3 THEN 0.9 ELSE 0.7 END::DOUBLE * {STEP_SQL.format(x='least(n_days_t, n_days_target)')}::DOUBLE
            * CASE WHEN least(n_sites_t, n_sites_target) >= 2 THEN 1.15 ELSE 1.0 END::DOUBLE AS raw_weight FROM pairs WHERE split IS NOT NULL""",
        ),
    ),
)
def b12(t: Tables) -> DataFrame:
    return samples.sample_weights(
        t.pairs.where("split IS NOT NULL"), {1: 1.0, 3: 0.9, 6: 0.7}, ([2, 3], [0.6, 1.0, 1.3]), ([2], [1.0, 1.15])
    )


@query(
    "b13_observation_quality",
    "grid_id:i month_idx:i quality:f",
    with_blocks("obs", "SELECT grid_id, month_idx, greatest(n_days / greatest(n_sites, 1), 1.0) AS quality FROM obs"),
)
def b13(t: Tables) -> DataFrame:
    return t.obs.select("grid_id", "month_idx", sc.observation_quality(F.col("n_days"), F.col("n_sites")).alias("quality"))


BASE_Q = """least(greatest(CASE fill_source WHEN 'direct' THEN 0.75 WHEN 'linear' THEN 0.35 WHEN 'nearest' THEN 0.15 ELSE 0.25 END::DOUBLE
 + 0.10::DOUBLE * least(greatest(ln(1 + n_points) / ln(6.0::DOUBLE), 0), 1), 0.05), 1.0)"""


@query("b14_baseline_quality", "grid_id:i quality:f", with_blocks("baseline", f"SELECT grid_id, {BASE_Q} AS quality FROM baseline"))
def b14(t: Tables) -> DataFrame:
    return t.baseline.select("grid_id", sc.baseline_quality(F.col("fill_source"), F.col("n_points")).alias("quality"))


@query(
    "b15_soft_anchor_alpha",
    "grid_id:i month_idx:i alpha:f",
    with_blocks(
        "obs",
        """SELECT grid_id, month_idx, least(greatest(least(greatest(n_month / 300.0, 0.10), 0.80) / (1.0 + abs(wtd - 2.5) / 3.0), 0.02), 1.0) AS alpha
        FROM obs JOIN (SELECT month_idx, count(*) AS n_month FROM obs GROUP BY 1) USING (month_idx)""",
    ),
)
def b15(t: Tables) -> DataFrame:
    counts = t.obs.groupBy("month_idx").agg(F.count(F.lit(1)).alias("n_month"))
    return t.obs.join(counts, "month_idx").select(
        "grid_id", "month_idx", sc.soft_anchor_alpha(F.col("n_month"), F.col("wtd") - F.lit(2.5), ref=300.0).alias("alpha")
    )


@query(
    "b16_bridge_alpha",
    "sample_key:i alpha:f",
    with_blocks(
        "pairs",
        """SELECT sample_key, least(greatest((0.35 + 0.45 * least(greatest(0.5 * (n_days_t + n_days_target) / 5.0, 0), 1))
        / (1 + greatest(h - 1, 0) / 12.0), 0.05), 0.95) AS alpha FROM pairs""",
    ),
)
def b16(t: Tables) -> DataFrame:
    return t.pairs.select("sample_key", sc.bridge_alpha(F.col("n_days_t"), F.col("n_days_target"), F.col("h")).alias("alpha"))


@query(
    "b17_single_obs_alpha",
    "grid_id:i month_idx:i alpha:f",
    with_blocks(
        "obs",
        """SELECT grid_id, month_idx, least(greatest((0.05 + 0.15 * least(greatest(n_days / 5.0, 0), 1)) / (1 + abs(wtd - 2.5) / 5.0), 0.02), 0.20) AS alpha FROM obs""",
    ),
)
def b17(t: Tables) -> DataFrame:
    return t.obs.select("grid_id", "month_idx", sc.single_obs_alpha(F.col("n_days"), F.col("wtd") - F.lit(2.5)).alias("alpha"))


@query(
    "b18_ramps",
    "grid_id:i month_idx:i smooth:f cubic:f",
    with_blocks(
        "obs",
        """SELECT grid_id, month_idx, 3 * z * z - 2 * z * z * z AS smooth, pow(month_idx / 84.0::DOUBLE, 3) AS cubic
        FROM (SELECT *, least(greatest(wtd / 4.0, 0), 1) AS z FROM obs)""",
    ),
)
def b18(t: Tables) -> DataFrame:
    return t.obs.select(
        "grid_id", "month_idx", sc.smoothstep(F.col("wtd") / F.lit(4.0)).alias("smooth"),
        sc.cubic_ramp(F.col("month_idx"), F.lit(84.0)).alias("cubic"),
    )


SY_SQL = "CASE cls WHEN -3 THEN 0.08 WHEN -2 THEN 0.11 WHEN -1 THEN 0.14 WHEN 1 THEN 0.18 WHEN 2 THEN 0.22 WHEN 3 THEN 0.26 ELSE 0.18 END::DOUBLE"


@query("b19_class_value_map", "grid_id:i sy:f", with_blocks("connectivity", f"SELECT grid_id, {SY_SQL} AS sy FROM connectivity"))
def b19(t: Tables) -> DataFrame:
    return t.connectivity.select("grid_id", sc.specific_yield(F.col("cls")).alias("sy"))


@query(
    "b20_anomaly",
    "grid_id:i month_idx:i anomaly:f back:f",
    with_blocks(
        "obs baseline",
        "SELECT o.grid_id, month_idx, wtd - base_wtd AS anomaly, wtd AS back FROM obs o JOIN baseline b USING (grid_id)",
    ),
)
def b20(t: Tables) -> DataFrame:
    from gridloom.operators.anchors import from_anomaly, to_anomaly

    anom = to_anomaly(t.obs, t.baseline, "wtd", "anomaly")
    return from_anomaly(anom.drop("base_wtd"), t.baseline, "anomaly", "back")


@query(
    "b21_season_windows",
    "month_label:s n_in_window:i n_rows:i",
    with_blocks(
        "calendar panel",
        """SELECT month_label, 6 AS n_in_window, n AS n_rows FROM calendar JOIN (SELECT month_idx, count(*) AS n FROM panel GROUP BY 1) USING (month_idx)
        WHERE year = 1996 AND month BETWEEN 5 AND 10""",
    ),
)
def b21(t: Tables) -> DataFrame:
    window = require_months(t.calendar, (12 * 1996 + 5, 12 * 1996 + 10))
    n = t.panel.groupBy("month_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    return window.join(n, "month_idx")


@query(
    "b22_guarded_ratio",
    "sample_key:i ratio:f",
    with_blocks("pairs", "SELECT sample_key, CASE WHEN abs(delta_h) >= 0.30 THEN wtd_t / delta_h END AS ratio FROM pairs"),
)
def b22(t: Tables) -> DataFrame:
    d = F.col("delta_h")
    return t.pairs.select("sample_key", sc.guarded_ratio(F.col("wtd_t"), d, F.abs(d) >= 0.30).alias("ratio"))


@query(
    "b23_flag_parsing",
    "word:s flag:b n:i",
    """SELECT word, coalesce(lower(word) IN ('true', '1', 'yes'), FALSE) AS flag, count(*) AS n FROM
    (SELECT CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'no' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' END END AS word FROM orders) GROUP BY ALL""",
)
def b23(t: Tables) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "no").otherwise(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("Yes"))
    )
    return t.raw("orders").select(word.alias("word")).groupBy("word", sc.flag_true(F.col("word")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b24_pow10",
    "grid_id:i layer:i resistivity:f",
    with_blocks("profile_layers", "SELECT grid_id, layer, pow(10.0::DOUBLE, value) AS resistivity FROM profile_layers"),
)
def b24(t: Tables) -> DataFrame:
    return t.profile_layers.select("grid_id", "layer", sc.pow10(F.col("value")).alias("resistivity"))


@query(
    "b25_lonlat",
    "grid_id:i lon:f lat:f x_min:f x_max:f y_min:f y_max:f",
    with_blocks(
        "cells",
        """SELECT grid_id, lon, lat, min(x) OVER () - 500 AS x_min, max(x) OVER () + 500 AS x_max, min(y) OVER () - 500 AS y_min,
        max(y) OVER () + 500 AS y_max FROM geo""",
        (GEO_CELLS[0], GEO_CELLS[1].replace("CELLS", "cells")),
    ),
)
def b25(t: Tables) -> DataFrame:
    geo = geo_cells(t.cells)
    ext = geo.agg(
        F.struct(
            (F.min("x") - 500).alias("x_min"), (F.max("x") + 500).alias("x_max"),
            (F.min("y") - 500).alias("y_min"), (F.max("y") + 500).alias("y_max"),
        ).alias("e")
    ).scalar()
    return geo.withColumn("_e", ext).select("grid_id", "lon", "lat", "_e.*")


@query(
    "b26_losses",
    "split:s mse:f mae:f huber:f smooth_l1:f log_cosh:f weighted_huber:f",
    with_blocks(
        "predictions",
        f"""SELECT split, avg(e * e) AS mse, avg(a) AS mae, avg(huber) AS huber, avg(CASE WHEN a < 0.3 THEN 0.5 * e * e / 0.3 ELSE a - 0.15 END) AS smooth_l1,
        avg(ln((exp(e) + exp(-e)) / 2)) AS log_cosh, sum(w * huber) / sum(w) AS weighted_huber FROM
        (SELECT *, CASE WHEN a <= 0.5 THEN 0.5 * e * e ELSE 0.5 * (a - 0.25) END AS huber FROM
         (SELECT split, y_pred - y_true AS e, abs(y_pred - y_true) AS a, {STEP_SQL.format(x='n_days_t')}::DOUBLE AS w FROM predictions)) GROUP BY split""",
    ),
)
def b26(t: Tables) -> DataFrame:
    p, y = F.col("y_pred"), F.col("y_true")
    w = sc.step_weight(F.col("n_days_t"), [2, 3], [0.6, 1.0, 1.3])
    hub = sc.loss("huber", p, y, 0.5)
    return t.predictions.groupBy("split").agg(
        F.avg(sc.loss("mse", p, y)).alias("mse"), F.avg(sc.loss("mae", p, y)).alias("mae"), F.avg(hub).alias("huber"),
        F.avg(sc.loss("smooth_l1", p, y, 0.3)).alias("smooth_l1"), F.avg(sc.loss("log_cosh", p, y)).alias("log_cosh"),
        (F.sum(w * hub) / F.sum(w)).alias("weighted_huber"),
    )


@query(
    "b27_finite_window",
    "grid_id:i month_idx:i finite_window:b",
    with_blocks(
        "dense_panel",
        """SELECT grid_id, month_idx, count(wtd) OVER (PARTITION BY grid_id ORDER BY month_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 AS finite_window
        FROM dense_panel""",
    ),
)
def b27(t: Tables) -> DataFrame:
    return samples.finite_ahead(t.dense_panel, ["wtd"], 3)
