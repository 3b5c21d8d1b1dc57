"""Queries for aggregations, windows, sorts, profiles and classes (D, E, F, H, L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import aggregates as ag
from gridloom.operators import anchors as an
from gridloom.operators import classify as cl
from gridloom.operators import conformal as cf
from gridloom.operators import events as ev
from gridloom.operators import joins, profiles, ranks, samples, storage, uncertainty, windows
from gridloom.plans.joins_q import COARSE, CROSSWALK, LEAF, STEPS, coarse_tables
from gridloom.plans.registry import query
from gridloom.plans.sources import SY_SQL, space_time_samples, st_sql
from gridloom.plans.sqlbase import with_blocks
from gridloom.plans.tables import DEPTHS, FIRST_ORD, HORIZONS, N_MONTHS, SEEDS, Tables
from gridloom.sources.scans import ordered

# --- D/E: monthly roll-up of daily data -----------------------------------------

DAILY_DENSE = (
    "dd",
    """SELECT u.grid_id, d.day, daily.inches FROM (SELECT DISTINCT grid_id FROM daily) u CROSS JOIN
    (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily) d LEFT JOIN daily ON daily.grid_id = u.grid_id AND daily.day = d.day""",
)


def dense_daily(t: Tables) -> DataFrame:
    ends = t.daily.agg(F.sequence(F.min("day"), F.max("day"))).scalar()
    grid = t.daily.select("grid_id").distinct().withColumn("day", F.explode(ends))
    return grid.join(t.daily, ["grid_id", "day"], "left")


@query(
    "d01_daily_to_monthly",
    "grid_id:i month_start:s monthly_sum:f monthly_mean:f n_rows:i",
    with_blocks(
        "daily",
        "SELECT grid_id, CAST(date_trunc('month', day) AS DATE) AS month_start, coalesce(sum(inches), 0) AS monthly_sum, avg(inches) AS monthly_mean, count(*) AS n_rows FROM dd GROUP BY ALL",
        DAILY_DENSE,
    ),
)
def d01(t: Tables) -> DataFrame:
    return ag.monthly_rollup(dense_daily(t), "grid_id", "day", "inches")


@query(
    "d02_max_7day_sum",
    "grid_id:i month_start:s monthly_max_7day:f",
    with_blocks(
        "daily",
        """SELECT grid_id, m AS month_start, coalesce(max(CASE WHEN n >= 7 THEN w END), sum(inches), 0) AS monthly_max_7day FROM
        (SELECT grid_id, inches, CAST(date_trunc('month', day) AS DATE) AS m, row_number() OVER (PARTITION BY grid_id, date_trunc('month', day) ORDER BY day) AS n,
        coalesce(sum(inches) OVER (PARTITION BY grid_id, date_trunc('month', day) ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS w FROM dd) GROUP BY ALL""",
        DAILY_DENSE,
    ),
)
def d02(t: Tables) -> DataFrame:
    return ag.monthly_rollup(dense_daily(t), "grid_id", "day", "inches")


@query(
    "d03_coverage_safe_mean",
    "grid_id:i year:i mean:f n:i",
    with_blocks(
        "calendar dense_panel",
        "SELECT grid_id, year, avg(CASE WHEN grid_id % 9 <> 0 OR year <> 1997 THEN wtd END) AS mean, count(*) AS n FROM dense_panel JOIN calendar USING (month_idx) GROUP BY ALL",
    ),
)
def d03(t: Tables) -> DataFrame:
    v = F.when((F.col("grid_id") % 9 != 0) | (F.col("year") != 1997), F.col("wtd"))
    return t.dense_panel.join(F.broadcast(t.calendar.select("month_idx", "year")), "month_idx").groupBy("grid_id", "year").agg(
        F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n")
    )


METRICS_SQL = """count(*) AS n, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae,
 CASE WHEN count(*) > 1 AND stddev_pop(y_pred) > 0 AND stddev_pop(y_true) > 0 THEN corr(y_pred, y_true) END AS pearson_r,
 CASE WHEN var_pop(y_true) > 0 THEN 1 - avg(pow(y_pred - y_true, 2)) / var_pop(y_true) END AS r2, avg(y_pred - y_true) AS bias"""


@query(
    "d04_regression_metrics",
    "split:s h:i start_idx:i grouping:i n:i rmse:f mae:f pearson_r:f r2:f bias:f",
    with_blocks(
        "predictions",
        f"""SELECT split, h, start_idx, grouping(split, h, start_idx) AS grouping, {METRICS_SQL} FROM predictions
        GROUP BY GROUPING SETS ((split), (split, h), (split, start_idx))""",
    ),
)
def d04(t: Tables) -> DataFrame:
    return ag.metric_report(t.predictions, [["split"], ["split", "h"], ["split", "start_idx"]], "y_pred", "y_true")


@query(
    "d04_metrics_combined_test",
    "split:s n:i rmse:f mae:f pearson_r:f r2:f bias:f",
    st_sql(
        f"""SELECT split, {METRICS_SQL} FROM (SELECT split, delta_h AS y_true, delta_h * 0.9 + wtd_t * 0.05 AS y_pred FROM sst WHERE split IS NOT NULL
        UNION ALL SELECT 'test', delta_h, delta_h * 0.9 + wtd_t * 0.05 FROM sst WHERE split IN ('test_temporal', 'test_spatial')) GROUP BY split"""
    ),
)
def d04_combined(t: Tables) -> DataFrame:
    p = space_time_samples(t).where("split IS NOT NULL").select(
        "split", F.col("delta_h").alias("y_true"), (F.col("delta_h") * F.lit(0.9) + F.col("wtd_t") * F.lit(0.05)).alias("y_pred")
    )
    return samples.combined_test(p).groupBy("split").agg(*ag.regression_metrics("y_pred", "y_true"))


@query(
    "d05_value_counts",
    "fill_source:s n:i share:f",
    with_blocks("baseline", "SELECT fill_source, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM baseline GROUP BY 1"),
)
def d05(t: Tables) -> DataFrame:
    return ag.value_shares(t.baseline, "fill_source")


LEVELS = (0.75, 0.90, 0.95)


def qhat_sql(score: str, levels=LEVELS) -> str:
    """Calibration quantile per horizon and level, by row number."""
    vals = ", ".join(f"({v!r}::DOUBLE, {1.0 - v!r}::DOUBLE, {1.0 - (1.0 - v)!r}::DOUBLE)" for v in levels)
    return f"""SELECT h, level, alpha, n AS n_calibration, max(CASE WHEN r - 1 = CAST(ceil(least(greatest(ceil((n + 1) * oma) / n, 0), 1) * (n - 1)) AS BIGINT) THEN score END) AS qhat
    FROM (SELECT h, score, row_number() OVER (PARTITION BY h ORDER BY score) AS r, count(*) OVER (PARTITION BY h) AS n FROM
    (SELECT h, {score} AS score FROM ensemble WHERE split = 'validation')), (VALUES {vals}) lv(level, alpha, oma) GROUP BY ALL"""


ABS_SCORE = "abs(y_true - ens_mean)"
NORM_SCORE = "abs(y_true - ens_mean) / greatest(ens_std, 1e-6)"


@query("d06_split_conformal", "h:i level:f alpha:f qhat:f n_calibration:i", with_blocks("ensemble", qhat_sql(ABS_SCORE)))
def d06(t: Tables) -> DataFrame:
    return cf.fit_conformal(t.ensemble, cf.absolute_score("y_true", "ens_mean"), LEVELS, ["h"])


def normalised(t: Tables, levels=LEVELS) -> DataFrame:
    return cf.fit_conformal(staged_ensemble(t), cf.normalised_score("y_true", "ens_mean", "ens_std"), levels, ["h"])


@query("d07_normalised_conformal", "h:i level:f alpha:f qhat:f n_calibration:i", with_blocks("ensemble", qhat_sql(NORM_SCORE)))
def d07(t: Tables) -> DataFrame:
    return normalised(t)


CAL = ("cal", qhat_sql(NORM_SCORE))
INTERVALS = (
    "iv",
    """SELECT e.*, level, qhat * greatest(ens_std, 1e-6) AS radius, ens_mean - qhat * greatest(ens_std, 1e-6) AS lower,
    ens_mean + qhat * greatest(ens_std, 1e-6) AS upper FROM ensemble e JOIN cal USING (h)""",
)


def intervals(t: Tables) -> DataFrame:
    return cf.apply_intervals(staged_ensemble(t), normalised(t), "ens_mean", LEVELS, ["h"], F.greatest(F.col("ens_std"), F.lit(1e-6)))


@query(
    "d08_apply_intervals",
    "sample_key:i ens_mean:f pi_75_radius:f pi_75_lower:f pi_90_lower:f pi_90_upper:f pi_95_radius:f pi_95_upper:f",
    with_blocks(
        "ensemble",
        """SELECT sample_key, ens_mean, max(radius) FILTER (level = 0.75) AS pi_75_radius, max(lower) FILTER (level = 0.75) AS pi_75_lower,
        max(lower) FILTER (level = 0.9) AS pi_90_lower, max(upper) FILTER (level = 0.9) AS pi_90_upper, max(radius) FILTER (level = 0.95) AS pi_95_radius,
        max(upper) FILTER (level = 0.95) AS pi_95_upper FROM iv GROUP BY ALL""",
        CAL, INTERVALS,
    ),
)
def d08(t: Tables) -> DataFrame:
    return intervals(t)


@query(
    "d09_interval_summary",
    "split:s level:f empirical_coverage:f radius_reference:f mean_radius:f median_radius:f radius_is_constant:b mean_width:f median_width:f n_samples:i",
    with_blocks(
        "ensemble",
        """SELECT split, level, avg(CAST(y_true BETWEEN lower AND upper AS INTEGER)) AS empirical_coverage, arg_min(radius, sample_key) AS radius_reference, avg(radius) AS mean_radius,
        median(radius) AS median_radius, max(radius) - min(radius) <= 1e-8 + 1e-5 * abs(arg_min(radius, sample_key)) AS radius_is_constant, avg(upper - lower) AS mean_width,
        median(upper - lower) AS median_width, count(*) AS n_samples FROM iv GROUP BY split, level""",
        CAL, INTERVALS,
    ),
)
def d09(t: Tables) -> DataFrame:
    return cf.interval_summary(t.stage("intervals", lambda: intervals(t)), "y_true", LEVELS)


@query(
    "d10_train_scalers",
    "scope:s feature:s h:i mean:f std:f",
    with_blocks(
        "pairs profile_layers",
        """SELECT 'sample' AS scope, f AS feature, NULL AS h, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM (SELECT unnest(['wtd_t', 'delta_h', 'h']) AS f, unnest([wtd_t, delta_h, CAST(h AS DOUBLE)]) AS v
        FROM pairs WHERE split = 'train') GROUP BY f
        UNION ALL SELECT 'horizon', 'delta_h', h, avg(delta_h), stddev_pop(delta_h) + 1e-6 FROM pairs WHERE split = 'train' GROUP BY h
        UNION ALL SELECT 'layer', CAST(layer AS VARCHAR), NULL, avg(value), stddev_pop(value) + 1e-6 FROM profile_layers
        WHERE grid_id IN (SELECT grid_id FROM pairs WHERE split = 'train') GROUP BY layer""",
    ),
)
def d10(t: Tables) -> DataFrame:
    train = t.pairs.where("split = 'train'").withColumn("h", F.col("h").cast("double"))
    whole = ag.scaler_rows(train, ["wtd_t", "delta_h", "h"]).select(
        F.lit("sample").alias("scope"), "feature", F.lit(None).cast("int").alias("h"), "mean", "std"
    )
    per_h = ag.scaler_rows(train, ["delta_h"], ["h"]).select(F.lit("horizon").alias("scope"), "feature", F.col("h").cast("int"), "mean", "std")
    layers = t.profile_layers.join(train.select("grid_id").distinct(), "grid_id", "left_semi")
    per_layer = ag.scaler_rows(layers, ["value"], ["layer"]).select(
        F.lit("layer").alias("scope"), F.col("layer").cast("string").alias("feature"), F.lit(None).cast("int").alias("h"), "mean", "std"
    )
    return whole.unionByName(per_h).unionByName(per_layer)


TRAIN_AHEAD = (
    "ahead",
    """SELECT p.grid_id, p.start_idx, p.h, sum(g.infiltration) AS sum_infiltration, sum(g.pumping) AS sum_pumping, ln(1 + greatest(sum(g.pumping), 0)) AS log1p_sum_pumping
    FROM pairs p JOIN forcing g ON g.grid_id = p.grid_id AND g.month_idx > p.start_idx AND g.month_idx <= p.start_idx + p.h WHERE p.split = 'train' GROUP BY ALL""",
)


@query(
    "d10_feature_scalers",
    "scope:s feature:s mean:f std:f",
    with_blocks(
        "pairs forcing cells",
        """SELECT scope, f AS feature, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM (
        SELECT 'forcing' AS scope, unnest(['sum_infiltration', 'sum_pumping', 'log1p_sum_pumping']) AS f, unnest([sum_infiltration, sum_pumping, log1p_sum_pumping]) AS v FROM ahead
        UNION ALL SELECT 'sequence', unnest(['infiltration', 'pumping']), unnest([g.infiltration, g.pumping])
        FROM pairs p JOIN forcing g ON g.grid_id = p.grid_id AND g.month_idx > p.start_idx AND g.month_idx <= p.start_idx + p.h WHERE p.split = 'train'
        UNION ALL SELECT 'root', 'wtd_t', wtd_t FROM pairs WHERE split = 'train'
        UNION ALL SELECT 'topography', unnest(['x', 'y']), unnest([x, y]) FROM cells WHERE grid_id IN (SELECT grid_id FROM pairs WHERE split = 'train')
        ) GROUP BY scope, f""",
        TRAIN_AHEAD,
    ),
)
def d10_features(t: Tables) -> DataFrame:
    from gridloom.functions.scalars import log1p_nonneg

    keys, columns = ["grid_id", "start_idx", "h"], ["infiltration", "pumping"]
    train = t.pairs.where("split = 'train'")
    packed = train.select(*keys).join(t.forcing_months, "grid_id").where(joins.inside_months(N_MONTHS))
    # read by two scopes: the windows of a start, never the panel
    windows = t.stage("windows", lambda: packed.select(*keys, joins.packed_sequence(columns, 6).alias("sequence"), *[joins.packed_sum(c, [1, 3, 6]).alias(f"sum_{c}") for c in columns]))
    sums = windows.withColumn("log1p_sum_pumping", log1p_nonneg(F.col("sum_pumping")))
    steps = windows.withColumn("sequence_length", F.col("h"))
    seen = t.cells.join(train.select("grid_id").distinct(), "grid_id", "left_semi")
    scopes = {
        "forcing": ag.scaler_rows(sums, ["sum_infiltration", "sum_pumping", "log1p_sum_pumping"]),
        "sequence": ag.sequence_scaler_rows(steps, "sequence", "sequence_length", columns),
        "root": ag.scaler_rows(train, ["wtd_t"]),
        "topography": ag.scaler_rows(seen, ["x", "y"]),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("scope", F.lit(name)) for name, df in scopes.items()])


@query(
    "d11_weighted_mean",
    "month_idx:i lwe:f",
    with_blocks(
        "obs cells baseline",
        "SELECT month_idx, sum(weight * lwe) / nullif(sum(weight) FILTER (lwe IS NOT NULL), 0) AS lwe FROM (SELECT * REPLACE (CASE WHEN month_idx <> 40 THEN lwe END AS lwe) FROM coarse) JOIN xwalk USING (lat_idx, lon_idx) GROUP BY 1",
        COARSE, CROSSWALK,
    ),
)
def d11(t: Tables) -> DataFrame:
    values, weights = coarse_tables(t)
    hole = values.withColumn("lwe", F.when(F.col("month_idx") != 40, F.col("lwe")))
    return hole.join(weights, ["lat_idx", "lon_idx"]).groupBy("month_idx").agg(ag.weighted_mean("lwe", "weight").alias("lwe"))


@query(
    "d12_duplicates_averaged",
    "month_idx:i grid_id:i value:f n:i",
    """SELECT CAST(12 * year(o_orderdate) + month(o_orderdate) - 23941 AS INTEGER) AS month_idx, o_custkey AS grid_id, avg(o_totalprice / 98765.4321) AS value, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def d12(t: Tables) -> DataFrame:
    from gridloom.plans.tables import month_idx_of

    return t.raw("orders").groupBy(month_idx_of("o_orderdate").alias("month_idx"), F.col("o_custkey").alias("grid_id")).agg(
        F.avg(F.col("o_totalprice") / F.lit(98765.4321)).alias("value"), F.count(F.lit(1)).alias("n")
    )


@query(
    "d13_regional_series",
    "month_idx:i mean_infiltration:f total_pumping:f4 n_cells:i",
    with_blocks("forcing", "SELECT month_idx, avg(infiltration) AS mean_infiltration, sum(pumping) AS total_pumping, count(*) AS n_cells FROM forcing GROUP BY 1"),
)
def d13(t: Tables) -> DataFrame:
    return t.forcing.groupBy("month_idx").agg(
        F.avg("infiltration").alias("mean_infiltration"), F.sum("pumping").alias("total_pumping"), F.count(F.lit(1)).alias("n_cells")
    )


@query(
    "d14_layer_mean_fill",
    "grid_id:i layer:i value:f",
    with_blocks("profile_layers", "SELECT grid_id, layer, coalesce(value, avg(value) OVER (PARTITION BY layer)) AS value FROM profile_layers"),
)
def d14(t: Tables) -> DataFrame:
    return ag.fill_with_group_mean(t.profile_layers, "layer", "value")


@query(
    "d14_feature_median_fill",
    "grid_id:i month_idx:i wtd:f level:f",
    with_blocks(
        "dense_panel",
        """SELECT grid_id, month_idx, coalesce(wtd, (SELECT median(wtd) FROM dense_panel)) AS wtd,
        coalesce(CASE WHEN wtd > 3.5 THEN wtd * 2 END, (SELECT median(wtd * 2) FROM dense_panel WHERE wtd > 3.5)) AS level FROM dense_panel""",
    ),
)
def d14_median(t: Tables) -> DataFrame:
    d = t.dense_panel.withColumn("level", F.when(F.col("wtd") > 3.5, F.col("wtd") * 2))
    return ag.fill_with_medians(d, ["wtd", "level"])


@query(
    "d15_ensemble_spread",
    "sample_key:i ens_mean:f ens_std:f ens_std_pop:f n_members:i",
    with_blocks("ensemble", "SELECT * FROM ensemble"),
)
def d15(t: Tables) -> DataFrame:
    return t.ensemble


SY = ("sy", f"SELECT grid_id, {SY_SQL} AS sy FROM connectivity")
FLAGGED = (
    "flagged",
    """SELECT month_idx, wtd AS lwe_cm, coalesce(lower(word) IN ('true', '1', 'yes'), FALSE) AND wtd IS NOT NULL AS valid FROM
    (SELECT c.month_idx, avg(p.wtd) AS wtd, CASE c.month_idx % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'Yes' END AS word
    FROM calendar c LEFT JOIN panel p USING (month_idx) GROUP BY c.month_idx)""",
)


def flagged_months(t: Tables) -> DataFrame:
    """Regional monthly series with a textual validity flag."""
    series = t.calendar.select("month_idx").join(t.panel.groupBy("month_idx").agg(F.avg("wtd").alias("lwe_cm")), "month_idx", "left")
    k = F.col("month_idx") % 5
    word = F.when(k == 0, "no").when(k == 1, "TRUE").when(k == 2, "1").when(k == 3, "Yes")
    return storage.valid_solutions(series, "lwe_cm", sc.flag_true(word))


def yields(t: Tables) -> DataFrame:
    return t.connectivity.select("grid_id", sc.specific_yield(F.col("cls")).alias("sy"))


def full_panel(t: Tables) -> DataFrame:
    """A gap-free panel on the large grid: baseline plus a travelling wave."""
    wave = F.lit(0.4) * F.sin(F.col("month_idx") * F.lit(0.5) + F.pmod(F.col("grid_id"), F.lit(7)))
    return t.baseline.select("grid_id", "base_wtd", F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("month_idx")).select(
        "grid_id", "month_idx", (F.col("base_wtd") + wave).alias("wtd")
    )


FULL = ("fullp", "SELECT grid_id, month_idx, base_wtd + 0.4::DOUBLE * sin(month_idx * 0.5::DOUBLE + grid_id % 7) AS wtd FROM baseline, calendar")
PROXY = (
    "proxy",
    """SELECT month_idx, -100.0 * avg((p.wtd - ref) * sy) AS storage_cm FROM fullp p JOIN (SELECT grid_id, avg(wtd) AS ref FROM fullp
    WHERE month_idx IN (SELECT month_idx FROM flagged WHERE valid) GROUP BY 1) USING (grid_id) JOIN sy USING (grid_id) GROUP BY 1""",
)


@query(
    "d16_storage_proxy",
    "month_idx:i storage_cm:f",
    with_blocks("panel baseline connectivity calendar", "SELECT * FROM proxy", SY, FLAGGED, FULL, PROXY),
)
def d16(t: Tables) -> DataFrame:
    return storage.storage_proxy(full_panel(t), yields(t), flagged_months(t).where("valid").select("month_idx"))


def interp_ctes(src: str, value: str, out: str) -> tuple[tuple[str, str], ...]:
    """Two-sided linear fill of a monthly series followed by a centred 3-mean."""
    return (
        (
            f"{out}_b",
            f"""SELECT *, last_value(CASE WHEN {value} IS NOT NULL THEN month_idx END IGNORE NULLS) OVER (ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
            last_value({value} IGNORE NULLS) OVER (ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
            first_value(CASE WHEN {value} IS NOT NULL THEN month_idx END IGNORE NULLS) OVER (ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
            first_value({value} IGNORE NULLS) OVER (ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM {src}""",
        ),
        (
            f"{out}_f",
            f"""SELECT * EXCLUDE (pt, pv, nt, nv), CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR pt = nt THEN pv
            ELSE pv + (nv - pv) * (month_idx - pt) / (nt - pt) END AS filled FROM {out}_b""",
        ),
        (out, f"SELECT *, avg(filled) OVER (ORDER BY month_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM {out}_f"),
    )


WELL = (
    ("wa", "SELECT grid_id, month_idx, wtd - base_wtd AS a FROM obs JOIN baseline USING (grid_id)"),
    (
        "wm",
        """SELECT month_idx, avg((a - med) * sy) AS mean_m, count(*) AS n_obs FROM wa JOIN (SELECT grid_id, median(a) AS med FROM wa GROUP BY 1) USING (grid_id)
        JOIN sy USING (grid_id) GROUP BY 1""",
    ),
    ("ws", "SELECT c.month_idx, coalesce(n_obs, 0) AS n_obs, mean_m FROM calendar c LEFT JOIN wm USING (month_idx)"),
    *interp_ctes("ws", "mean_m", "wi"),
    (
        "target",
        """SELECT month_idx, n_obs, mean_m, -100.0 * smooth - (SELECT avg(-100.0 * smooth) FROM wi WHERE month_idx IN (SELECT month_idx FROM flagged WHERE valid)) AS target_cm FROM wi""",
    ),
)


@query(
    "d17_well_storage_target",
    "month_idx:i n_obs:i mean_m:f target_cm:f",
    with_blocks("panel obs baseline connectivity calendar", "SELECT * FROM target", SY, FLAGGED, *WELL),
)
def d17(t: Tables) -> DataFrame:
    return storage.well_storage_target(t.obs, t.baseline, yields(t), t.calendar, flagged_months(t).where("valid"))


ANOM = ("anom", "SELECT grid_id, month_idx, wtd - base_wtd AS anomaly, greatest(n_days / greatest(n_sites, 1), 1.0) AS quality FROM obs JOIN baseline USING (grid_id)")
BASE_Q_SQL = "least(greatest(CASE fill_source WHEN 'direct' THEN 0.75 WHEN 'linear' THEN 0.35 WHEN 'nearest' THEN 0.15 ELSE 0.25 END::DOUBLE + 0.10::DOUBLE * least(greatest(ln(1 + n_points) / ln(6.0::DOUBLE), 0), 1), 0.05), 1.0)"
SUPPORT = (
    (
        "cst",
        """SELECT grid_id, count(*) AS n_obs, median(anomaly) AS med, quantile_cont(anomaly, 0.25) AS q25, quantile_cont(anomaly, 0.75) AS q75, stddev_pop(anomaly) AS sd FROM anom GROUP BY 1""",
    ),
    (
        "csp",
        f"""SELECT b.grid_id, {BASE_Q_SQL} AS quality, coalesce(n_obs, 0) AS n_obs, coalesce(med, 0) AS median_anomaly,
        CASE WHEN coalesce(n_obs, 0) <= 1 THEN 0.0 WHEN q75 > q25 THEN (q75 - q25) / 1.349 ELSE sd END AS spread FROM baseline b LEFT JOIN cst USING (grid_id)""",
    ),
    (
        "csu",
        "SELECT *, CASE WHEN n_obs = 0 THEN 0.0 ELSE least(greatest(least(greatest((n_obs - 1) / 5.0, 0), 1) / (1 + spread / 2.0), 0), 1) END AS support FROM csp",
    ),
    (
        "supp",
        """SELECT *, median_anomaly * support AS "offset", CASE WHEN n_obs = 0 THEN quality WHEN n_obs = 1 THEN least(greatest(quality * 0.65, 0.05), 0.45)
        ELSE least(greatest(greatest(quality * (0.25 + 0.45 * (1 - support)), 0.10 + 0.55 * support), 0.08), 0.80) END AS anchor_quality FROM csu""",
    ),
)


def anomalies(t: Tables) -> DataFrame:
    return an.to_anomaly(t.stored_obs, t.baseline, "wtd", "anomaly").withColumn(
        "quality", sc.observation_quality(F.col("n_days"), F.col("n_sites"))
    )


def support_table(t: Tables) -> DataFrame:
    cells = t.baseline.select("grid_id", sc.baseline_quality(F.col("fill_source"), F.col("n_points")).alias("quality"))
    return an.cell_support(anomalies(t), cells)


def staged_support(t: Tables) -> DataFrame:
    return t.stage("support", lambda: support_table(t))


def staged_regional(t: Tables) -> DataFrame:
    return t.stage("regional", lambda: an.regional_signal(anomalies(t), t.calendar))


def staged_ensemble(t: Tables) -> DataFrame:
    return t.stage("ensemble", lambda: t.ensemble)


@query(
    "d19_robust_spread",
    "grid_id:i n_obs:i spread:f",
    with_blocks("obs baseline", "SELECT grid_id, n_obs, spread FROM csp", ANOM, *SUPPORT[:2]),
)
def d19(t: Tables) -> DataFrame:
    return support_table(t)


@query(
    "d20_cell_support",
    "grid_id:i n_obs:i median_anomaly:f spread:f support:f cell_offset:f anchor_quality:f",
    with_blocks("obs baseline", 'SELECT *, "offset" AS cell_offset FROM supp', ANOM, *SUPPORT),
)
def d20(t: Tables) -> DataFrame:
    return support_table(t).withColumnRenamed("offset", "cell_offset")


REGIONAL = (
    (
        "rm",
        "SELECT month_idx, median(anomaly - med) AS raw FROM anom JOIN (SELECT grid_id, median(anomaly) AS med FROM anom GROUP BY 1) USING (grid_id) GROUP BY 1",
    ),
    ("rs", "SELECT c.month_idx, raw FROM calendar c LEFT JOIN rm USING (month_idx)"),
    *interp_ctes("rs", "raw", "ri"),
    ("rc", "SELECT month_idx, raw, smooth - (SELECT avg(smooth) FROM ri) AS c FROM ri"),
    (
        "regional",
        """SELECT month_idx, raw, least(greatest(c, -cap), cap) AS regional FROM rc, (SELECT greatest(quantile_cont(abs(c), 0.95), 0.20) AS cap FROM rc)""",
    ),
)


@query(
    "d21_regional_signal",
    "month_idx:i raw:f regional:f",
    with_blocks("obs baseline calendar", "SELECT * FROM regional", ANOM, *REGIONAL),
)
def d21(t: Tables) -> DataFrame:
    return an.regional_signal(anomalies(t), t.calendar)


ANCH = ("anch", "SELECT month_idx FROM calendar WHERE month = 1 OR month_idx = 83")
FITS = (
    (
        "fr",
        """SELECT a.month_idx, base_wtd AS x, anomaly - regional AS y, support AS w FROM anom a JOIN anch USING (month_idx) JOIN supp s ON s.grid_id = a.grid_id AND support > 0
        JOIN baseline b ON b.grid_id = a.grid_id JOIN regional USING (month_idx)""",
    ),
    (
        "fits",
        """SELECT *, ym - slope * xm AS intercept FROM (SELECT *, sxy / greatest(sxx, 1e-6) AS slope FROM (SELECT month_idx, count(*) AS n_fit, sum(w * x) / sum(w) AS xm, sum(w * y) / sum(w) AS ym,
        sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS sxy, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS sxx,
        quantile_cont(y, 0.05) - greatest(0.50, 0.25 * (quantile_cont(y, 0.95) - quantile_cont(y, 0.05))) AS clip_low,
        quantile_cont(y, 0.95) + greatest(0.50, 0.25 * (quantile_cont(y, 0.95) - quantile_cont(y, 0.05))) AS clip_high FROM fr GROUP BY 1 HAVING count(*) >= 10))""",
    ),
    (
        "fb",
        """SELECT CASE WHEN n >= 20 THEN sxy / greatest(sxx, 1e-6) ELSE 0 END AS fslope, CASE WHEN n >= 20 THEN ym - sxy / greatest(sxx, 1e-6) * xm ELSE 0 END AS fint FROM
        (SELECT count(*) AS n, sum(w * x) / sum(w) AS xm, sum(w * y) / sum(w) AS ym, sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS sxy,
        sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS sxx FROM (SELECT base_wtd AS x, median_anomaly AS y, support AS w FROM supp JOIN baseline USING (grid_id) WHERE support > 0.1))""",
    ),
)


@query(
    "d22_anchor_regression",
    "month_idx:i n_fit:i slope:f intercept:f clip_low:f clip_high:f",
    with_blocks("obs baseline calendar", "SELECT * FROM fits", ANOM, *SUPPORT, *REGIONAL, ANCH, *FITS),
)
def d22(t: Tables) -> DataFrame:
    return an.anchor_fits(anomalies(t), staged_support(t), t.baseline, staged_regional(t), an.anchor_months(t.calendar))


FIELDS = (
    "fields",
    """SELECT s.grid_id, a.month_idx, CASE WHEN support > 0 THEN "offset" WHEN slope IS NOT NULL THEN least(greatest(slope * base_wtd + intercept, clip_low), clip_high)
    ELSE fslope * base_wtd + fint END + (0.65 + 0.35 * (1 - support)) * regional AS field,
    least(greatest(anchor_quality * (0.75 + 0.45 * least(coalesce(n_month, 0) / 120.0, 1)), 0.08), 0.90) AS field_quality
    FROM supp s JOIN baseline USING (grid_id) CROSS JOIN anch a JOIN regional r ON r.month_idx = a.month_idx LEFT JOIN fits f ON f.month_idx = a.month_idx
    LEFT JOIN (SELECT month_idx, count(*) AS n_month FROM obs GROUP BY 1) nm ON nm.month_idx = a.month_idx CROSS JOIN fb""",
)
FIELD_CTES = (ANOM, *SUPPORT, *REGIONAL, ANCH, *FITS, FIELDS)


def anchor_field_table(t: Tables) -> DataFrame:
    anchors = an.anchor_months(t.calendar)
    sup, reg, anom = staged_support(t), staged_regional(t), anomalies(t)
    counts = t.stored_obs.groupBy("month_idx").agg(F.count(F.lit(1)).alias("n_month"))
    fits = t.stage("fits", lambda: an.anchor_fits(anom, sup, t.baseline, reg, anchors))
    return an.anchor_fields(sup, t.baseline, reg, anchors, fits, an.fallback_fit(sup, t.baseline), counts)


@query(
    "d23_anchor_field",
    "grid_id:i month_idx:i field:f field_quality:f",
    with_blocks("obs baseline calendar", "SELECT * FROM fields", *FIELD_CTES),
)
def d23(t: Tables) -> DataFrame:
    return anchor_field_table(t)


CORRECTION = (
    (
        "wt",
        """SELECT p.grid_id, p.month_idx, p.wtd, sy, CASE WHEN o.grid_id IS NOT NULL THEN 0.0 ELSE least(greatest(1 - support, 0.15), 1.0) END AS weight FROM fullp p JOIN sy USING (grid_id)
        JOIN supp USING (grid_id) LEFT JOIN obs o ON o.grid_id = p.grid_id AND o.month_idx = p.month_idx""",
    ),
    (
        "shift",
        """SELECT *, CASE WHEN weighted_sy > 1e-6 THEN -diff_cm / (100.0 * weighted_sy) ELSE 0 END AS shift_m FROM (SELECT w.month_idx, avg(weight * sy) AS weighted_sy, count(*) FILTER (weight = 0) AS preserved,
        any_value(storage_cm) AS storage_cm, any_value(target_cm) AS target_cm, any_value(target_cm) - any_value(storage_cm) AS diff_cm FROM wt w JOIN proxy USING (month_idx) JOIN target USING (month_idx) GROUP BY 1)""",
    ),
)
CORR_CTES = (SY, FLAGGED, FULL, PROXY, *WELL, ANOM, *SUPPORT, *CORRECTION)
CORR_BLOCKS = "panel obs baseline connectivity calendar"


def corrected(t: Tables) -> tuple[DataFrame, DataFrame]:
    valid = flagged_months(t).where("valid").select("month_idx")
    panel, sy = full_panel(t), yields(t)
    obs = t.stored_obs  # read by four steps
    cells = staged_support(t).select("grid_id", storage.correction_weight(F.col("support")).alias("base_weight")).join(sy, "grid_id")
    source = t.stage("source", lambda: storage.storage_proxy(panel, sy, valid))
    target = t.stage("target", lambda: storage.well_storage_target(obs, t.baseline, sy, t.calendar, valid))
    return storage.mass_correction(panel, cells, obs, source, target)


@query(
    "d18_mass_correction",
    "grid_id:i month_idx:i applied:f corrected:f",
    with_blocks(CORR_BLOCKS, "SELECT grid_id, month_idx, shift_m * weight AS applied, wtd + shift_m * weight AS corrected FROM wt JOIN shift USING (month_idx)", *CORR_CTES),
)
def d18(t: Tables) -> DataFrame:
    return corrected(t)[0]


@query(
    "d18_mass_correction_monthly",
    "month_idx:i storage_cm:f target_cm:f diff_cm:f weighted_sy:f shift_m:f shift_min:f shift_p50:f shift_max:f preserved:i",
    with_blocks(
        CORR_BLOCKS,
        """SELECT s.*, mn AS shift_min, md AS shift_p50, mx AS shift_max FROM shift s JOIN (SELECT month_idx, min(shift_m * weight) AS mn, median(shift_m * weight) AS md, max(shift_m * weight) AS mx
        FROM wt JOIN shift USING (month_idx) GROUP BY 1) USING (month_idx)""",
        *CORR_CTES,
    ),
)
def d18_monthly(t: Tables) -> DataFrame:
    moved, shift = corrected(t)
    return storage.shift_diagnostics(moved, shift)


RANK_SQL = "(rank() OVER (PARTITION BY {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER ()"


@query(
    "d24_correlations",
    "n:i pearson_r:f spearman_rho:f",
    with_blocks(
        "obs",
        f"""SELECT count(*) AS n, corr(wtd, n_days) AS pearson_r, corr(a, b) AS spearman_rho FROM (SELECT wtd, n_days, {RANK_SQL.format(x='wtd')} AS a, {RANK_SQL.format(x='n_days')} AS b FROM obs)""",
    ),
)
def d24(t: Tables) -> DataFrame:
    return ag.correlations(t.obs.withColumn("n_days", F.col("n_days").cast("double")), ["grid_id", "month_idx"], "wtd", "n_days")


PUMPING = """SELECT grid_id, avg(pumping) AS mean_monthly, max(pumping) AS peak_month, sum(pumping) / count(DISTINCT year) AS mean_annual,
        coalesce(sum(pumping) FILTER (month BETWEEN 4 AND 10) / nullif(count(DISTINCT year) FILTER (month BETWEEN 4 AND 10), 0), 0) AS mean_growing,
        coalesce(sum(pumping) FILTER (year = 1996 AND month BETWEEN 5 AND 10), 0) AS event_sum FROM forcing_sparse JOIN calendar USING (month_idx) GROUP BY 1"""


@query(
    "d25_pumping_features",
    "grid_id:i mean_monthly:f peak_month:f mean_annual:f mean_growing:f event_sum:f log1p_mean_annual:f log1p_event_sum:f",
    with_blocks("forcing_sparse calendar", f"SELECT *, ln(1 + mean_annual) AS log1p_mean_annual, ln(1 + event_sum) AS log1p_event_sum FROM ({PUMPING})"),
)
def d25(t: Tables) -> DataFrame:
    return profiles.pumping_features(t.forcing_sparse, FIRST_ORD, 1996)


DECLINES = {1996: ((1, 4), (5, 10)), 1998: ((1, 5), (6, 11)), 1999: ((1, 5), (6, 11)), 2000: ((1, 5), (6, 11))}
DECLINE = (
    "decl",
    """SELECT grid_id, year, max(wtd) FILTER (month BETWEEN CASE year WHEN 1996 THEN 5 ELSE 6 END AND CASE year WHEN 1996 THEN 10 ELSE 11 END)
    - min(wtd) FILTER (month BETWEEN 1 AND CASE year WHEN 1996 THEN 4 ELSE 5 END) AS decline FROM panel JOIN calendar USING (month_idx)
    WHERE year IN (1996, 1998, 1999, 2000) AND month BETWEEN 1 AND CASE year WHEN 1996 THEN 10 ELSE 11 END GROUP BY 1, 2""",
)


@query("e09_peak_declines", "grid_id:i year:i decline:f", with_blocks("panel calendar", "SELECT * FROM decl", DECLINE))
def e09(t: Tables) -> DataFrame:
    return ev.peak_declines(t.panel, DECLINES, FIRST_ORD)


DIST_METRICS = {
    "n_cells": ("count(*)", ""), "n_valid": ("count(decline)", ""), "mean": ("avg(decline)", "m"), "max": ("max(decline)", "m"),
    "median": ("median(decline)", "m"), "p25": ("quantile_cont(decline, 0.25)", "m"), "p75": ("quantile_cont(decline, 0.75)", "m"),
    "p90": ("quantile_cont(decline, 0.9)", "m"), "p95": ("quantile_cont(decline, 0.95)", "m"), "p98_5": ("quantile_cont(decline, 0.985)", "m"),
    "gt_1m_pct": ("100 * avg(CAST(decline > 1 AS INTEGER))", "%"), "gt_2m_pct": ("100 * avg(CAST(decline > 2 AS INTEGER))", "%"),
    "gt_3m_pct": ("100 * avg(CAST(decline > 3 AS INTEGER))", "%"), "le_0m_pct": ("100 * avg(CAST(decline <= 0 AS INTEGER))", "%"),
}


@query(
    "d26_distribution_report",
    "year:i metric:s value:f unit:s",
    with_blocks(
        "panel calendar",
        " UNION ALL ".join(f"SELECT year, '{n}' AS metric, CAST({e} AS DOUBLE) AS value, '{u}' AS unit FROM decl GROUP BY year" for n, (e, u) in DIST_METRICS.items()),
        DECLINE,
    ),
)
def d26(t: Tables) -> DataFrame:
    return ag.distribution_report(t.stage("declines", lambda: e09(t)), ["year"], "decline")


@query(
    "d27_driver_totals",
    "year:i annual_infiltration:f4 annual_pumping:f4 drawdown_infiltration:f4 drawdown_pumping:f4",
    with_blocks(
        "forcing calendar",
        """SELECT year, sum(i) AS annual_infiltration, sum(p) AS annual_pumping, sum(i) FILTER (month BETWEEN 5 AND 10) AS drawdown_infiltration,
        sum(p) FILTER (month BETWEEN 5 AND 10) AS drawdown_pumping FROM (SELECT month_idx, avg(infiltration) AS i, sum(pumping) AS p FROM forcing GROUP BY 1) JOIN calendar USING (month_idx) GROUP BY 1""",
    ),
)
def d27(t: Tables) -> DataFrame:
    monthly = t.forcing.groupBy("month_idx").agg(F.avg("infiltration").alias("i"), F.sum("pumping").alias("p")).join(F.broadcast(t.calendar), "month_idx")
    dry = F.col("month").between(5, 10)
    return monthly.groupBy("year").agg(
        F.sum("i").alias("annual_infiltration"), F.sum("p").alias("annual_pumping"),
        F.sum(F.when(dry, F.col("i"))).alias("drawdown_infiltration"), F.sum(F.when(dry, F.col("p"))).alias("drawdown_pumping"),
    )


@query(
    "d28_class_depth_profile",
    "label:i layer:i median:f n_valid:i",
    with_blocks(
        "profile_layers",
        "SELECT label, layer, median(pow(10.0::DOUBLE, value)) AS median, count(value) AS n_valid FROM profile_layers JOIN embeddings ON vec_id = grid_id GROUP BY ALL",
    ),
)
def d28(t: Tables) -> DataFrame:
    cls = t.raw("embeddings").select(F.col("vec_id").alias("grid_id"), "label")
    res = t.profile_layers.join(cls, "grid_id").withColumn("res", sc.pow10(F.col("value")))
    return ranks.group_quantiles(res, ["label", "layer"], "res", {"median": 0.5}).withColumnRenamed("n", "n_valid")


@query(
    "d29_box_statistics",
    "segment:s n:i p05:f q1:f median:f q3:f p95:f",
    with_blocks(
        "obs",
        """SELECT c_mktsegment AS segment, count(*) AS n, quantile_cont(wtd, 0.05) AS p05, quantile_cont(wtd, 0.25) AS q1, median(wtd) AS median, quantile_cont(wtd, 0.75) AS q3,
        quantile_cont(wtd, 0.95) AS p95 FROM obs JOIN customer ON c_custkey = grid_id WHERE n_sites <> 2 GROUP BY 1""",
    ),
)
def d29(t: Tables) -> DataFrame:
    seg = t.raw("customer").select(F.col("c_custkey").alias("grid_id"), F.col("c_mktsegment").alias("segment"))
    d = t.obs.join(seg, "grid_id").withColumn("v", F.when(F.col("n_sites") == 2, F.lit(float("inf"))).otherwise(F.col("wtd")))
    return ag.box_statistics(d, ["segment"], "v")


@query(
    "d30_model_residuals",
    "grid_id:i r11:f r22:f r33:f r44:f r55:f",
    with_blocks(
        "predictions",
        "SELECT grid_id, " + ", ".join(f"avg(y_pred - y_true) FILTER (seed = {s}) AS r{s}" for s in SEEDS) + " FROM predictions WHERE split = 'test' GROUP BY 1",
    ),
)
def d30(t: Tables) -> DataFrame:
    wide = t.predictions.where("split = 'test'").groupBy("grid_id").pivot("seed", list(SEEDS)).agg(F.avg(F.col("y_pred") - F.col("y_true")))
    return wide.withColumnsRenamed({str(s): f"r{s}" for s in SEEDS})


@query(
    "d30_model_error_difference",
    "grid_id:i mean_error_diff:f n:i",
    with_blocks(
        "predictions",
        """SELECT grid_id, avg(a - b) AS mean_error_diff, count(*) AS n FROM (SELECT sample_key, grid_id, max(abs(y_pred - y_true)) FILTER (seed = 11) AS a, max(abs(y_pred - y_true)) FILTER (seed = 22) AS b
        FROM predictions WHERE split = 'test' GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def d30_diff(t: Tables) -> DataFrame:
    err = F.abs(F.col("y_pred") - F.col("y_true"))
    per_sample = t.predictions.where("split = 'test'").groupBy("sample_key", "grid_id").agg(
        F.max(F.when(F.col("seed") == 11, err)).alias("a"), F.max(F.when(F.col("seed") == 22, err)).alias("b")
    )
    return per_sample.groupBy("grid_id").agg(F.avg(F.col("a") - F.col("b")).alias("mean_error_diff"), F.count(F.lit(1)).alias("n"))


SCORED = ("sco", "SELECT sample_key, CAST(y_true > 0.3 AS INTEGER) AS y, floor(100 / (1 + exp(-ens_mean))) / 100 AS p FROM ensemble")


def scored(t: Tables) -> DataFrame:
    p = F.floor(F.lit(100.0) / (F.lit(1.0) + F.exp(-F.col("ens_mean")))) / F.lit(100.0)
    return staged_ensemble(t).select("sample_key", (F.col("y_true") > 0.3).cast("int").alias("y"), p.alias("p"))


@query(
    "d31_binary_evaluation",
    "n_rows:i n_pos:i cutoff:f tp:i fp:i fn:i precision:f recall:f roc_auc:f average_precision:f brier:f",
    with_blocks(
        "ensemble",
        """SELECT n_rows, n_pos, cutoff, tp, fp, fn, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, roc_auc, average_precision, brier FROM
        (SELECT count(*) AS n_rows, sum(y) AS n_pos, any_value(cutoff) AS cutoff, count(*) FILTER (p >= cutoff AND y = 1) AS tp, count(*) FILTER (p >= cutoff AND y = 0) AS fp,
        count(*) FILTER (p < cutoff AND y = 1) AS fn, avg(pow(p - y, 2)) AS brier FROM sco, (SELECT v[CAST(floor(q) AS BIGINT) + 1] + (v[CAST(ceil(q) AS BIGINT) + 1] - v[CAST(floor(q) AS BIGINT) + 1]) * (q - floor(q)) AS cutoff FROM
        (SELECT list_sort(list(p)) AS v, (1 - (1 - (count(*) - sum(y)) / count(*))) * (count(*) - 1) AS q FROM sco)))
        CROSS JOIN (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM
          (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM sco))
        CROSS JOIN (SELECT sum(pos / tot * cp / cn) AS average_precision FROM (SELECT pos, sum(pos) OVER () AS tot, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn
          FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM sco GROUP BY p)))""",
        SCORED,
    ),
)
def d31(t: Tables) -> DataFrame:
    return cl.binary_evaluation(scored(t), "p", "y")


@query(
    "d34_pooled_limits",
    "n:i lo:f hi:f below:b above:b",
    with_blocks(
        "panel calendar",
        """SELECT count(decline) AS n, quantile_cont(decline, 0.015) AS lo, quantile_cont(decline, 0.985) AS hi, min(decline) < quantile_cont(decline, 0.015) AS below,
        max(decline) > quantile_cont(decline, 0.985) AS above FROM decl""",
        DECLINE,
    ),
)
def d34(t: Tables) -> DataFrame:
    return ag.pooled_limits(e09(t), "decline", 0.015, 0.985)


@query(
    "d35_calibration_terms",
    "split:s term:f",
    with_blocks("predictions", "SELECT split, 0.3 * (1 - corr(y_pred, y_true)) + 0.2 * abs(stddev_pop(y_pred) - stddev_pop(y_true)) AS term FROM predictions GROUP BY 1"),
)
def d35(t: Tables) -> DataFrame:
    p, y = F.col("y_pred"), F.col("y_true")
    term = F.lit(0.3) * (1 - ag.pearson(p, y)) + F.lit(0.2) * F.abs(F.stddev_pop(p) - F.stddev_pop(y))
    return t.predictions.groupBy("split").agg(term.alias("term"))


# --- E: windows -----------------------------------------------------------------

@query(
    "e01_trailing_7_sum",
    "grid_id:i day:s week_sum:f",
    with_blocks(
        "daily",
        "SELECT grid_id, day, coalesce(sum(inches) OVER (PARTITION BY grid_id, date_trunc('month', day) ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS week_sum FROM dd",
        DAILY_DENSE,
    ),
)
def e01(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("grid_id", F.trunc("day", "month")).orderBy("day").rowsBetween(-6, 0)
    return dense_daily(t).select("grid_id", "day", F.coalesce(F.sum("inches").over(w), F.lit(0.0)).alias("week_sum"))


@query(
    "e02_forward_sum",
    "grid_id:i start_idx:i h:i sum_infiltration:f n_infiltration:i",
    with_blocks(
        "forcing",
        """SELECT grid_id, month_idx AS start_idx, 6 AS h, sum(infiltration) OVER w AS sum_infiltration, 6 AS n_infiltration FROM forcing
        WINDOW w AS (PARTITION BY grid_id ORDER BY month_idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) QUALIFY count(*) OVER w = 6""",
    ),
)
def e02(t: Tables) -> DataFrame:
    return joins.forward_sums(t.forcing, ["infiltration"], [6])


GAPPY = (
    "gappy",
    "SELECT c.month_idx, CASE WHEN c.month_idx % 7 <> 3 AND c.month_idx % 12 NOT IN (7, 8) THEN w END AS v FROM calendar c LEFT JOIN (SELECT month_idx, avg(wtd) AS w FROM panel GROUP BY 1) USING (month_idx)",
)


def gappy(t: Tables) -> DataFrame:
    m = t.panel.groupBy("month_idx").agg(F.avg("wtd").alias("w"))
    keep = (F.col("month_idx") % 7 != 3) & ~(F.col("month_idx") % 12).isin(7, 8)
    return t.calendar.select("month_idx").join(m, "month_idx", "left").select("month_idx", F.when(keep, F.col("w")).alias("v"))


@query("e03_linear_interpolation", "month_idx:i v:f filled:f", with_blocks("panel calendar", "SELECT * FROM gi", GAPPY, *interp_ctes("gappy", "v", "gi")))
def e03(t: Tables) -> DataFrame:
    return windows.interpolate_linear(gappy(t), [], "month_idx", "v", "filled")


@query("e04_centred_mean", "month_idx:i smooth:f", with_blocks("panel calendar", "SELECT * FROM gi", GAPPY, *interp_ctes("gappy", "v", "gi")))
def e04(t: Tables) -> DataFrame:
    return windows.regional_fill(gappy(t), "v", "smooth")


@query(
    "e05_percentile_rank",
    "grid_id:i month_idx:i wtd_rank:f n_days_rank:f part_rank:f",
    with_blocks(
        "obs",
        f"""SELECT grid_id, month_idx, {RANK_SQL.format(x='wtd')} AS wtd_rank, {RANK_SQL.format(x='n_days')} AS n_days_rank,
        CASE WHEN part IS NOT NULL THEN {RANK_SQL.format(x='part')} END AS part_rank FROM (SELECT *, CASE WHEN n_sites > 1 THEN wtd END AS part FROM obs)""",
    ),
)
def e05(t: Tables) -> DataFrame:
    d = t.obs.select("grid_id", "month_idx", "wtd", F.col("n_days").cast("double").alias("n_days"), F.when(F.col("n_sites") > 1, F.col("wtd")).alias("part"))
    return ranks.percentile_ranks(d, ["grid_id", "month_idx"], ["wtd", "n_days", "part"])


@query(
    "e06_season_extremes",
    "grid_id:i year:i low:f low_idx:i high:f high_idx:i",
    with_blocks(
        "panel calendar",
        """SELECT grid_id, year, min(v) AS low, min(month_idx) FILTER (v = lo) AS low_idx, max(v) AS high, min(month_idx) FILTER (v = hi) AS high_idx FROM
        (SELECT *, min(v) OVER (PARTITION BY grid_id, year) AS lo, max(v) OVER (PARTITION BY grid_id, year) AS hi FROM (SELECT grid_id, year, month_idx, floor(wtd * 4) AS v FROM panel JOIN calendar USING (month_idx) WHERE month BETWEEN 5 AND 10)) GROUP BY ALL""",
    ),
)
def e06(t: Tables) -> DataFrame:
    d = t.panel.join(F.broadcast(t.calendar), "month_idx").where(F.col("month").between(5, 10)).withColumn("v", F.floor(F.col("wtd") * 4))
    return d.groupBy("grid_id", "year").agg(
        F.min("v").alias("low"), windows.first_at_min(F.col("v"), F.col("month_idx")).alias("low_idx"),
        F.max("v").alias("high"), windows.first_at_max(F.col("v"), F.col("month_idx")).alias("high_idx"),
    )


DW = ev.DroughtWindows.of_year(1996, base_year=1995, recovery_year=2000)
DROUGHT = (
    (
        "ag0",
        """SELECT grid_id, min(wtd) FILTER (month_idx BETWEEN 12 AND 15) AS pre_wtd, max(wtd) FILTER (month_idx BETWEEN 16 AND 21) AS peak_wtd, min(wtd) FILTER (month_idx BETWEEN 22 AND 27) AS early_recovery_wtd,
        avg(wtd) FILTER (month_idx BETWEEN 0 AND 11) AS baseline_wtd, max(wtd) FILTER (month_idx BETWEEN 12 AND 23) AS annual_peak_wtd, avg(wtd) FILTER (month_idx BETWEEN 60 AND 71) AS late FROM panel GROUP BY 1""",
    ),
    (
        "ag1",
        """SELECT a.*, min(month_idx) FILTER (month_idx BETWEEN 12 AND 15 AND wtd = pre_wtd) AS pre_idx, min(month_idx) FILTER (month_idx BETWEEN 16 AND 21 AND wtd = peak_wtd) AS peak_idx,
        min(month_idx) FILTER (month_idx BETWEEN 22 AND 27 AND wtd = early_recovery_wtd) AS early_recovery_idx FROM ag0 a JOIN panel USING (grid_id) GROUP BY ALL""",
    ),
    (
        "ag2",
        """SELECT a.*, min(month_idx) FILTER (month_idx > peak_idx AND wtd <= peak_wtd - 0.5 * (peak_wtd - pre_wtd)) AS hit_idx FROM ag1 a JOIN panel USING (grid_id) GROUP BY ALL""",
    ),
    (
        "drought",
        """SELECT grid_id, pre_wtd, peak_wtd, pre_idx, peak_idx, greatest(peak_idx - pre_idx, 1) AS months_to_peak, CASE WHEN vd THEN decl END AS decline_m, CASE WHEN vd THEN decl / greatest(peak_idx - pre_idx, 1) END AS rdown,
        early_recovery_wtd, early_recovery_idx, CASE WHEN vd THEN peak_wtd - early_recovery_wtd END AS early_recovery_m, CASE WHEN vd THEN (peak_wtd - early_recovery_wtd) / decl END AS rr_early, CASE WHEN vd THEN hit_idx - peak_idx END AS t50,
        baseline_wtd, annual_peak_wtd, deficit, residual_deficit, CASE WHEN coalesce(deficit >= 0.10, FALSE) THEN (deficit - residual_deficit) / deficit END AS rr_late, vd AS valid_decline, coalesce(deficit >= 0.10, FALSE) AS valid_deficit FROM
        (SELECT *, peak_wtd - pre_wtd AS decl, coalesce(peak_wtd - pre_wtd >= 0.30, FALSE) AS vd, annual_peak_wtd - baseline_wtd AS deficit, late - baseline_wtd AS residual_deficit FROM ag2)""",
    ),
)


def drought(t: Tables) -> DataFrame:
    return ev.drought_metrics(t.panel, DW, FIRST_ORD)


@query("e07_first_passage", "grid_id:i peak_idx:i t50:i", with_blocks("panel", "SELECT * FROM drought", *DROUGHT))
def e07(t: Tables) -> DataFrame:
    return drought(t)


@query(
    "e08_drought_metrics",
    "grid_id:i pre_wtd:f peak_wtd:f pre_idx:i peak_idx:i months_to_peak:i decline_m:f rdown:f early_recovery_wtd:f early_recovery_idx:i early_recovery_m:f rr_early:f t50:i "
    "baseline_wtd:f annual_peak_wtd:f deficit:f residual_deficit:f rr_late:f valid_decline:b valid_deficit:b",
    with_blocks("panel", "SELECT * FROM drought", *DROUGHT),
)
def e08(t: Tables) -> DataFrame:
    return drought(t)


FRACTIONS = [("train", 0.7), ("validation", 0.13), ("test", 0.17)]


@query(
    "e10_seeded_split",
    "grid_id:i grid_split:s",
    with_blocks(
        "cells",
        """SELECT grid_id, CASE WHEN pos < c1 THEN 'train' WHEN pos < c2 THEN 'validation' ELSE 'test' END AS grid_split FROM
        (SELECT grid_id, row_number() OVER (ORDER BY ((grid_id + 42) * 2654435761) % 4294967296, grid_id) - 1 AS pos FROM cells),
        (SELECT max(edge) FILTER (i = 0) AS c1, max(edge) FILTER (i = 1) AS c2 FROM (SELECT i, sum(cnt) OVER (ORDER BY i) AS edge FROM
          (SELECT i, fl + CAST(row_number() OVER (ORDER BY fl - raw, i) <= n - sum(fl) OVER () AS INTEGER) AS cnt FROM
            (SELECT i, n, n * f AS raw, floor(n * f) AS fl FROM (SELECT count(*) AS n FROM cells), (VALUES (0, 0.7::DOUBLE), (1, 0.13::DOUBLE), (2, 0.17::DOUBLE)) fr(i, f)))))""",
    ),
)
def e10(t: Tables) -> DataFrame:
    return samples.seeded_cell_split(t.cells, 42, FRACTIONS)


@query(
    "e11_sample_ids",
    "sample_id:i split:s target_idx:i grid_id:i h:i",
    with_blocks("pairs", "SELECT row_number() OVER (ORDER BY split, target_idx, grid_id, h) - 1 AS sample_id, split, target_idx, grid_id, h FROM pairs WHERE split IS NOT NULL"),
)
def e11(t: Tables) -> DataFrame:
    return ranks.row_ids(t.pairs.where("split IS NOT NULL"), ["split", "target_idx"], "grid_id", ["grid_id", "h"], "sample_id")


@query(
    "e16_smooth_3x3",
    "grid_id:i v:f smoothed:f",
    with_blocks(
        "cells obs",
        """SELECT f.grid_id, f.v, CASE WHEN f.v IS NOT NULL THEN (SELECT median(g.v) FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) o(a, b)
        JOIN fld g ON g.grid_row = least(greatest(f.grid_row + a, 0), rm) AND g.grid_col = least(greatest(f.grid_col + b, 0), cm)) END AS smoothed
        FROM fld f, (SELECT max(grid_row) AS rm, max(grid_col) AS cm FROM cells)""",
        ("fld", "SELECT grid_id, grid_row, grid_col, CASE WHEN (grid_row + 2 * grid_col) % 9 <> 4 THEN w END AS v FROM cells LEFT JOIN (SELECT grid_id, avg(wtd) AS w FROM obs GROUP BY 1) USING (grid_id)"),
    ),
)
def e16(t: Tables) -> DataFrame:
    mean = t.obs.groupBy("grid_id").agg(F.avg("wtd").alias("w"))
    keep = (F.col("grid_row") + 2 * F.col("grid_col")) % 9 != 4
    field = t.cells.join(mean, "grid_id", "left").withColumn("v", F.when(keep, F.col("w")))
    return windows.smooth_3x3(field, "v")


# --- F: sorts and top-k ------------------------------------------------------------

@query(
    "f01_deterministic_order",
    "grid_id:i start_idx:i h:i delta_h:f",
    with_blocks("pairs", "SELECT grid_id, start_idx, h, delta_h FROM pairs ORDER BY 1, 2, 3"),
)
def f01(t: Tables) -> DataFrame:
    return ordered(t.pairs, "grid_id", "start_idx", "h")


@query(
    "f02_top_k_per_cell",
    "grid_id:i month_idx:i wtd:f rank:i",
    with_blocks("obs", "SELECT grid_id, month_idx, wtd, row_number() OVER (PARTITION BY grid_id ORDER BY wtd DESC, month_idx) AS rank FROM obs QUALIFY rank <= 3"),
)
def f02(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("grid_id").orderBy(F.desc("wtd"), "month_idx")
    return t.obs.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query(
    "f03_densest_cells",
    "grid_id:i n:i",
    with_blocks("pairs", "SELECT grid_id, count(*) AS n FROM pairs WHERE split = 'test' GROUP BY 1 ORDER BY n DESC, grid_id LIMIT 6"),
)
def f03(t: Tables) -> DataFrame:
    return t.pairs.where("split = 'test'").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grid_id").limit(6)


@query(
    "f05_keep_last",
    "o_custkey:i o_orderkey:i o_totalprice:f",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
)
def f05(t: Tables) -> DataFrame:
    return windows.keep_last(t.raw("orders").withColumn("seq", F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice", "seq"), ["o_custkey"], "seq")


@query(
    "f06_coordinate_check",
    "n:i max_error_m:f",
    with_blocks("cells", "SELECT count(*) AS n, max(abs(x - (cell_id % 100000) * 1000.0) + abs(y - (cell_id // 100000) * 1000.0)) AS max_error_m FROM cells"),
)
def f06(t: Tables) -> DataFrame:
    px = F.pmod(F.col("cell_id"), F.lit(100000)) * F.lit(1000.0)
    py = F.floor(F.col("cell_id") / 100000) * F.lit(1000.0)
    return t.cells.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("x") - px) + F.abs(F.col("y") - py)).alias("max_error_m"))


# --- H: profiles --------------------------------------------------------------------

@query(
    "h01_profile_view",
    "grid_id:i layer:i depth_m:f value:f n_first:i",
    "SELECT vec_id AS grid_id, i AS layer, 2.5 + 5.0 * i AS depth_m, CAST(embedding[i + 1] AS DOUBLE) AS value, 10 AS n_first FROM embeddings, range(64) t(i) WHERE 2.5 + 5.0 * i <= 150.0",
)
def h01(t: Tables) -> DataFrame:
    shallow = profiles.profile_view(t.profiles, DEPTHS, max_depth=150.0)
    first = profiles.profile_view(t.profiles, DEPTHS, first=10).select("grid_id", F.size("values").alias("n_first"))
    return shallow.join(first, "grid_id").select(
        "grid_id", "n_first", F.posexplode(F.arrays_zip("values", "depths_m")).alias("layer", "_s")
    ).select("grid_id", "n_first", "layer", F.col("_s.values").alias("value"), F.col("_s.depths_m").alias("depth_m"))


BANDS = [(0.0, 15.0), (15.0, 30.0), (30.0, 60.0), (60.0, 120.0), (120.0, 250.0)]
BAND_SQL = "CASE WHEN depth_m < 15 THEN 0 WHEN depth_m < 30 THEN 1 WHEN depth_m < 60 THEN 2 WHEN depth_m < 120 THEN 3 WHEN depth_m < 250 THEN 4 END"


@query(
    "h02_band_means",
    "grid_id:i band:i mean:f",
    with_blocks(
        "profile_layers",
        f"""SELECT grid_id, band, coalesce(m, avg(m) OVER (PARTITION BY band)) AS mean FROM (SELECT grid_id, {BAND_SQL} AS band, avg(CASE WHEN grid_id % 17 <> 5 OR depth_m > 15 THEN value END) AS m
        FROM profile_layers WHERE depth_m < 250 GROUP BY ALL)""",
    ),
)
def h02(t: Tables) -> DataFrame:
    holes = t.profile_layers.withColumn("value", F.when((F.col("grid_id") % 17 != 5) | (F.col("depth_m") > 15), F.col("value")))
    return profiles.band_means(holes, BANDS, DEPTHS)


TOP = 317
REGRID = (
    "rg",
    """SELECT grid_id, z, CASE WHEN d0 = d1 THEN v0 ELSE v0 + (v1 - v0) * (z - d0) / (d1 - d0) END AS value FROM
    (SELECT g.grid_id, g.z, p.depth_m AS d0, p.value AS v0, n.depth_m AS d1, n.value AS v1 FROM (SELECT vec_id AS grid_id, CAST(z AS INTEGER) AS z FROM embeddings, range(318) t(z)) g
    ASOF LEFT JOIN (SELECT * FROM profile_layers WHERE value IS NOT NULL) p ON p.grid_id = g.grid_id AND p.depth_m <= g.z
    ASOF LEFT JOIN (SELECT * FROM profile_layers WHERE value IS NOT NULL) n ON n.grid_id = g.grid_id AND n.depth_m >= g.z)""",
)


def regridded(t: Tables) -> DataFrame:
    return profiles.regrid_profile(t.profile_layers, TOP)


@query("h03_regrid_profile", "grid_id:i z:i value:f", with_blocks("profile_layers", "SELECT * FROM rg", REGRID))
def h03(t: Tables) -> DataFrame:
    return regridded(t)


FEATURE_BANDS = [(0, 15), (15, 30), (30, 50), (50, 100), (100, 150), (150, 200), (200, 300)]
FEATS = (
    "fts",
    "SELECT grid_id, "
    + ", ".join(f"avg(value) FILTER (z >= {a} AND z < {b}) AS band_{a}_{b}" for a, b in FEATURE_BANDS + [(0, 50), (50, 150), (150, 300)])
    + """, count(*) FILTER (value >= 0.10) AS high_thickness, count(*) FILTER (value <= 0.0) AS low_thickness,
    coalesce(sum(greatest(0.0 - value, 0)) FILTER (z >= 50 AND z < 200), 0) AS barrier_strength FROM rg GROUP BY 1""",
)


def structure(t: Tables) -> DataFrame:
    return profiles.structure_features(regridded(t), 0.10, 0.0, FEATURE_BANDS)


@query(
    "h04_band_features",
    "grid_id:i " + " ".join(f"band_{a}_{b}:f" for a, b in FEATURE_BANDS) + " high_thickness:i low_thickness:i",
    with_blocks("profile_layers", "SELECT * FROM fts", REGRID, FEATS),
)
def h04(t: Tables) -> DataFrame:
    return structure(t)


@query(
    "h05_longest_run",
    "grid_id:i longest_high_run:i",
    with_blocks(
        "profile_layers",
        """SELECT grid_id, coalesce(max(len), 0) AS longest_high_run FROM (SELECT vec_id AS grid_id FROM embeddings) LEFT JOIN (SELECT grid_id, isle, count(*) AS len FROM
        (SELECT grid_id, z, z - row_number() OVER (PARTITION BY grid_id ORDER BY z) AS isle FROM rg WHERE value >= 0.10) GROUP BY ALL) USING (grid_id) GROUP BY 1""",
        REGRID,
    ),
)
def h05(t: Tables) -> DataFrame:
    return structure(t)


@query(
    "h06_structure_contrasts",
    "grid_id:i barrier_strength:f sandwich_contrast:f shallow_minus_middle:f middle_minus_deep:f shallow_minus_deep:f",
    with_blocks(
        "profile_layers",
        """SELECT grid_id, barrier_strength, 0.5 * (band_0_50 + band_150_300) - band_50_150 AS sandwich_contrast, band_0_50 - band_50_150 AS shallow_minus_middle,
        band_50_150 - band_150_300 AS middle_minus_deep, band_0_50 - band_150_300 AS shallow_minus_deep FROM fts""",
        REGRID, FEATS,
    ),
)
def h06(t: Tables) -> DataFrame:
    return structure(t)


@query(
    "e17_band_differences",
    "grid_id:i " + " ".join(f"delta_{i}:f" for i in range(6)),
    with_blocks(
        "profile_layers",
        "SELECT grid_id, "
        + ", ".join(f"band_{c}_{d} - band_{a}_{b} AS delta_{i}" for i, ((a, b), (c, d)) in enumerate(zip(FEATURE_BANDS[:-1], FEATURE_BANDS[1:])))
        + " FROM fts",
        REGRID, FEATS,
    ),
)
def e17(t: Tables) -> DataFrame:
    return structure(t)


@query(
    "h07_layer_statistics",
    "grid_id:i mean:f std:f value_range:f valid_fraction:f max_valid_depth:f",
    with_blocks(
        "profile_layers",
        """SELECT grid_id, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS value_range, count(value) / count(*) AS valid_fraction,
        max(depth_m) FILTER (value IS NOT NULL) AS max_valid_depth FROM profile_layers GROUP BY 1""",
    ),
)
def h07(t: Tables) -> DataFrame:
    return profiles.layer_statistics(t.profile_layers)


NATIVE = [f"native_{d:.1f}m".replace(".", "p") for d in DEPTHS]


@query(
    "h08_native_columns",
    "grid_id:i " + " ".join(f"{n}:f" for n in NATIVE),
    "SELECT vec_id AS grid_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(NATIVE)) + " FROM embeddings",
)
def h08(t: Tables) -> DataFrame:
    return profiles.native_columns(t.profiles, DEPTHS)


# --- C18, E18, L: classes -----------------------------------------------------------

def rank_of(x: str) -> str:
    return f"(rank() OVER (PARTITION BY {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER ()"


RANKS = (
    (
        "rin",
        """SELECT grid_id, decline_m AS decline, rdown, least(greatest(rr_early, 0.0), 2.0) AS rr_early, least(greatest(t50, 1.0), 72.0) AS t50,
        CASE WHEN rr_late IS NOT NULL THEN least(greatest(rr_late, -1.0), 5.0) END AS rr_late FROM drought WHERE decline_m IS NOT NULL AND rdown IS NOT NULL AND rr_early IS NOT NULL AND t50 IS NOT NULL""",
    ),
    (
        "rks",
        f"""SELECT grid_id, {rank_of('decline')} AS decline_rank, {rank_of('rdown')} AS rdown_rank, {rank_of('rr_early')} AS rr_early_rank, {rank_of('t50')} AS t50_rank,
        coalesce(1 - CASE WHEN rr_late IS NOT NULL THEN {rank_of('rr_late')} END, 0.5) AS deficit_rank FROM rin""",
    ),
)


def distance_sql(name: str) -> str:
    p = next(p for p in cl.prototypes() if p.name == name)
    return " + ".join(f"{w!r}::DOUBLE * abs({f} - {t!r}::DOUBLE)" for f, t, w in zip(cl.FEATURES, p.target, p.weight))


DIST = (
    "dst",
    " UNION ALL ".join(f"SELECT grid_id, {i} AS o, '{c}' AS name, {distance_sql(c)} AS d FROM rks" for i, c in enumerate(cl.CLASSES)),
)


@query(
    "c18_prototype_distances",
    "grid_id:i name:s distance:f",
    with_blocks("panel", "SELECT grid_id, name, d AS distance FROM dst", *DROUGHT, *RANKS, DIST),
)
def c18(t: Tables) -> DataFrame:
    return cl.prototype_distances(cl.response_ranks(drought(t))).select("grid_id", F.inline("scored"))


GATE_SQL = "decline_rank <= 0.22 AND rdown_rank <= 0.28 AND deficit_rank <= 0.40"
LABELS = (
    (
        "picked",
        f"""SELECT r.*, CASE WHEN {GATE_SQL} THEN 'Buffered' ELSE (SELECT name FROM dst WHERE dst.grid_id = r.grid_id ORDER BY d, o LIMIT 1) END AS response_class,
        CASE WHEN {GATE_SQL} THEN 'weak_response_gate' ELSE 'nearest_prototype' END AS assignment_rule FROM rks r""",
    ),
    (
        "labels_",
        """SELECT p.*, 1 - b.d AS best_score, s.name AS second_class, 1 - s.d AS second_score, s.d - b.d AS score_margin FROM picked p JOIN dst b ON b.grid_id = p.grid_id AND b.name = response_class
        JOIN (SELECT x.* FROM dst x JOIN picked q ON q.grid_id = x.grid_id AND x.name <> q.response_class QUALIFY row_number() OVER (PARTITION BY x.grid_id ORDER BY d, o) = 1) s ON s.grid_id = p.grid_id""",
    ),
)


@query(
    "e18_best_and_second",
    "grid_id:i response_class:s best_score:f second_class:s second_score:f score_margin:f",
    with_blocks("panel", "SELECT * FROM labels_", *DROUGHT, *RANKS, DIST, *LABELS),
)
def e18(t: Tables) -> DataFrame:
    return cl.best_and_second(cl.prototype_distances(cl.response_ranks(drought(t))), cl.buffered_gate(), "Buffered")


@query(
    "l01_prototype_classifier",
    "grid_id:i valid_for_clustering:b response_class:s best_score:f second_class:s second_score:f score_margin:f assignment_rule:s decline_rank:f rdown_rank:f rr_early_rank:f t50_rank:f deficit_rank:f",
    with_blocks(
        "panel",
        "SELECT d.grid_id, response_class IS NOT NULL AS valid_for_clustering, l.* EXCLUDE (grid_id) FROM drought d LEFT JOIN labels_ l USING (grid_id)",
        *DROUGHT, *RANKS, DIST, *LABELS,
    ),
)
def l01(t: Tables) -> DataFrame:
    return cl.classify_responses(drought(t))


@query(
    "l02_spatial_blocks",
    "grid_id:i block:i",
    with_blocks("cells", "SELECT grid_id, CAST(floor((x - min(x) OVER ()) / 5000.0) * 1000 + floor((y - min(y) OVER ()) / 5000.0) AS BIGINT) AS block FROM cells"),
)
def l02(t: Tables) -> DataFrame:
    return cl.spatial_blocks(t.cells, 5000.0)


@query(
    "l03_group_folds",
    "grid_id:i block:i fold:i",
    with_blocks(
        "cells",
        """SELECT grid_id, block, CASE WHEN pos % 10 < 5 THEN pos % 10 ELSE 9 - pos % 10 END AS fold FROM blk JOIN (SELECT block, row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS pos FROM blk GROUP BY block) USING (block)""",
        ("blk", "SELECT grid_id, CAST(floor((x - min(x) OVER ()) / 5000.0) * 1000 + floor((y - min(y) OVER ()) / 5000.0) AS BIGINT) AS block FROM cells"),
    ),
)
def l03(t: Tables) -> DataFrame:
    return cl.block_folds(cl.spatial_blocks(t.cells, 5000.0), 5)


@query(
    "l05_overlap_codes",
    "code:i n:i",
    with_blocks(
        "ensemble",
        "SELECT y + 2 * CAST(p >= (SELECT quantile_cont(p, 0.8) FROM sco) AS INTEGER) AS code, count(*) AS n FROM sco GROUP BY 1",
        SCORED,
    ),
)
def l05(t: Tables) -> DataFrame:
    s = scored(t)
    cut = ranks.group_quantiles(s, [], "p", {"cut": 0.8}).select("cut").scalar()
    return s.groupBy(cl.overlap_code(F.col("y") == 1, F.col("p") >= cut).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "l06_model_comparison",
    "seed:i train:f validation:f test:f",
    with_blocks(
        "predictions",
        "SELECT seed, " + ", ".join(f"sqrt(avg(pow(y_pred - y_true, 2)) FILTER (split = '{s}')) AS {s}" for s in ("train", "validation", "test")) + " FROM predictions GROUP BY 1",
    ),
)
def l06(t: Tables) -> DataFrame:
    rows = t.predictions.groupBy("seed", "split").agg(*ag.regression_metrics("y_pred", "y_true"))
    return rows.groupBy("seed").pivot("split", ["train", "validation", "test"]).agg(F.first("rmse"))


# --- K: uncertainty -------------------------------------------------------------------

@query(
    "k04_extend_calibration",
    "h:i level:f qhat:f n_calibration:i",
    with_blocks("ensemble", f"SELECT * FROM ({qhat_sql(NORM_SCORE, (0.90, 0.95))}) UNION ALL SELECT * FROM ({qhat_sql(NORM_SCORE, (0.75,))})"),
)
def k04(t: Tables) -> DataFrame:
    return cf.extend_calibration(normalised(t, (0.90, 0.95)), lambda levels: normalised(t, tuple(levels)), [0.75, 0.95])
