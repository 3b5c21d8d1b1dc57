"""Queries for anchoring, interpolation and reconstruction (E12-E15, I4-I6, J)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import anchors as an
from gridloom.operators import reconstruct, solver, uncertainty
from gridloom.plans import recon_sql as rs
from gridloom.plans.joins_q import LEAF
from gridloom.plans.panel_q import ANCH, FIELD_CTES, anchor_field_table, anomalies
from gridloom.plans.predict_q import BLOCKS, FITTED, GRAPH, edges, packed_cells, predictor
from gridloom.plans.registry import query
from gridloom.plans.sqlbase import with_blocks
from gridloom.plans.tables import N_MONTHS, Tables
from gridloom.session import scratch_path, written
from gridloom.sources import sinks

ROUNDS = 4
#: queries converge far below the default, so that another engine's solution rounds alike
TIGHT = {"rtol": 1e-13}
EXACT, ALPHA, SCALE = 2, 0.05, 8.0
LOCAL = dict(alpha_min=0.70, alpha_max=0.80, gap_scale=48.0, edge_window=12, edge_alpha=0.50, single_alpha=0.08, single_scale=8.0)

OBSN = (
    "obsn",
    "SELECT grid_id, month_idx, anomaly AS value, quality, count(*) OVER (PARTITION BY grid_id) AS n_months FROM anom",
)
ANCHOR_CELLS = ("acell", "SELECT grid_id, month_idx FROM cells, anch")
PRIORS = rs.priors("priors", "obsn", "acell", 18, 3, 60.0)


def observed(t: Tables) -> DataFrame:
    """Anomaly observations with quality and the cell's number of observed months."""
    per_cell = Window.partitionBy("grid_id")
    return t.stage(
        "observed",
        lambda: anomalies(t).select(
            "grid_id", "month_idx", F.col("anomaly").alias("value"), "quality", F.count(F.lit(1)).over(per_cell).alias("n_months")
        ),
    )


def anchor_list(t: Tables) -> list[int]:
    return sorted(r[0] for r in an.anchor_months(t.calendar).select("month_idx").collect())


def anchor_priors(t: Tables) -> DataFrame:
    return an.local_priors(observed(t), an.anchor_grid(t.cells, an.anchor_months(t.calendar)), 2, 18, 3, 60.0)


# --- E12-E15: local anchoring ----------------------------------------------------

WAVE = ("wavep", "SELECT grid_id, month_idx, 0.4::DOUBLE * sin(month_idx * 0.5::DOUBLE + grid_id % 7) AS value FROM baseline, calendar")
ANCHORED = (ANOM := FIELD_CTES[0], OBSN, WAVE, *rs.local_anchors("la", "wavep", "obsn", **LOCAL))


def anchored(t: Tables) -> DataFrame:
    wave = F.lit(0.4) * F.sin(F.col("month_idx") * F.lit(0.5) + F.pmod(F.col("grid_id"), F.lit(7)))
    panel = t.baseline.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("month_idx")).withColumn("value", wave)
    return an.apply_local_anchors(panel, observed(t), **LOCAL)


@query("e12_bridge", "grid_id:i month_idx:i mode:s value:f", with_blocks(BLOCKS, "SELECT * FROM la WHERE mode IN ('bridge', 'exact')", *ANCHORED))
def e12(t: Tables) -> DataFrame:
    return anchored(t).where("mode IN ('bridge', 'exact')")


@query("e13_edge_taper", "grid_id:i month_idx:i value:f", with_blocks(BLOCKS, "SELECT * FROM la WHERE mode = 'edge'", *ANCHORED))
def e13(t: Tables) -> DataFrame:
    return anchored(t).where("mode = 'edge'")


@query("e14_single_observation", "grid_id:i month_idx:i mode:s value:f", with_blocks(BLOCKS, "SELECT * FROM la WHERE mode IN ('single_obs', 'none')", *ANCHORED))
def e14(t: Tables) -> DataFrame:
    return anchored(t).where("mode IN ('single_obs', 'none')")


@query(
    "e15_local_priors",
    "grid_id:i month_idx:i n_obs:i mode:s prior_value:f prior_weight:f",
    with_blocks(BLOCKS, "SELECT * FROM priors", ANOM, OBSN, ANCH, ANCHOR_CELLS, *PRIORS),
)
def e15(t: Tables) -> DataFrame:
    return anchor_priors(t)


# --- I4-I6: regularised interpolation ------------------------------------------------

SPARSE_SYS = ("sparse", "SELECT grid_id, month_idx, value, greatest(quality, 1.0) AS quality FROM obsn JOIN anch USING (month_idx)")


@query(
    "i04_interpolation_fixed_steps",
    "grid_id:i month_idx:i value:f",
    with_blocks(BLOCKS, "SELECT * FROM sol", ANOM, OBSN, ANCH, *GRAPH, SPARSE_SYS, *rs.pcg("sol", "sparse", 1.0, ROUNDS)),
)
def i04(t: Tables) -> DataFrame:
    at_anchor = observed(t).join(F.broadcast(an.anchor_months(t.calendar).select("month_idx")), "month_idx", "left_semi")
    return solver.interpolate_fields(t.cells, edges(t), at_anchor, fixed_iterations=ROUNDS)


SYSTEM = (
    "bsys",
    """SELECT f.grid_id, f.month_idx, coalesce(o.value, p.prior_value, f.field) AS value, CASE WHEN o.grid_id IS NOT NULL THEN greatest(o.quality, 1.0)
    WHEN p.grid_id IS NOT NULL THEN greatest(p.prior_weight * 5.0, 0.10) ELSE f.field_quality END AS quality, o.grid_id IS NOT NULL AS is_obs
    FROM fields f LEFT JOIN obsn o ON o.grid_id = f.grid_id AND o.month_idx = f.month_idx LEFT JOIN priors p ON p.grid_id = f.grid_id AND p.month_idx = f.month_idx""",
)
BACKGROUND = (*FIELD_CTES, OBSN, ANCHOR_CELLS, *PRIORS, *GRAPH, SYSTEM, *rs.converged("bg", "bsys", 1.0, exact="is_obs"))


def background(t: Tables, **kw) -> DataFrame:
    at_anchor = observed(t).join(F.broadcast(an.anchor_months(t.calendar).select("month_idx")), "month_idx", "left_semi")
    return solver.anchor_background(t.cells, edges(t), at_anchor, anchor_field_table(t), anchor_priors(t), **kw)


@query("i05_anchor_background", "grid_id:i month_idx:i value:f4", with_blocks(BLOCKS, "SELECT * FROM bg", *BACKGROUND))
def i05(t: Tables) -> DataFrame:
    return background(t, **TIGHT)


CONVERGED = (ANOM, OBSN, ANCH, *GRAPH, SPARSE_SYS, *rs.converged("sol", "sparse", 1.0))


@query("i04_interpolation_converged", "grid_id:i month_idx:i value:f4", with_blocks(BLOCKS, "SELECT * FROM sol", *CONVERGED))
def i04_converged(t: Tables) -> DataFrame:
    at_anchor = observed(t).join(F.broadcast(an.anchor_months(t.calendar).select("month_idx")), "month_idx", "left_semi")
    return solver.interpolate_fields(t.cells, edges(t), at_anchor, **TIGHT)


BLENDED = (
    "blend",
    """SELECT b.grid_id, b.month_idx, CASE WHEN o.grid_id IS NULL AND p.grid_id IS NOT NULL THEN b.value + p.prior_weight * (p.prior_value - b.value) ELSE b.value END AS value
    FROM sol b LEFT JOIN obsn o ON o.grid_id = b.grid_id AND o.month_idx = b.month_idx LEFT JOIN priors p ON p.grid_id = b.grid_id AND p.month_idx = b.month_idx""",
)


@query(
    "i05_anchor_background_blended",
    "grid_id:i month_idx:i value:f4",
    with_blocks(BLOCKS, "SELECT * FROM blend", *CONVERGED, ANCHOR_CELLS, *PRIORS, BLENDED),
)
def i05_blended(t: Tables) -> DataFrame:
    at_anchor = observed(t).join(F.broadcast(an.anchor_months(t.calendar).select("month_idx")), "month_idx", "left_semi")
    return solver.anchor_background(
        t.cells, edges(t), at_anchor, None, anchor_priors(t), smooth_priors=False, **TIGHT
    )


def diffusion_ctes(name: str, panel: str, lam: float) -> rs.Ctes:
    return (
        (
            f"{name}_sys",
            f"""SELECT o.grid_id, o.month_idx, o.value - p.value AS value, greatest(o.quality, 1.0) AS quality FROM obsn o JOIN {panel} p USING (grid_id, month_idx)
            WHERE o.month_idx IN (SELECT month_idx FROM obsn GROUP BY 1 HAVING count(*) >= 20)""",
        ),
        *rs.converged(f"{name}_f", f"{name}_sys", lam),
        (
            f"{name}_d",
            f"""SELECT p.grid_id, p.month_idx, p.value AS old, o.value AS ov, 0.70::DOUBLE * least(greatest(f.value, -2.50), 2.50) AS correction, f.grid_id IS NOT NULL AS hit FROM {panel} p
            LEFT JOIN {name}_f f ON f.grid_id = p.grid_id AND f.month_idx = p.month_idx LEFT JOIN obsn o ON o.grid_id = p.grid_id AND o.month_idx = p.month_idx""",
        ),
        (name, f"SELECT grid_id, month_idx, old, ov, correction, hit, CASE WHEN hit THEN coalesce(ov, old + correction) ELSE old END AS value FROM {name}_d"),
    )


def diffused(t: Tables) -> tuple[DataFrame, DataFrame]:
    panel = anchored(t).drop("mode")
    # a panel that does not yet hold the observations, so that residuals remain
    return solver.residual_diffusion(panel, t.cells, edges(t), shifted_obs(t), lam=1.25, **TIGHT)


def shifted_obs(t: Tables) -> DataFrame:
    return observed(t).withColumn("value", F.col("value") + F.lit(0.3) * F.cos("month_idx"))


SHIFTED = ("obsn", "SELECT * REPLACE (value + 0.3::DOUBLE * cos(month_idx) AS value) FROM obsn0")
DIFF_SQL = (
    ANOM, ("obsn0", OBSN[1]), WAVE, *rs.local_anchors("la", "wavep", "obsn0", **LOCAL), SHIFTED, *GRAPH, *diffusion_ctes("df", "la", 1.25)
)


@query("i06_residual_diffusion", "grid_id:i month_idx:i value:f4", with_blocks(BLOCKS, "SELECT grid_id, month_idx, value FROM df", *DIFF_SQL))
def i06(t: Tables) -> DataFrame:
    return diffused(t)[0]


@query(
    "d33_residual_report",
    "month_idx:i observation_count:i pre_rmse:f4 post_rmse:f4 pre_bias:f4 post_bias:f4 mean_abs_correction:f4 p95_abs_correction:f4",
    with_blocks(
        BLOCKS,
        """SELECT month_idx, count(ov) AS observation_count, sqrt(avg(pow(ov - old, 2))) AS pre_rmse, sqrt(avg(pow(ov - value, 2))) AS post_rmse, avg(ov - old) AS pre_bias, avg(ov - value) AS post_bias,
        avg(abs(correction)) AS mean_abs_correction, quantile_cont(abs(correction), 0.95) AS p95_abs_correction FROM df WHERE hit GROUP BY 1""",
        *DIFF_SQL,
    ),
)
def d33(t: Tables) -> DataFrame:
    return diffused(t)[1]


# --- J: assimilation and reconstruction ------------------------------------------------

@query(
    "j01_assimilate",
    "grid_id:i month_idx:i state:f",
    with_blocks(
        BLOCKS,
        f"SELECT w.grid_id, w.month_idx, {rs.assimilated('w.value', 'o.value', 'o.quality', 'o.n_months', 3, 0.12, 6.0)} AS state FROM wavep w LEFT JOIN obsn o ON o.grid_id = w.grid_id AND o.month_idx = w.month_idx",
        ANOM, OBSN, WAVE,
    ),
)
def j01(t: Tables) -> DataFrame:
    wave = F.lit(0.4) * F.sin(F.col("month_idx") * F.lit(0.5) + F.pmod(F.col("grid_id"), F.lit(7)))
    states = t.baseline.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(N_MONTHS - 1))).alias("month_idx")).withColumn("state", wave)
    return an.assimilate(states, observed(t), exact_min=3)


@query(
    "j02_harmonic_fit",
    "grid_id:i n_obs:i c0:f4 c1:f4 c2:f4 c3:f4 c4:f4 c5:f4 r2:f4",
    with_blocks(BLOCKS, "SELECT * FROM hf", ANOM, OBSN, *rs.harmonic("hf", "obsn")),
)
def j02_fit(t: Tables) -> DataFrame:
    return an.harmonic_fit(observed(t))


@query(
    "j02_harmonic_pseudo_obs",
    "grid_id:i month_idx:i value:f4 quality:f4 is_pseudo:b",
    with_blocks(
        BLOCKS,
        """SELECT grid_id, month_idx, value, quality, FALSE AS is_pseudo FROM obsn UNION ALL
        SELECT f.grid_id, f.month_idx, f.value, least(greatest(0.30 * r2 * exp(-g / 6.0), 0.05), 0.99), TRUE FROM
        (SELECT h.*, least(h.month_idx - p.month_idx, n.month_idx - h.month_idx) AS g0, coalesce(least(h.month_idx - p.month_idx, n.month_idx - h.month_idx), h.month_idx - p.month_idx, n.month_idx - h.month_idx) AS g
        FROM hf_fit h ASOF LEFT JOIN obsn p ON p.grid_id = h.grid_id AND p.month_idx <= h.month_idx ASOF LEFT JOIN obsn n ON n.grid_id = h.grid_id AND n.month_idx >= h.month_idx) f WHERE g > 0""",
        ANOM, OBSN, *rs.harmonic("hf", "obsn"),
    ),
)
def j02(t: Tables) -> DataFrame:
    return an.harmonic_pseudo_obs(observed(t), N_MONTHS)


CFG = reconstruct.Settings(
    paths=uncertainty.greedy_paths(12), exact_min=EXACT, single_alpha=ALPHA, single_scale=SCALE, split_rmse=1.31, split_p95=9.0,
    solver=TIGHT,
)
COUNTS = ("mcount", "SELECT month_idx, count(*) AS n_month FROM obsn GROUP BY 1")


FIELD_STATES = ("astate", "SELECT grid_id, month_idx, field AS value FROM fields")
SEG0 = (
    "seg0",
    """SELECT l.ix AS segment_id, a.grid_id, left_idx, right_idx, a.value AS state FROM (SELECT *, row_number() OVER (ORDER BY left_idx) - 1 AS ix FROM leaf) l JOIN astate a ON a.month_idx = left_idx""",
)


def segment_ctes(prefix: str, seg: str, anchors: str, top: int = rs.TOP) -> rs.Ctes:
    return (
        *rs.propagate(f"{prefix}p", seg, "drv", "obsn", EXACT, ALPHA, SCALE, top),
        *rs.endpoints(f"{prefix}e", f"{prefix}p", anchors, "mcount", EXACT, ALPHA, SCALE, top),
        *rs.corrected(f"{prefix}c", f"{prefix}e", top),
        *rs.summary(f"{prefix}s", f"{prefix}e"),
    )


def renamed(ctes) -> list[tuple[str, str]]:
    """``as`` is a keyword, so the first summary is called ``asm``."""
    return [("asm" if n == "as" else n, q) for n, q in ctes]


FIRST = (*FIELD_CTES, OBSN, LEAF, *FITTED, COUNTS, FIELD_STATES, SEG0, *segment_ctes("a", "seg0", "astate"))


def stored_cells(t: Tables) -> DataFrame:
    """A row per cell with its inputs, observations and anchor fields."""
    return packed_cells(t, lambda: anchor_field_table(t).select("grid_id", "month_idx", F.col("field").alias("value")))


def field_states(t: Tables) -> DataFrame:
    return stored_cells(t).select("grid_id", F.inline("states"))


def month_counts(t: Tables) -> DataFrame:
    return t.stored_obs.groupBy("month_idx").agg(F.count(F.lit(1)).alias("n_month"))


#: the same with anchors every 24 months, and the months after the last of them
LEAF24 = ("leaf", "SELECT * FROM (VALUES (0, 24), (24, 48), (48, 72)) l(left_idx, right_idx)")
WIDE = (*FIELD_CTES, OBSN, LEAF24, *FITTED, COUNTS, FIELD_STATES, SEG0, *segment_ctes("a", "seg0", "astate", 24))
TAIL = (
    *FIELD_CTES, OBSN, *FITTED, FIELD_STATES,
    ("seg0", "SELECT -1 AS segment_id, grid_id, 60 AS left_idx, 83 AS right_idx, value AS state FROM astate WHERE month_idx = 60"),
    *rs.propagate("ap", "seg0", "drv", "obsn", EXACT, ALPHA, SCALE, 23),
)
CFG24 = replace(CFG, paths=uncertainty.greedy_paths(24))


def propagated(t: Tables, anchors: list[int], cfg: reconstruct.Settings) -> DataFrame:
    """Intervals as rows of their own, which is the general form."""
    seg = reconstruct.root_segments(field_states(t), anchors)
    return reconstruct.propagate(seg, predictor(t), observed(t), cfg)


def propagated_cells(t: Tables, anchors: list[int], cfg: reconstruct.Settings) -> DataFrame:
    cells = stored_cells(t)  # before the predictor, which reads the same table
    return reconstruct.propagate_cells(cells, list(zip(anchors[:-1], anchors[1:])), predictor(t), cfg)


def endpoints(t: Tables, anchors: list[int], cfg: reconstruct.Settings) -> DataFrame:
    return reconstruct.correct_endpoint(propagated_cells(t, anchors, cfg), month_counts(t), cfg)


STATE_SPEC = "segment_id:i grid_id:i gap:i k:i state:f"


@query("j03_propagate", STATE_SPEC, with_blocks(BLOCKS, "SELECT * FROM al", *renamed(FIRST), *rs.state_rows("al", "ap")))
def j03(t: Tables) -> DataFrame:
    return reconstruct.state_rows(propagated(t, anchor_list(t), CFG))


@query("j03_propagate_long_gaps", STATE_SPEC, with_blocks(BLOCKS, "SELECT * FROM al", *renamed(WIDE), *rs.state_rows("al", "ap", 24)))
def j03_long(t: Tables) -> DataFrame:
    return reconstruct.state_rows(propagated(t, [0, 24, 48, 72], CFG24))


@query("j03_extrapolate_tail", "grid_id:i month_idx:i value:f", with_blocks(BLOCKS, "SELECT grid_id, 60 + k AS month_idx, state AS value FROM al WHERE k > 0", *TAIL, *rs.state_rows("al", "ap", 23)))
def j03_tail(t: Tables) -> DataFrame:
    return reconstruct.extrapolate_tail(field_states(t), 60, 83, predictor(t), observed(t), CFG24)


@query("j04_endpoint_correction", "segment_id:i grid_id:i month_idx:i value:f", with_blocks(BLOCKS, "SELECT * FROM ac", *renamed(FIRST)))
def j04(t: Tables) -> DataFrame:
    return reconstruct.corrected_months(endpoints(t, anchor_list(t), CFG))


@query("j04_endpoint_correction_long_gaps", "segment_id:i grid_id:i month_idx:i value:f", with_blocks(BLOCKS, "SELECT * FROM ac", *renamed(WIDE)))
def j04_long(t: Tables) -> DataFrame:
    return reconstruct.corrected_months(endpoints(t, [0, 24, 48, 72], CFG24))


@query(
    "d32_segment_summary",
    "segment_id:i left_idx:i right_idx:i n:i rmse:f mae:f bias:f p95_abs_diff:f alpha_mean:f alpha_p05:f alpha_p50:f alpha_p95:f",
    with_blocks(BLOCKS, "SELECT * FROM asm", *renamed(FIRST)),
)
def d32(t: Tables) -> DataFrame:
    return reconstruct.segment_summary(endpoints(t, anchor_list(t), CFG))


def split_ctes(anchors: str) -> rs.Ctes:
    """Flag, split and redo: left halves, then right halves from their ends."""
    return (
        (
            "cuts",
            f"""SELECT segment_id, left_idx, right_idx, cut FROM (SELECT segment_id, left_idx, right_idx, rmse, p95_abs_diff, left_idx + CASE WHEN right_idx - left_idx >= 18 THEN 12 WHEN right_idx - left_idx >= 12 THEN 6
            ELSE (right_idx - left_idx) // 2 END AS cut FROM asm) WHERE right_idx - left_idx > 6 AND (rmse > 1.31 OR p95_abs_diff > 9.0) AND cut IN (SELECT month_idx FROM mcount)""",
        ),
        ("ssys", "SELECT grid_id, month_idx, value, greatest(quality, 1.0) AS quality FROM obsn WHERE month_idx IN (SELECT cut FROM cuts)"),
        *rs.converged("mid", "ssys", 1.0),
        ("ast2", f"SELECT grid_id, month_idx, value FROM {anchors} UNION ALL SELECT grid_id, month_idx, value FROM mid"),
        ("seg1", "SELECT s.segment_id, s.grid_id, s.left_idx, c.cut AS right_idx, s.state FROM seg0 s JOIN cuts c USING (segment_id)"),
        *segment_ctes("b", "seg1", "ast2"),
        (
            "seg2",
            "SELECT c.segment_id, b.grid_id, c.cut AS left_idx, c.right_idx, b.value AS state FROM cuts c JOIN bc b ON b.segment_id = c.segment_id AND b.month_idx = c.cut",
        ),
        *segment_ctes("c", "seg2", "ast2"),
        (
            "pieces",
            """SELECT segment_id, grid_id, month_idx, value FROM ac WHERE segment_id NOT IN (SELECT segment_id FROM cuts) UNION ALL
            SELECT b.segment_id, b.grid_id, b.month_idx, b.value FROM bc b JOIN cuts USING (segment_id) WHERE b.month_idx < cut UNION ALL SELECT segment_id, grid_id, month_idx, value FROM cc""",
        ),
    )


@query(
    "j05_adaptive_split",
    "segment_id:i grid_id:i month_idx:i value:f4",
    with_blocks(BLOCKS, "SELECT * FROM pieces", *renamed(FIRST), *split_ctes("astate")),
)
def j05(t: Tables) -> DataFrame:
    return split_panel(t)[0]


def split_panel(t: Tables, anchors: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Months of all segments after the adaptive split, and the segments (one row each, leaves and split ones)."""
    anchors = anchors or anchor_list(t)
    states, obs, e = field_states(t), observed(t), edges(t)

    def split_states(months):
        return solver.interpolate_fields(t.cells, e, obs.where(F.col("month_idx").isin(list(months))), **CFG.solver)

    months, rows = reconstruct.run_segments(
        reconstruct.root_segments(states, anchors), predictor(t), obs, month_counts(t), states, split_states, CFG, states=propagated_cells(t, anchors, CFG)
    )
    return months, reconstruct.segment_table(t.spark, rows)


RECON = (
    *BACKGROUND, LEAF, *FITTED, COUNTS, ("astate", "SELECT * FROM bg"), SEG0, *renamed(segment_ctes("a", "seg0", "astate")), *split_ctes("astate"),
    ("rec0", "SELECT grid_id, month_idx, arg_min(value, segment_id) AS value FROM pieces GROUP BY ALL"),
    *rs.local_anchors("la", "rec0", "obsn", **LOCAL),
    *diffusion_ctes("df", "la", 1.25),
)


@query("j06_reconstruct_panel", "grid_id:i month_idx:i value:f4", with_blocks(BLOCKS, "SELECT grid_id, month_idx, value FROM df", *RECON))
def j06(t: Tables) -> DataFrame:
    obs = observed(t)
    out = reconstruct.reconstruct_panel(
        t.cells, edges(t), obs, anchor_list(t), N_MONTHS, predictor(t), CFG, anchor_field_table(t), anchor_priors(t),
        local_anchors=LOCAL, diffusion={"lam": 1.25},
    )
    n = t.cells.count()
    return reconstruct.require_complete(out.panel, n, N_MONTHS)


@query(
    "j07_anchor_months",
    "kind:s month_idx:i month_label:s",
    with_blocks(
        "calendar",
        """SELECT 'january' AS kind, month_idx, month_label FROM calendar WHERE month = 1 OR month_idx = 83
        UNION ALL SELECT 'every_24', month_idx, month_label FROM calendar WHERE month_idx % 24 = 0 OR month_idx = 83
        UNION ALL SELECT 'observed', month_idx, month_label FROM calendar WHERE month_idx BETWEEN (SELECT min(month_idx) FROM obs) AND (SELECT max(month_idx) FROM obs) AND (month = 1 OR month_idx = (SELECT max(month_idx) FROM obs))""".replace(
            "FROM obs)", "FROM (SELECT CAST(12 * year(o_orderdate) + month(o_orderdate) - 23941 AS INTEGER) AS month_idx FROM orders))"
        ),
    ),
)
def j07(t: Tables) -> DataFrame:
    from gridloom.plans.tables import month_idx_of

    ends = t.raw("orders").agg(F.struct(F.min(month_idx_of("o_orderdate")).alias("a"), F.max(month_idx_of("o_orderdate")).alias("b"))).scalar()
    span = t.calendar.withColumn("_e", ends).where((F.col("month_idx") >= F.col("_e.a")) & (F.col("month_idx") <= F.col("_e.b"))).drop("_e")
    tables = {
        "january": an.anchor_months(t.calendar, expected=7),
        "every_24": an.anchor_months(t.calendar, every=24),
        "observed": an.anchor_months(span),
    }
    parts = [df.select(F.lit(k).alias("kind"), "month_idx", "month_label") for k, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- J6 with a tail, in absolute values, published with its true segment summary (A10, B20) ---------

JANUARIES = [12 * i for i in range(7)]
LEAF_TAIL = ("leaf", "SELECT * FROM (VALUES (0, 12), (12, 24), (24, 36), (36, 48), (48, 60), (60, 72)) l(left_idx, right_idx)")
PUBLISHED = (
    *FIELD_CTES, OBSN, LEAF_TAIL, *FITTED, COUNTS, FIELD_STATES, SEG0, *renamed(segment_ctes("a", "seg0", "astate")), *split_ctes("astate"),
    ("segt", "SELECT -1 AS segment_id, grid_id, 72 AS left_idx, 83 AS right_idx, value AS state FROM astate WHERE month_idx = 72"),
    *rs.propagate("tp", "segt", "drv", "obsn", EXACT, ALPHA, SCALE, 11),
    *rs.state_rows("tl", "tp", 11),
    ("rec0", "SELECT grid_id, month_idx, arg_min(value, segment_id) AS value FROM pieces GROUP BY ALL UNION ALL SELECT grid_id, 72 + k, state FROM tl WHERE k > 0"),
    *rs.local_anchors("la", "rec0", "obsn", **LOCAL),
)


def published_reconstruction(t: Tables) -> dict[str, DataFrame]:
    """Segments between Januaries, the months after the last one, local anchoring, absolute values; read back."""
    cells, steps, pairs = stored_cells(t), predictor(t), list(zip(JANUARIES[:-1], JANUARIES[1:]))
    n_month = {r["month_idx"]: r["n_month"] for r in month_counts(t).collect()}  # one row per month
    rows, cuts = reconstruct.flagged_segments(reconstruct.segment_summary(reconstruct.ends_of_cells(cells, pairs, steps, n_month, CFG)), set(n_month), CFG)
    if cuts:
        obs = observed(t)
        months, segments = split_panel(t, JANUARIES)
        tail = reconstruct.extrapolate_tail(field_states(t), JANUARIES[-1], N_MONTHS - 1, steps, obs, CFG)
        panel = an.apply_local_anchors(reconstruct.merge_segments(months).unionByName(tail), obs, **LOCAL).drop("mode")
        panel = an.from_anomaly(panel, t.baseline, "value", "wtd")
    else:
        segments = reconstruct.segment_table(t.spark, rows)
        panel = reconstruct.panel_of_cells(cells, pairs, steps, n_month, CFG, LOCAL, N_MONTHS - 1, "base_wtd").withColumnRenamed("value", "wtd")
        panel = written(panel, "panel")  # the release deals it by ranges, which reads it twice
    panel = panel.join(F.broadcast(t.calendar.select("month_idx", "year")), "month_idx").select("grid_id", "month_idx", "year", "wtd")
    anchors = t.calendar.where(F.col("month_idx").isin(JANUARIES))
    path = scratch_path(t.spark, "release")
    sinks.publish(
        path,
        {"panel": panel, "cell_lookup": t.cells, "month_index": sinks.month_index(t.calendar, anchors, t.stored_obs), "segment_summary": segments},
        lambda stored: sinks.require_dense(stored["panel"], stored["cell_lookup"], stored["month_index"]),
    )
    return sinks.published(t.spark, path)


@query(
    "j06_published_panel",
    "grid_id:i month_idx:i month_label:s interval_id:i wtd:f4",
    with_blocks(
        BLOCKS,
        """SELECT grid_id, month_idx, month_label, CASE WHEN month_idx > 72 THEN -1 ELSE greatest((month_idx + 11) // 12 - 1, 0) END AS interval_id, value + base_wtd AS wtd
        FROM la JOIN baseline USING (grid_id) JOIN calendar USING (month_idx)""",
        *PUBLISHED,
    ),
)
def j06_published(t: Tables) -> DataFrame:
    out = published_reconstruction(t)
    return out["panel"].join(F.broadcast(out["month_index"]), "month_idx")


SUMMARY = "segment_id, level, left_idx, right_idx, n, rmse, p95_abs_diff, alpha_mean, was_split"


@query(
    "a10_segment_summary",
    "segment_id:i level:i left_idx:i right_idx:i n:i rmse:f4 p95_abs_diff:f4 alpha_mean:f4 was_split:b",
    with_blocks(
        BLOCKS,
        f"""SELECT {SUMMARY} FROM (SELECT *, 0 AS level, segment_id IN (SELECT segment_id FROM cuts) AS was_split FROM asm) UNION ALL
        SELECT {SUMMARY} FROM (SELECT *, 1 AS level, FALSE AS was_split FROM bs) UNION ALL SELECT {SUMMARY} FROM (SELECT *, 1 AS level, FALSE AS was_split FROM cs)""",
        *PUBLISHED,
    ),
)
def a10_summary(t: Tables) -> DataFrame:
    return published_reconstruction(t)["segment_summary"]
