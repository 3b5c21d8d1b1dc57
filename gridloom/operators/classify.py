"""Prototype classification, spatial blocks, and binary evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import clip
from gridloom.operators.ranks import percentile_ranks, value_cdf

# Response classes, their prototype positions in rank space and
# the weights of the five coordinates.
CLASSES = ("Fast recovery", "Slow recovery", "Buffered")
FEATURES = ("decline_rank", "rdown_rank", "rr_early_rank", "t50_rank", "deficit_rank")
TARGETS = {
    "Fast recovery": (0.78, 0.65, 0.88, 0.12, 0.35),
    "Slow recovery": (0.62, 0.55, 0.25, 0.88, 0.80),
    "Buffered": (0.10, 0.12, 0.60, 0.28, 0.12),
}
WEIGHTS = {
    "Fast recovery": (0.20, 0.16, 0.32, 0.24, 0.08),
    "Slow recovery": (0.15, 0.10, 0.25, 0.35, 0.15),
    "Buffered": (0.35, 0.30, 0.08, 0.07, 0.20),
}
RANK_CLIPS = {"rr_early": (0.0, 2.0), "t50": (1.0, 72.0), "rr_late": (-1.0, 5.0)}
GATE = {"decline_rank": 0.22, "rdown_rank": 0.28, "deficit_rank": 0.40}


@dataclass(frozen=True)
class Prototype:
    name: str
    order: int
    target: Sequence[float]
    weight: Sequence[float]


def prototypes() -> list[Prototype]:
    return [Prototype(c, i, TARGETS[c], [w / sum(WEIGHTS[c]) for w in WEIGHTS[c]]) for i, c in enumerate(CLASSES)]


def response_ranks(metrics: DataFrame) -> DataFrame:
    """Percentile ranks of the five metrics over cells with the four required ones."""
    required = ["decline_m", "rdown", "rr_early", "t50"]
    valid = metrics.where(" AND ".join(f"{c} IS NOT NULL" for c in required))
    inputs = valid.select(
        "grid_id",
        F.col("decline_m").alias("decline"),
        "rdown",
        *[
            F.when(F.col(c).isNotNull(), clip(F.col(c).cast("double"), *RANK_CLIPS[c])).alias(c)
            for c in ("rr_early", "t50", "rr_late")
        ],
    )
    ranks = percentile_ranks(inputs, ["grid_id"], ["decline", "rdown", "rr_early", "t50", "rr_late"])
    return ranks.withColumn("deficit_rank", F.coalesce(F.lit(1.0) - F.col("rr_late_rank"), F.lit(0.5)))


def prototype_distances(ranks: DataFrame) -> DataFrame:
    """Weighted L1 distance to every prototype, as an array ordered by distance.

    The prototypes are three literal rows, so the "cross join" is a projection.
    """
    def distance(p: Prototype) -> Column:
        terms = [F.lit(w) * F.abs(F.col(f) - F.lit(t)) for f, t, w in zip(FEATURES, p.target, p.weight)]
        return sum(terms[1:], terms[0])

    entries = F.array(
        *[F.struct(distance(p).alias("distance"), F.lit(p.order).alias("class_order"), F.lit(p.name).alias("name")) for p in prototypes()]
    )
    return ranks.withColumn("scored", F.array_sort(entries))


def best_and_second(scored: DataFrame, gate: Column, gate_class: str) -> DataFrame:
    """Best and second class with scores 1 - d; the gate overrides the best one."""
    by_name = F.filter("scored", lambda s: s["name"] == F.lit(gate_class))[0]
    best = F.when(gate, by_name).otherwise(F.col("scored")[0])
    with_best = scored.withColumn("_best", best)
    second = F.filter("scored", lambda s: s["name"] != F.col("_best.name"))[0]
    return with_best.withColumn("_second", second).select(
        *[c for c in scored.columns if c != "scored"],
        F.col("_best.name").alias("response_class"),
        (1 - F.col("_best.distance")).alias("best_score"),
        F.col("_second.name").alias("second_class"),
        (1 - F.col("_second.distance")).alias("second_score"),
        (F.col("_second.distance") - F.col("_best.distance")).alias("score_margin"),
        F.when(gate, F.lit("weak_response_gate")).otherwise(F.lit("nearest_prototype")).alias("assignment_rule"),
    )


def buffered_gate() -> Column:
    cond = F.lit(True)
    for c, limit in GATE.items():
        cond = cond & (F.col(c) <= limit)
    return cond


def classify_responses(metrics: DataFrame) -> DataFrame:
    """Class labels for all cells; cells lacking a required metric keep NULLs."""
    labelled = best_and_second(prototype_distances(response_ranks(metrics)), buffered_gate(), "Buffered")
    return metrics.select("grid_id").join(labelled, "grid_id", "left").withColumn(
        "valid_for_clustering", F.col("response_class").isNotNull()
    )


def spatial_blocks(cells: DataFrame, block_m: float) -> DataFrame:
    """Square block id per cell, counted from the south-west corner."""
    low = cells.agg(F.struct(F.min("x").alias("x"), F.min("y").alias("y"))).scalar()
    return cells.withColumn("_low", low).withColumn(
        "block",
        (F.floor((F.col("x") - F.col("_low.x")) / F.lit(block_m)) * 1000 + F.floor((F.col("y") - F.col("_low.y")) / F.lit(block_m))).cast("long"),
    ).drop("_low")


def block_folds(blocks: DataFrame, folds: int) -> DataFrame:
    """Whole blocks to folds: size-ranked snake, so fold sizes stay balanced."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    ranked = value_cdf(sizes.select(F.struct((-F.col("n")).alias("s"), "block").alias("_k")), [], "_k")
    pos = F.pmod(F.col("below_n"), F.lit(2 * folds))
    fold = F.when(pos < folds, pos).otherwise(2 * folds - 1 - pos)
    return blocks.join(ranked.select(F.col("_k.block").alias("block"), fold.cast("int").alias("fold")), "block")


def binary_evaluation(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Cutoff, confusion counts, precision, recall, ROC-AUC, AP and Brier score.

    Everything is derived from counts per distinct score with exact cumulative
    totals, so no task sorts the whole table.
    """
    y = F.col(label).cast("int")
    cdf = value_cdf(
        scored, [], score, {"n": F.count(F.lit(1)), "pos": F.sum(y), "sq": F.sum(F.pow(F.col(score) - y, F.lit(2.0)))}
    )
    n, pos = F.col("total_n"), F.col("total_pos")
    target = (F.lit(1.0) - (1.0 - (n - pos) / n)) * (n - 1)
    at = lambda t: F.max(F.when((t >= F.col("below_n")) & (t < F.col("below_n") + F.col("n")), F.col(score)))
    neg = F.col("n") - F.col("pos")
    below_neg = F.col("below_n") - F.col("below_pos")
    tp_here = pos - F.col("below_pos")
    summary = cdf.agg(
        F.max("total_n").alias("n_rows"),
        F.max("total_pos").alias("n_pos"),
        at(F.floor(target)).alias("_lo"),
        at(F.ceil(target)).alias("_hi"),
        F.max(target).alias("_t"),
        (F.sum(F.col("pos") * (below_neg + neg / F.lit(2.0))) / F.max(pos * (n - pos))).alias("roc_auc"),
        F.sum(F.col("pos") / pos * tp_here / (n - F.col("below_n"))).alias("average_precision"),
        (F.sum("sq") / F.max(n)).alias("brier"),
    ).withColumn("cutoff", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_t") - F.floor("_t")))
    cut = summary.select("cutoff").scalar()
    high = F.col(score) >= cut
    counts = scored.agg(
        F.struct(
            F.count_if(high & (y == 1)).alias("tp"), F.count_if(high & (y == 0)).alias("fp"), F.count_if(~high & (y == 1)).alias("fn")
        )
    ).scalar()
    return (
        summary.withColumn("_c", counts)
        .select("n_rows", "n_pos", "cutoff", "roc_auc", "average_precision", "brier", "_c.*")
        .withColumns(
            {
                "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
                "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
            }
        )
    )


def overlap_code(is_target: Column, is_high: Column) -> Column:
    """0 neither, 1 class only, 2 high score only, 3 both."""
    return is_target.cast("int") + 2 * is_high.cast("int")
