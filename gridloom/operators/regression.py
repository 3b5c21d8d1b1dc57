"""Horizon predictors fitted from moment sums: one linear model per (horizon, seed).

The normal equations of all members come from one grouped aggregation whose
groups are combined before the shuffle, and are solved in columns of the few
resulting rows.  The fitted members are a table, so a step of a reconstruction
can evaluate them for any cell, month and running state without a model object.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.operators.anchors import solve_columns


def bootstrap_weight(key: Column, seed: Column) -> Column:
    """How often a row stands in a member's bootstrap (0 to 3, as a Poisson draw would), from integer arithmetic."""
    r = F.pmod(F.pmod(key, F.lit(1000003)) * 48271 + seed * 104729, F.lit(2147483647)) % 1000
    return F.when(r < 368, 0.0).when(r < 736, 1.0).when(r < 920, 2.0).otherwise(3.0)


def fit_members(train: DataFrame, features: Sequence[str], label: str, key: str, seeds: Sequence[int], ridge: float = 1e-3) -> DataFrame:
    """``h, seed, weight, intercept, mean, coef``: a ridge regression per horizon and bootstrap.

    ``mean`` and ``coef`` are arrays in the order of ``features``; features are
    scaled by their mean and spread within the horizon for the fit, and the
    coefficients are scaled back.  A missing feature takes the mean, a row
    without label or horizon takes no part.
    """
    rows = train.where(F.col(label).isNotNull() & F.col("h").isNotNull())
    n = len(features)
    spread = {f: F.stddev_pop(f) for f in features}
    stats = rows.groupBy("h").agg(
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.when(spread[f] > 0, spread[f]).otherwise(1.0).alias(f"_d{i}") for i, f in enumerate(features)],
    )
    scaled = [F.lit(1.0).alias("_z0")]
    scaled += [F.coalesce((F.col(f) - F.col(f"_m{i}")) / F.col(f"_d{i}"), F.lit(0.0)).alias(f"_z{i + 1}") for i, f in enumerate(features)]
    members = F.array(*[F.struct(F.lit(s).alias("seed"), bootstrap_weight(F.col(key), F.lit(s)).alias("_w")) for s in seeds])
    drawn = (
        rows.join(F.broadcast(stats), "h")  # one row per horizon
        .select("h", F.col(label).cast("double").alias("_y"), *scaled, members.alias("_s"))
        .select("h", "_y", *[f"_z{i}" for i in range(n + 1)], F.inline("_s"))
        .where("_w > 0")
    )
    w, z = F.col("_w"), [F.col(f"_z{i}") for i in range(n + 1)]
    sums = drawn.groupBy("h", "seed").agg(
        F.sum("_w").alias("weight"),
        *[F.sum(w * z[i] * z[j]).alias(f"_a{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)],
        *[F.sum(w * z[i] * F.col("_y")).alias(f"_b{i}") for i in range(n + 1)],
    )
    sums = sums.withColumns({f"_a{i}_{i}": F.col(f"_a{i}_{i}") + F.lit(ridge) * F.col("weight") for i in range(1, n + 1)})
    sums = sums.withColumns({f"_a{i}_{j}": F.col(f"_a{j}_{i}") for i in range(n + 1) for j in range(i)})
    solved = solve_columns(
        sums, [[f"_a{i}_{j}" for j in range(n + 1)] for i in range(n + 1)], [f"_b{i}" for i in range(n + 1)], [f"_c{i}" for i in range(n + 1)]
    ).join(F.broadcast(stats), "h")
    raw = [F.col(f"_c{i + 1}") / F.col(f"_d{i}") for i in range(n)]
    intercept = F.col("_c0")
    for i in range(n):
        intercept = intercept - raw[i] * F.col(f"_m{i}")
    return solved.select(
        "h", "seed", "weight", intercept.alias("intercept"), F.array(*[F.col(f"_m{i}") for i in range(n)]).alias("mean"), F.array(*raw).alias("coef")
    )


def _linear(member: Column, values: Sequence[Column | None]) -> Column:
    """Intercept and terms of a member struct; a ``None`` leaves its term out."""
    total = member["intercept"]
    for i, v in enumerate(values):
        if v is not None:
            total = total + member["coef"][i] * F.coalesce(v, member["mean"][i])
    return total


def by_horizon(members: DataFrame) -> DataFrame:
    """One row per horizon with its members in order of their seeds."""
    return members.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("seed", "intercept", "mean", "coef"))).alias("_members"))


def predict_members(rows: DataFrame, members: DataFrame, features: Sequence[str]) -> DataFrame:
    """Stacked predictions (one row per input row and seed) as ``seed, y_pred``."""
    return (
        rows.join(F.broadcast(by_horizon(members)), "h")  # one row per horizon
        .select(*[F.col(f"`{c}`") for c in rows.columns], F.explode("_members").alias("_m"))
        .select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_m.seed").alias("seed"), _linear(F.col("_m"), [F.col(f) for f in features]).alias("y_pred"))
    )


def member_spread(rows: DataFrame, members: DataFrame, features: Sequence[str], out: str = "spread") -> DataFrame:
    """Population spread of the members' predictions, without stacking them."""
    stacked = by_horizon(members)
    most = stacked.agg(F.coalesce(F.max(F.size("_members")), F.lit(0))).first()[0]  # a few members, written out so that rows need no interpreted function
    values = [F.col(f) for f in features]
    joined = rows.join(F.broadcast(stacked), "h")
    joined = joined.withColumns({f"_p{i}": _linear(F.get("_members", F.lit(i)), values) for i in range(most)})
    total, squares = F.lit(0.0), F.lit(0.0)
    for i in range(most):
        total = total + F.when(F.size("_members") > i, F.col(f"_p{i}")).otherwise(F.lit(0.0))
    joined = joined.withColumn("_mean", total / F.size("_members"))
    for i in range(most):
        d = F.col(f"_p{i}") - F.col("_mean")
        squares = squares + F.when(F.size("_members") > i, d * d).otherwise(F.lit(0.0))
    return joined.withColumn(out, F.sqrt(squares / F.size("_members"))).drop("_members", "_mean", *[f"_p{i}" for i in range(most)])


def mean_members(members: DataFrame) -> DataFrame:
    """One row per horizon with the mean of its members: ``h, _m`` (intercept, mean, coef)."""
    mean = lambda part: F.aggregate(F.transform("_members", part), F.lit(0.0), lambda a, v: a + v) / F.size("_members")
    one = F.col("_members")[0]
    coef = F.transform(F.sequence(F.lit(0), F.size(one["coef"]) - 1), lambda i: mean(lambda m: F.get(m["coef"], i)))
    return by_horizon(members).select("h", F.struct(mean(lambda m: m["intercept"]).alias("intercept"), one["mean"].alias("mean"), coef.alias("coef")).alias("_m"))


@dataclass(frozen=True)
class StatePredictor:
    """delta(cell, start, h, state) = base + slope * state, the mean of all members.

    ``table`` (grid_id, start_idx, h, base, slope) holds everything that does not
    depend on the running state.  Where steps follow from a packed row per cell,
    ``cells`` (grid_id and any columns) has these rows and ``steps`` makes the
    steps of a batch of them inside a task: it takes the batch's columns and
    returns a function of (rows, start months, horizons) to base, slope and
    whether there is a prediction, each one row per cell and a column per step.
    """

    table: DataFrame | None = None
    cells: DataFrame | None = None
    steps: Callable | None = None

    def packed(self, taken: DataFrame) -> tuple[DataFrame, Callable]:
        """``grid_id, _in`` with all that a cell's ``taken`` steps (start_idx, h) need, and what makes the steps of it."""
        if self.cells is not None:
            return self.cells.select("grid_id", F.struct(*[c for c in self.cells.columns if c != "grid_id"]).alias("_in")), self.steps
        rows = self.table.join(F.broadcast(taken), ["start_idx", "h"], "left_semi")
        entry = F.struct(F.col("start_idx").cast("int").alias("start_idx"), F.col("h").cast("int").alias("h"), F.col("base").cast("double").alias("base"), F.col("slope").cast("double").alias("slope"))
        return rows.groupBy("grid_id").agg(F.struct(F.collect_list(entry).alias("steps")).alias("_in")), _listed_steps

    @staticmethod
    def of_members(inputs: DataFrame, members: DataFrame, features: Sequence[str], state: str, shift: str | None = None) -> StatePredictor:
        """Members evaluated on ``inputs`` (grid_id, start_idx, h and all features but ``state``).

        ``shift`` names a column to add to the running state first, such as the
        long-term level of a panel that is kept as anomalies.
        """
        at = list(features).index(state)
        fixed = [None if f == state else F.col(f) for f in features]
        rows = inputs.join(F.broadcast(mean_members(members)), "h")
        rows = rows.withColumn("_base", _linear(F.col("_m"), fixed)).withColumn("slope", F.col("_m.coef")[at])
        base = F.col("_base") if shift is None else F.col("_base") + F.col("slope") * F.col(shift)
        return StatePredictor(rows.select("grid_id", "start_idx", "h", base.alias("base"), "slope"))


def _listed_steps(inputs: pa.StructArray) -> Callable:
    """Steps that come as a list per cell."""
    lists = inputs.field("steps")
    given = inputs.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(given, np.diff(lists.offsets.to_numpy()), 0)
    row = np.repeat(np.arange(len(inputs)), sizes)
    flat = pa.concat_arrays([lists.filter(pa.array(given)).flatten()])
    start, h = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start_idx", "h"))
    base, slope, known = arrays.doubles(flat.field("base")), arrays.doubles(flat.field("slope")), arrays.known(flat.field("base"))

    def steps(rows: np.ndarray, starts: Sequence[int], horizons: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.full((3, len(inputs), len(starts)), np.nan)
        for j, (s, k) in enumerate(zip(starts, horizons)):
            here = (start == s) & (h == k)
            found[:, row[here], j] = base[here], slope[here], known[here]
        return found[0, rows], found[1, rows], found[2, rows] == 1

    return steps
