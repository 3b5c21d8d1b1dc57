"""Extremely randomised trees: large nodes as grouped aggregations, small ones in tasks.

All trees of all validation folds grow together.  A level is one pass over rows
``(forest, tree, id, node)``: the ranges of every feature in every open node give
one keyed random cut per drawn feature, the rows on either side of the cuts are
counted, and the cut with the largest decrease of Gini impurity splits the node.
Both aggregations combine before they shuffle, so a node that holds all rows of
a table costs no more than others; what travels per node is a row of counts.

A node of at most 4 million values is a group with a bound: its rows meet in one
task, which takes the same steps to the leaves.  Levels end when no larger node is
open.  Forests of at most ``local_values`` values skip them: their rows are packed
by feature, the trees of a forest share them in a few groups, and a group
hands on sums over its trees only, so neither what is dealt nor what is written
grows with the number of trees.

A draw is a function of (seed, forest, tree, path to the node, feature), so a
recomputed task makes the same trees, and so does another engine.  Depth has no
limit: a node is its path, and growth ends when no node can be split.

Forest ``k`` does not see the rows of fold ``k``; forest ``FINAL`` sees all.
Missing values take the median of the rows a forest sees; a feature without any
value is never drawn.  Without training rows a forest gives no probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import group_quantiles
from gridloom.session import written

FINAL = -1
PRIME = 2147483647
NODE = ["forest", "tree", "node"]
#: groups of trees per forest that is grown in tasks from its roots; a large forest has fewer, and all of them together at least so many
GROUPS, LARGE, ALL_GROUPS = 20, 4_000_000, 48
#: rows of a node that is grown level by level on a copy of its rows (below 32,768, so that two counts fit in 32 bits)
NEAR = 8_192
#: what a group hands on: every tree, the sum of the trees' shares per row, or the decrease per tree and feature
GROWN = "forest int, tree int, ids array<bigint>, p array<double>, nodes array<string>, features array<int>, decreases array<double>"
SHARES = "forest int, trees int, ids array<bigint>, p array<double>"
DECREASES = "forest int, tree int, features array<int>, decreases array<double>"
PACKED = "forest int, n int, single binary, x32 binary, x64 binary, ids binary, y binary, train binary"


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 500
    min_leaf: int = 10
    feature_share: float = 0.75
    seed: int = 42
    local_values: int = 64_000_000

    def drawn(self, features: int) -> int:
        return max(1, int(self.feature_share * features))


def _scrambled(x):
    """The keyed draw, of columns and of arrays of 64-bit integers."""
    x = (x * x + 1013904223) % PRIME
    x = (x * 48271 + 11) % PRIME
    return (x * x + 7) % PRIME


def _root_key(forest, tree, seed: int):
    return _scrambled(((forest + 2) * 1000003 + tree * 7919 + seed * 104729) % PRIME)


def root_key(seed: int) -> Column:
    return _root_key(F.col("forest").cast("long"), F.col("tree").cast("long"), seed)


def _child_key(key, right):
    return _scrambled((key * 16807 + right + 1) % PRIME)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _cut_draw(key, i):
    return _scrambled((key + (i + 1) * 40503001) % PRIME) / float(PRIME)


def _rank_draw(key, i):
    return _scrambled((key + (i + 1) * 69621007) % PRIME)


def _purity(pos, n):
    return (pos * pos + (n - pos) * (n - pos)) / n


def forest_inputs(rows: DataFrame, features: Sequence[str], label: str, forests: Sequence[int], key: str) -> DataFrame:
    """``forest, id, train, y, x``: every row once per forest, with that forest's medians in place of nulls.

    Only features that lack a value somewhere have their medians computed.
    """
    lacking = rows.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)) for c in features]).first()
    lacking = [i for i, some in enumerate(lacking) if some]
    forests = F.explode(F.array(*[F.lit(k) for k in forests])).alias("forest")
    wide = rows.select(forests, F.col(key).alias("id"), "fold", F.col(label).cast("long").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    wide = wide.withColumn("train", F.col("fold") != F.col("forest"))
    if not lacking:
        return wide.select("forest", "id", "train", "y", F.col("_x").alias("x"))
    values = F.array(*[F.struct(F.lit(i).alias("_i"), F.get("_x", F.lit(i)).alias("_v")) for i in lacking])
    long = wide.where("train").select("forest", F.inline(values))
    medians = group_quantiles(long, ["forest", "_i"], "_v", {"_m": 0.5}).groupBy("forest").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_m"))).alias("_m"))
    filled = F.transform("_x", lambda v, i: F.coalesce(v, F.col("_m")[i], F.lit(0.0)))
    return wide.join(medians, "forest", "left").select("forest", "id", "train", "y", filled.alias("x"))


def _open(min_leaf: int) -> Column:
    return (F.col("n") >= 2 * min_leaf) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))


def _best_splits(members: DataFrame, width: int, settings: TreeSettings) -> DataFrame:
    """The split of every open node that has a valid one: ``feature, cut, decrease, n_left, pos_left``."""
    seen = members.where("train").withColumn("v", array_to_vector("x"))
    ends = seen.groupBy(*NODE, "key").agg(Summarizer.metrics("min", "max").summary(F.col("v")).alias("s"))
    ranges = ends.select(*NODE, "key", vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))

    # constant features have no draw, and of the others those with the smallest draws get a cut
    ranks = F.transform("lo", lambda lo, i: F.when(lo < F.col("hi")[i], _rank_draw(F.col("key"), i.cast("long"))))
    last = lambda r: F.get(F.array_sort(F.array_compact(r)), F.least(F.size(F.array_compact(r)), F.lit(settings.drawn(width))) - 1)
    cut = lambda r, m: F.transform("lo", lambda lo, i: F.when(r[i] <= m, lo + _cut_draw(F.col("key"), i.cast("long")) * (F.col("hi")[i] - lo)))
    drawn = ranges.select(*NODE, _let(ranks, lambda r: _let(last(r), lambda m: cut(r, m))).alias("cuts"))

    # sums of absolute values of 0/1 vectors are exact counts
    left = F.transform("x", lambda v, i: F.when(v <= F.col("cuts")[i], 1.0).otherwise(0.0))
    sides = seen.join(drawn, NODE).withColumn("left", array_to_vector(left))
    counted = sides.groupBy(*NODE, "n", "pos").agg(
        Summarizer.normL1(F.col("left")).alias("n_left"), Summarizer.normL1(F.col("left"), F.col("y").cast("double")).alias("pos_left")
    ).join(drawn, NODE)
    counted = counted.select(*NODE, "n", "pos", "cuts", *[F.transform(vector_to_array(c), lambda v: v.cast("long")).alias(c) for c in ("n_left", "pos_left")])

    def candidate(cut: Column, i: Column) -> Column:
        n, pos = F.col("n_left")[i], F.col("pos_left")[i]
        rest = F.col("n") - n
        gain = _purity(pos, n) + _purity(F.col("pos") - pos, rest)
        return F.when(
            cut.isNotNull() & (n >= settings.min_leaf) & (rest >= settings.min_leaf),
            F.struct(gain.alias("gain"), (-i).alias("turn"), n.alias("n_left"), pos.alias("pos_left"), cut.alias("cut")),
        )

    best = counted.withColumn("_b", F.array_max(F.transform("cuts", candidate))).where("_b IS NOT NULL")
    return best.select(
        *NODE, (-F.col("_b.turn")).alias("feature"), "_b.cut", (F.col("_b.gain") - _purity(F.col("pos"), F.col("n"))).alias("decrease"), "_b.n_left", "_b.pos_left"
    )


def _moved(members: DataFrame, splits: DataFrame, min_leaf: int) -> DataFrame:
    """Every row in the child its node sends it to; rows of a node without a split stay and are done."""
    at = members.join(splits, NODE, "left")
    split, right = F.col("feature").isNotNull(), ~(F.get("x", F.col("feature")) <= F.col("cut"))
    child = lambda whole, part: F.when(~split, F.col(whole)).when(right, F.col(whole) - F.col(part)).otherwise(F.col(part))
    moved = at.select(
        "forest", "tree", "id", F.when(split, F.concat("node", F.when(right, "1").otherwise("0"))).otherwise(F.col("node")).alias("node"),
        F.when(split, _child_key(F.col("key"), right.cast("long"))).otherwise(F.col("key")).alias("key"), child("n", "n_left").alias("n"), child("pos", "pos_left").alias("pos"), split.alias("_split"),
    )
    return moved.withColumn("done", ~(F.col("_split") & _open(min_leaf))).drop("_split")


def _subtree(x: np.ndarray, y: np.ndarray, train: np.ndarray, key: int, path: str, settings: TreeSettings) -> tuple[np.ndarray, list[tuple[str, int, float]]]:
    """The subtree of a node that holds these rows (``NEAR`` at most): ``p`` per row, and (node, feature, decrease) of its splits."""
    least, drawn, i = settings.min_leaf, settings.drawn(x.shape[1]), np.arange(x.shape[1])
    keys, paths, n, pos = np.array([key]), [path], np.array([train.sum()]), np.array([y[train].sum()])
    slot, p, splits = np.zeros(len(x), dtype=np.int64), np.full(len(x), pos[0] / n[0]), []
    if not (n[0] >= 2 * least and 0 < pos[0] < n[0]):
        return p, splits
    while len(keys):
        seen = np.flatnonzero(train & (slot >= 0))
        seen = seen[np.argsort(slot[seen], kind="stable")]
        at, v = slot[seen], x[seen]
        first = np.searchsorted(at, np.arange(len(keys)))
        lo, hi = np.fmin.reduceat(v, first), np.fmax.reduceat(v, first)

        ranks = np.where(lo < hi, _rank_draw(keys[:, None], i), PRIME)
        last = np.sort(ranks, axis=1)[:, drawn - 1 : drawn]
        with np.errstate(all="ignore"):
            cuts = lo + _cut_draw(keys[:, None], i) * (hi - lo)
            both = np.add.reduceat(np.multiply(v <= cuts[at], (1 + ((y[seen] > 0) << 16)).astype(np.int32)[:, None]), first)
            n_left, pos_left = (both & 0xFFFF).astype(np.int64), (both >> 16).astype(np.int64)
            rest = n[:, None] - n_left
            valid = (ranks < PRIME) & (ranks <= last) & (n_left >= least) & (rest >= least)
            gain = np.where(valid, _purity(pos_left, n_left) + _purity(pos[:, None] - pos_left, rest), -1.0)
        best, each = gain.argmax(axis=1), np.arange(len(keys))
        split, cut, decrease = valid.any(axis=1), cuts[each, best], gain[each, best] - _purity(pos, n)
        splits += [(paths[k], int(best[k]), float(decrease[k])) for k in np.flatnonzero(split)]

        # children 2k and 2k+1; rows keep the share of the last node they were sent to
        moved = np.flatnonzero(slot >= 0)
        moved = moved[split[slot[moved]]]
        of = slot[moved]
        child = 2 * of + ~(x[moved, best[of]] <= cut[of])
        lefts = np.stack([n_left[each, best], pos_left[each, best]])
        n, pos = np.stack([lefts, np.stack([n, pos]) - lefts], axis=-1).reshape(2, -1)
        with np.errstate(all="ignore"):
            p[moved] = (pos / n)[child]
        still = np.repeat(split, 2) & (n >= 2 * least) & (pos > 0) & (pos < n)
        slot[:] = -1
        slot[moved] = np.where(still, np.cumsum(still) - 1, -1)[child]
        paths = [paths[k // 2] + str(k % 2) for k in np.flatnonzero(still)]
        keys, n, pos = _child_key(np.repeat(keys, 2), np.tile([0, 1], len(keys)))[still], n[still], pos[still]
    return p, splits


class _Values:
    """The values of a group's rows by feature, in single precision where that is exact."""

    def __init__(self, single: np.ndarray, rows: int):
        self.slot = np.where(single, np.cumsum(single), np.cumsum(~single)) - 1
        self.single, self.parts = single, (np.empty((int((~single).sum()), rows)), np.empty((int(single.sum()), rows), np.float32))

    def feature(self, i: int) -> np.ndarray:
        return self.parts[int(self.single[i])][self.slot[i]]

    def of(self, i: int, rows: np.ndarray) -> np.ndarray:
        return self.feature(i)[rows].astype(np.float64)

    def rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.single)))
        for single, part in ((False, self.parts[0]), (True, self.parts[1])):
            out[:, self.single == single] = part[:, rows].T
        return out


def _exact(x: np.ndarray) -> np.ndarray:
    """Whether a column is the same in single precision."""
    with np.errstate(all="ignore"):
        return ((x.astype(np.float32) == x) | np.isnan(x)).all(axis=0)


def _of_matrix(x: np.ndarray) -> _Values:
    values = _Values(_exact(x), len(x))
    for i in range(x.shape[1]):
        values.feature(i)[:] = x[:, i]
    return values


def _packed(inputs: DataFrame) -> DataFrame:
    """Batches of rows as a row of bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forests = batch.column("forest").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(forests), -1)
            ids, y, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "train"))
            out = []
            for forest in np.unique(forests):
                mine = forests == forest
                part = x[mine]
                single = _exact(part)
                parts = [single, part[:, single].T.astype(np.float32), part[:, ~single].T, ids[mine].astype(np.int64), y[mine] > 0, train[mine]]
                out.append((int(forest), int(mine.sum()), *[np.ascontiguousarray(v).tobytes() for v in parts]))
            if out:
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], [c.split()[0] for c in PACKED.split(", ")])

    return inputs.select("forest", "id", "train", "y", "x").mapInArrow(run, PACKED)


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Values]:
    """ids, y, train and values of packed rows."""
    ends = np.cumsum([0, *group["n"].to_pylist()])
    column = lambda c, t: np.concatenate([np.frombuffer(v.as_buffer(), t) for v in group[c]])
    masks = [np.frombuffer(v.as_buffer(), bool) for v in group["single"]]
    values = _Values(np.logical_and.reduce(masks), int(ends[-1]))
    for k, single in enumerate(masks):
        n = ends[k + 1] - ends[k]
        parts = np.frombuffer(group["x64"][k].as_buffer()).reshape(-1, n), np.frombuffer(group["x32"][k].as_buffer(), np.float32).reshape(-1, n)
        slot = np.where(single, np.cumsum(single), np.cumsum(~single)) - 1
        for i in range(len(single)):
            values.feature(i)[ends[k] : ends[k + 1]] = parts[int(single[i])][slot[i]]
    return column("ids", np.int64), column("y", bool), column("train", bool), values


def _split(x: _Values, y: np.ndarray, seen: np.ndarray, n: np.int64, pos: np.int64, key: int, settings: TreeSettings) -> tuple[int, float, float] | None:
    """Feature, cut and decrease of a node with the trained rows ``seen``, a feature at a time."""
    width, least = len(x.single), settings.min_leaf
    i, of = np.arange(width), y[seen]
    ends = np.array([(np.fmin.reduce(c), np.fmax.reduce(c)) for c in (x.of(f, seen) for f in range(width))])
    lo, hi = ends[:, 0], ends[:, 1]
    ranks = np.where(lo < hi, _rank_draw(key, i), PRIME)
    last = np.sort(ranks)[settings.drawn(width) - 1]
    with np.errstate(all="ignore"):
        cuts = lo + _cut_draw(key, i) * (hi - lo)
    best = None
    for f in np.flatnonzero((ranks < PRIME) & (ranks <= last)):
        left = x.of(f, seen) <= cuts[f]
        n_left, pos_left = np.int64(np.count_nonzero(left)), np.int64(np.count_nonzero(left & of))
        if n_left >= least and n - n_left >= least:
            gain = _purity(pos_left, n_left) + _purity(pos - pos_left, n - n_left)
            if best is None or gain > best[2]:
                best = int(f), cuts[f], gain
    return None if best is None else (best[0], best[1], float(best[2] - _purity(pos, n)))


def _tree(x: _Values, y: np.ndarray, train: np.ndarray, key: int, path: str, settings: TreeSettings) -> tuple[np.ndarray, list[tuple[str, int, float]]]:
    """:func:`_subtree` of any number of rows: large nodes one by one without a copy of their rows, near ones in one go."""
    p, splits, open_nodes = np.empty(len(y)), [], [(np.arange(len(y)), key, path)]
    while open_nodes:
        rows, key, path = open_nodes.pop()
        if len(rows) <= NEAR:
            p[rows], below = _subtree(x.rows(rows), y[rows], train[rows], key, path, settings)
            splits += below
            continue
        seen = rows[train[rows]]
        n, pos = np.int64(len(seen)), np.int64(np.count_nonzero(y[seen]))
        split = _split(x, y, seen, n, pos, key, settings) if n >= 2 * settings.min_leaf and 0 < pos < n else None
        if split is None:
            p[rows] = pos / n
            continue
        feature, cut, decrease = split
        splits.append((path, feature, decrease))
        left = x.of(feature, rows) <= cut
        open_nodes += [(rows[~left], int(_child_key(key, 1)), path + "1"), (rows[left], int(_child_key(key, 0)), path + "0")]
    return p, splits


def _every_tree(forest: int, ids: np.ndarray, grown: Iterator[tuple]) -> pa.Table:
    out = []
    for tree, p, splits in grown:
        nodes, features, decreases = zip(*splits) if splits else ((), (), ())
        out.append({"forest": forest, "tree": tree, "ids": ids, "p": p, "nodes": nodes, "features": features, "decreases": decreases})
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("forest", pa.int32()), ("tree", pa.int32()), ("ids", pa.list_(pa.int64())), ("p", pa.list_(pa.float64())),
        ("nodes", pa.list_(pa.string())), ("features", pa.list_(pa.int32())), ("decreases", pa.list_(pa.float64())),
    ]))


def _shares(forest: int, ids: np.ndarray, grown: Iterator[tuple]) -> pa.Table:
    total, trees = np.zeros(len(ids)), 0
    for _, p, _ in grown:
        total, trees = total + p, trees + 1
    parts = [np.arange(a, min(a + 65_536, len(ids))) for a in range(0, len(ids), 65_536)]
    lists = [pa.array([v[at] for at in parts], pa.list_(t)) for v, t in ((ids, pa.int64()), (total, pa.float64()))]
    same = [pa.array(np.full(len(parts), v), pa.int32()) for v in (forest, trees)]
    return pa.Table.from_arrays([*same, *lists], ["forest", "trees", "ids", "p"])


def _decreases(forest: int, ids: np.ndarray, grown: Iterator[tuple]) -> pa.Table:
    out = []
    for tree, _, splits in grown:
        features = np.array([f for _, f, _ in splits], np.int64)
        sums = np.bincount(features, weights=[d for _, _, d in splits]) if splits else np.zeros(0)
        used = np.unique(features)
        out.append({"forest": forest, "tree": tree, "features": used, "decreases": sums[used]})
    return pa.Table.from_pylist(out, schema=pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("features", pa.list_(pa.int32())), ("decreases", pa.list_(pa.float64()))]))


HANDED_ON = {GROWN: _every_tree, SHARES: _shares, DECREASES: _decreases}


def _grown_in_tasks(groups: DataFrame, settings: TreeSettings, what: str) -> DataFrame:
    """``what`` is made of groups ``forest, part`` with their rows ``id, train, y, x`` and the nodes ``starts`` that hold them all."""
    hand_on = HANDED_ON[what]

    def subtrees(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        y, train = group["y"].to_numpy() > 0, group["train"].to_numpy(zero_copy_only=False)
        x = _of_matrix(group["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1))
        starts = group["starts"][0].as_py()
        return hand_on(group["forest"][0].as_py(), group["id"].to_numpy(), ((s["tree"], *_tree(x, y, train, s["key"], s["node"], settings)) for s in starts))

    return groups.groupBy("forest", "part").applyInArrow(subtrees, what)


def _whole_in_tasks(inputs: DataFrame, forests: int, values: int, settings: TreeSettings, what: str) -> DataFrame:
    """``what`` is made of forests whose rows fit in a task: a part of the trees shares them, packed."""
    hand_on = HANDED_ON[what]
    parts = min(settings.trees, GROUPS if values <= LARGE else -(-ALL_GROUPS // max(1, forests)))

    def trees(group: pa.Table) -> pa.Table:
        forest, part = group["forest"][0].as_py(), group["part"][0].as_py()
        ids, y, train, x = _unpacked(group)
        mine = range(part, settings.trees, parts) if train.any() else ()
        return hand_on(forest, ids if len(mine) else ids[:0], ((t, *_tree(x, y, train, int(_root_key(forest, t, settings.seed)), "", settings)) for t in mine))

    dealt = _packed(inputs).select("*", F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("part"))
    # a group is little data and much work, so groups are not coalesced, and few of them share a task
    return dealt.repartition(4 * parts * max(1, forests), "forest", "part").groupBy("forest", "part").applyInArrow(trees, what)


def _at(tree: str, node: Column, key: Column) -> Column:
    return F.struct(F.col(tree).cast("int").alias("tree"), node.alias("node"), key.cast("long").alias("key"))


def _by_levels(inputs: DataFrame, width: int, bound: int, settings: TreeSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``forest, tree, id, p`` of the leaves and the splits of nodes with more rows than the bound, and the groups below them."""
    roots = inputs.where("train").groupBy("forest").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))).alias("tree")
    rows = inputs.select("forest", "id", trees).join(roots, "forest")
    level = rows.select("forest", "tree", "id", F.lit("").alias("node"), root_key(settings.seed).alias("key"), "n", "pos", (~_open(settings.min_leaf)).alias("done"))
    # what a row says of itself is large: it is not broadcast, however well its file packs
    wide = inputs.hint("merge")
    ended, made, ready = [], [], []
    while True:
        sizes = level.where("NOT done").groupBy(*NODE).agg((F.count(F.lit(1)) > bound).alias("large"))
        sized = level.join(sizes, NODE, "left")
        ended.append(level.where("done").select("forest", "tree", "id", (F.col("pos") / F.col("n")).alias("p")))
        ready.append(sized.where("NOT done AND NOT large").select("forest", "tree", "id", "node", "key"))
        large = sized.where("NOT done AND large").drop("done", "large")
        splits = written(_best_splits(large.join(wide, ["forest", "id"]), width, settings), "tree-splits")
        made.append(splits.select(*NODE, "feature", "decrease"))
        if splits.isEmpty():  # nothing moves any more: what is left are leaves
            ended.append(large.select("forest", "tree", "id", (F.col("pos") / F.col("n")).alias("p")))
            below = reduce(DataFrame.unionAll, ready).join(wide, ["forest", "id"])
            groups = below.select("forest", F.concat_ws(":", "tree", "node").alias("part"), F.array(_at("tree", F.col("node"), F.col("key"))).alias("starts"), "id", "train", "y", "x")
            return reduce(DataFrame.unionAll, ended), reduce(DataFrame.unionAll, made), groups
        level = written(_moved(large.join(wide, ["forest", "id"]), splits, settings.min_leaf), "tree-level")


def _grown(inputs: DataFrame, width: int, settings: TreeSettings, what: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """What the groups hand on, and the leaves and splits above them if there are levels."""
    inputs = written(inputs, "tree-inputs")
    forests, largest = inputs.groupBy("forest").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if (largest or 0) * width <= settings.local_values:
        return written(_whole_in_tasks(inputs, forests, (largest or 0) * width, settings, what), "trees"), None, None
    bound = max(1, min(settings.local_values, LARGE) // width)  # rows of these nodes are not packed
    leaves, splits, groups = _by_levels(inputs, width, bound, settings)
    return written(_grown_in_tasks(groups, settings, what), "trees"), leaves, splits


def grow(inputs: DataFrame, width: int, settings: TreeSettings) -> tuple[DataFrame, DataFrame]:
    """``forest, tree, id, p`` of every row in every tree, and ``forest, tree, node, feature, decrease`` of all splits."""
    grown, leaves, splits = _grown(inputs, width, settings, GROWN)
    below = grown.select("forest", "tree", F.inline(F.arrays_zip(F.col("ids").alias("id"), "p")))
    cut = grown.select("forest", "tree", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("features").alias("feature"), F.col("decreases").alias("decrease"))))
    return (below, cut) if leaves is None else (leaves.unionByName(below), splits.unionByName(cut))


def probabilities(rows: DataFrame, features: Sequence[str], label: str, forests: Sequence[int], settings: TreeSettings, key: str = "grid_id") -> DataFrame:
    """``forest, key, p``: mean over the trees of a forest of the positive share in a row's leaf."""
    grown, leaves, _ = _grown(forest_inputs(rows, features, label, forests, key), len(features), settings, SHARES)
    shares = grown.select("forest", "trees", F.inline(F.arrays_zip(F.col("ids").alias("id"), "p")))
    if leaves is not None:
        shares = shares.unionByName(leaves.select("forest", F.lit(1).alias("trees"), "id", "p"))
    return shares.groupBy("forest", F.col("id").alias(key)).agg((F.sum("p") / F.sum("trees")).alias("p"))


def out_of_fold(rows: DataFrame, p: DataFrame, label: str, key: str = "grid_id") -> DataFrame:
    """``key, fold, label, p_oof`` by the forests that did not see a row's fold; a row without a value is an error."""
    both = rows.select(key, "fold", label).join(p.select(F.col("forest").alias("fold"), key, "p"), ["fold", key], "left")
    guarded = F.when(F.col("p").isNull(), F.raise_error(F.lit("row without out-of-fold value")).cast("double")).otherwise(F.col("p"))
    return both.select(key, "fold", label, guarded.alias("p_oof"))


def block_validated_trees(
    rows: DataFrame, features: Sequence[str], label: str, folds: int, settings: TreeSettings = TreeSettings(), key: str = "grid_id"
) -> DataFrame:
    """``key, fold, label, p_oof, p_final`` of ``rows``, which carry a ``fold`` column."""
    p = probabilities(rows, features, label, [*range(folds), FINAL], settings, key)
    final = p.where(F.col("forest") == FINAL).select(key, F.col("p").alias("p_final"))
    return out_of_fold(rows, p, label, key).join(final, key, "left")


def feature_importances(
    rows: DataFrame, features: Sequence[str], label: str, settings: TreeSettings = TreeSettings(), top: int | None = None, key: str = "grid_id"
) -> DataFrame:
    """Mean share of a feature in the impurity decrease of the final trees, highest first."""
    grown, _, above = _grown(forest_inputs(rows, features, label, [FINAL], key), len(features), settings, DECREASES)
    splits = grown.select("tree", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("decreases").alias("decrease"))))
    if above is not None:
        splits = splits.unionByName(above.select("tree", "feature", "decrease"))
    sums = splits.groupBy("tree", "feature").agg(F.sum("decrease").alias("d"))
    whole = sums.groupBy("tree").agg(F.sum("d").alias("t")).where("t > 0")
    shares = sums.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("d") / F.col("t")).alias("s"))
    named = shares.withColumn("n", whole.agg(F.count(F.lit(1))).scalar())
    names = F.array(*[F.lit(f) for f in features])
    table = named.select(F.get(names, F.col("feature")).alias("feature"), (F.col("s") / F.col("n")).alias("importance")).orderBy(F.desc("importance"), "feature")
    return table.limit(top) if top else table
