"""Runs of words that repeat with a period: maximal pairs from the tree of LCP intervals.

A run with smallest period ``q`` that starts at word ``i`` and is ``L`` words
long is a maximal pair: the places ``i`` and ``i + q`` have ``L - q`` words in
common, the words to their left differ, and so do the words after the common
part.  The other way round, a maximal pair at a distance ``d`` whose common
part is at least ``(times - 1) * d`` words long is a run as it stands; nothing
has to be extended.  (``d`` may be a multiple of the smallest period; the pair
at the smallest period has the same start and length, and it is kept.)

The suffixes of all documents of a batch are sorted by prefix doubling, where
only suffixes that are still tied are touched.  Words are numbered per
document, so nothing matches across documents.  The LCP intervals are then
visited bottom up.  Each holds its places in order together with the class of
each, its left word.  Where a child's list is merged into its parent's, the
smaller one into the larger, every place meets its neighbours of the other
list: neighbours of different classes are a maximal pair whose common part is
the interval's.  Neighbours suffice, because a place between ``i`` and
``i + q`` would give the run a smaller period.  Sets of suffixes in which no
two places are near enough for their longest common part cannot hold a run and
are left out before the tree is built.

Spark deals the documents; a document is one row, so the work has no shuffle.
A task holds a batch of about four megabytes of text or one longer document
(about 60 bytes a word and 4 more for each doubling).

Defined results: a null or empty text, or one of white space only, has no
words, no runs and an empty collapsed text; a null id is kept; repeated rows
give repeated results; further input columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, table, without

RUN = "struct<start: long, length: long, period: long>"


def least_common(min_length: int, times: int) -> int:
    """The shortest common part that any run's pair can have."""
    return min(max(min_length - q, (times - 1) * q) for q in range(1, min_length + 1))


def sorted_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix shares ``least`` words with another one, in suffix order, and
    the common part of each with the place before it (0 where it is shorter than ``least``).

    Equal codes must stand in one document only.  Reading over the end of a
    document is harmless then: of two equal stretches the later one would meet
    a word of the next document, which the earlier one cannot hold.
    """
    n = len(codes)
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    tied = np.flatnonzero(counts[inverse] > 1)
    levels, wanted, k = [rank.astype(np.int32)], tied, 1
    while len(tied):
        if k <= least:
            wanted = tied
        after = tied + k
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = tied[by], key[by]
        old = rank[at]
        place = np.arange(len(at))
        old_first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        new = np.append(True, key[1:] != key[:-1])
        new_first = np.maximum.accumulate(np.where(new, place, 0))
        rank[at] = old + new_first - old_first
        tied = at[~(new & np.append(new[1:], True))]
        levels.append(rank.astype(np.int32))
        k *= 2
    order = wanted[np.argsort(rank[wanted])]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        level = levels[step]
        same = (np.maximum(a, b) < n) & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        move = same.astype(np.int64) << step
        common += move
        a += move
        b += move
    common[common < least] = 0
    return order, np.append(0, common) if len(order) else common


def _near(order: np.ndarray, common: np.ndarray, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Only sets of suffixes (between two zeros) with two places near enough for their longest common part."""
    group = np.cumsum(common == 0) - 1
    if not len(group):
        return order, common
    longest = np.maximum.reduceat(common, np.flatnonzero(common == 0))
    by = np.lexsort((order, group))
    gap = np.diff(order[by])
    inside = np.diff(group[by]) == 0
    common_most = longest[group[by[1:]]]
    fits = inside & (gap + common_most >= np.maximum(min_length, times * gap))
    keep = np.zeros(len(longest), bool)
    keep[group[by[1:]][fits]] = True
    chosen = keep[group]
    return order[chosen], common[chosen]


def maximal_pairs(order: list[int], common: list[int], left: list[int], min_length: int, times: int) -> list[tuple[int, int, int]]:
    """``(start, length, distance)`` of the maximal pairs that are runs.

    ``common[k]`` is what the suffixes ``order[k - 1]`` and ``order[k]`` share,
    ``left`` maps a place to its class.
    """
    found: list[tuple[int, int, int]] = []

    def pair(p: int, q: int, shared: int) -> None:
        d = q - p
        if shared + d >= times * d and shared + d >= min_length and left[p] != left[q]:
            found.append((p, shared + d, d))

    def merge(a: list[int], b: list[int], shared: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        size = len(a)
        for p in b:
            k = bisect_left(a, p)
            if k < size:
                pair(p, a[k], shared)
            if k:
                pair(a[k - 1], p, shared)
        if 8 * len(b) < size:
            for p in b:
                insort(a, p)
        else:
            a += b
            a.sort()
        return a

    depth, members, one = [0], [[]], order[:1]
    for place, shared in zip(itertools.chain(order[1:], [0]), itertools.chain(common[1:], [0])):
        while depth[-1] > shared:
            one = merge(members.pop(), one, depth.pop())
        if shared:
            if depth[-1] == shared:
                members[-1] = merge(members[-1], one, shared)
            else:
                depth.append(shared)
                members.append(one)
        one = [place]
    return found


def find_runs(codes: np.ndarray, min_length: int = 6, times: int = 4) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of a sequence of word codes, by start, then period."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    order, common = _near(*sorted_suffixes(codes, least_common(min_length, times)), min_length, times)
    if not len(order):
        return np.zeros((0, 3), np.int64)
    found = np.array(maximal_pairs(order.tolist(), common.tolist(), [-1, *codes[:-1].tolist()], min_length, times), np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(docs: DataFrame, min_length: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row.

    ``runs`` lists every maximal stretch of at least ``min_length`` words and
    ``times`` periods by start, then period; ``collapsed`` is the text with one
    period of each run, words joined by single spaces.  Words are what stands
    between ASCII white space.
    """
    if times < 2 or min_length < 2:
        raise ValueError("a run needs two words and two periods at least")
    kind = dict(docs.dtypes)[id_col]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0, *map(len, words)])
        codes = np.empty(ends[-1], np.int64)
        for line, a, b in zip(words, ends, ends[1:]):
            known: dict[bytes, int] = {}
            codes[a:b] = list(map(known.setdefault, line, range(a, b)))
        runs = find_runs(codes, min_length, times)
        start, length, period = runs.T
        step = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        kept = np.cumsum(step) <= 0
        collapsed = [b" ".join(itertools.compress(line, kept[a:b].tolist())) for line, a, b in zip(words, ends, ends[1:])]
        cut = np.searchsorted(start, ends).astype(np.int32)
        owner = np.searchsorted(ends, start, side="right") - 1
        rows = pa.StructArray.from_arrays([pa.array(start - ends[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cut), rows)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(ends)), lists, pa.array(collapsed, pa.binary())], ["id", "n_words", "runs", "collapsed"]
        )

    out = map_batches(without(docs, id_col, text_col), one, f"id {kind}, n_words long, runs array<{RUN}>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with the contract's periodic tail in every document whose id hash ends in 0."""
    word = f"filter(split(coalesce(`{text_col}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+', -1), x -> x != '')"
    tail = f"""
      transform(array({word}), w -> CASE WHEN size(w) = 0 THEN '' ELSE
        transform(array(named_struct('a', g % size(w), 'p', 1 + (size(w) - g % size(w)) div (3 + g % 8))), s ->
          concat_ws(' ', transform(w, (x, i) -> CASE WHEN i < s.a THEN x ELSE w[int(s.a + (i - s.a) % s.p)] END)))[0] END)[0]
    """
    h = f"crc32(cast(cast(`{id_col}` AS string) AS binary))"
    return F.expr(f"CASE WHEN {h} % 10 = 0 THEN transform(array({h} div 10), g -> {tail})[0] ELSE `{text_col}` END")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return periodic_runs(docs).select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: pairs of places with the same five words at one distance; islands of them are the runs
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS UBIGINT) AS c FROM documents
  UNION ALL
  SELECT doc_id, text, s, k + 1,
         list_reduce([xor(c, CAST(ascii(s[k + 1]) AS UBIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END)
  FROM bits WHERE k < length(s)
), d AS (
  SELECT doc_id, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o
  FROM bits WHERE k = length(s)
), p AS (
  SELECT doc_id, h, o, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a,
         1 + (len(o) - (h // 10) % greatest(len(o), 1)) // (3 + (h // 10) % 8) AS p FROM d
), x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END for i in range(n)] ELSE o END AS w FROM p
), g AS (
  SELECT doc_id, i, hash(w[i + 1 : i + 5]) AS five, w[i + 1 : i + 5] AS words, n FROM x, unnest(range(n - 4)) u(i)
), pairs AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q FROM g l JOIN g r ON l.doc_id = r.doc_id AND l.five = r.five AND l.words = r.words
  WHERE r.i > l.i AND 4 * (r.i - l.i) <= l.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs) GROUP BY doc_id, q, part
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, min([-length, start, period]) AS best,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM x) ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length,
       CAST(best[3] AS BIGINT) AS period, CAST(-1000 * best[1] // best[3] AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
