"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (ASCII letters
lower-cased).  Places where a document holds ``min_match`` words in a row of an
item are seeds.  For a document and an item with seeds, tiles are taken: search
for common stretches of a given length with Karp-Rabin fingerprints, mark the
longest that overlap no earlier tile, one to one, and go on with shorter
lengths down to ``min_match``.  An item is found if its tiles cover at least
``threshold`` of its words, in whatever order they stand in the document.

The benchmark is a query set: it is read in blocks of bounded size, and each
block goes to all tasks; the documents are never shuffled.

Defined results: null and empty texts hold nothing; an item with fewer words
than ``min_match`` is never found; repeated documents and repeated items give
one row per pair of rows; null ids are kept; further columns are ignored; an
empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import LOWER, U64, Words, byte_set, map_batches, mix, table, without

WORD_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BLOCK_BYTES = 4 << 20
MODULUS = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % MODULUS


def word_hashes(column: pa.Array) -> Words:
    return Words(column, WORD_BYTES, LOWER)


def seed_hashes(h: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, with the place of the first; none crosses rows."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + n])
    row = np.repeat(np.arange(len(per_row)), per_row)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return out[at], at


class Prints:
    """Karp-Rabin fingerprints of every stretch of a word sequence."""

    def __init__(self, words: np.ndarray):
        self.words = words.tolist()
        self.sums, self.powers = [0], [1]
        for w in self.words:
            self.sums.append((self.sums[-1] * BASE + w) % MODULUS)
            self.powers.append(self.powers[-1] * BASE % MODULUS)

    def of(self, start: int, size: int) -> int:
        return (self.sums[start + size] - self.sums[start] * self.powers[size]) % MODULUS


def greedy_tiles(item: Prints, text: Prints, seeds: list[int], minimum: int) -> list[tuple[int, int, int]]:
    """Tiles ``(text start, item start, words)``; ``seeds`` are the text places where a stretch of ``minimum`` words may start."""
    a, b = item.words, text.words
    free_a, taken_b = [True] * len(a), set()
    tiles: list[tuple[int, int, int]] = []
    size = max(minimum, min(len(a), 20))
    while True:
        # how far an unmarked stretch goes from every place of the item
        run = [0] * (len(a) + 1)
        for i in range(len(a) - 1, -1, -1):
            run[i] = run[i + 1] + 1 if free_a[i] else 0
        where = defaultdict(list)
        for i in range(len(a) - size + 1):
            if run[i] >= size:
                where[item.of(i, size)].append(i)
        found, longest = defaultdict(list), 0
        for j in seeds:
            if j + size > len(b) or any(j + d in taken_b for d in range(size)):
                continue
            for i in where.get(text.of(j, size), ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and j + k not in taken_b:
                    k += 1
                if k >= size:
                    found[k].append((j, i))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k in sorted(found, reverse=True):
            for j, i in sorted(found[k]):
                if all(free_a[i + d] and j + d not in taken_b for d in range(k)):
                    tiles.append((j, i, k))
                    for d in range(k):
                        free_a[i + d] = False
                        taken_b.add(j + d)
        # a stretch that an earlier tile cut short is found again: stay at this length while it yields
        if not found and size == minimum:
            return tiles
        if not found:
            size = max(minimum, size // 2)


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str | None], minimum: int):
        w = word_hashes(pa.array(texts, pa.string()))
        h = w.hashes()
        self.ids = ids
        self.words = [h[s : s + n] for s, n in zip(w.row_start, w.per_row)]
        seeds, at = seed_hashes(h, w.per_row, minimum)
        order = np.argsort(seeds, kind="stable")
        self.seeds, at = seeds[order], at[order]
        self.owner = w.row[at] if len(at) else at
        self.place = at - w.row_start[self.owner] if len(at) else at
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> U64(44)).astype(np.int64)] = True

    def found_in(self, words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, minimum: int, threshold: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """Items covered by one document, given its seed places and their ranges of item seeds."""
        places, cover = defaultdict(set), defaultdict(set)
        for j, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
            for s in range(a, b):
                owner = int(self.owner[s])
                places[owner].add(j)
                cover[owner].update(range(self.place[s], self.place[s] + minimum))
        text = None
        for owner in sorted(places):
            size = len(self.words[owner])
            if len(cover[owner]) < threshold * size:
                continue  # not even overlapping seeds cover enough
            text = text or Prints(words)
            tiles = greedy_tiles(Prints(self.words[owner]), text, sorted(places[owner]), minimum)
            share = sum(k for _, _, k in tiles) / size
            if share >= threshold:
                yield owner, share, tiles


def _blocks(benchmark: DataFrame, min_match: int, item_col: str, item_text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` at most."""
    items = without(benchmark, item_col, item_text_col).toDF("item", "text").filter("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for number in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).orderBy("item", "text").collect()
        yield Items([r["item"] for r in part], [r["text"] for r in part], min_match)


def _search(column: pa.Array, known: Items, min_match: int, threshold: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """``row, item number, coverage, tiles`` for the texts of a batch."""
    w = word_hashes(column)
    h = w.hashes()
    seeds, at = seed_hashes(h, w.per_row, min_match)
    likely = np.flatnonzero(known.maybe[(seeds >> U64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(known.seeds, seeds[likely], "left"), np.searchsorted(known.seeds, seeds[likely], "right")
    hit = np.flatnonzero(hi > lo)
    at, lo, hi = at[likely[hit]], lo[hit], hi[hit]
    rows = w.row[at] if len(at) else at
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)])) if len(rows) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        r = int(rows[a])
        begin = w.row_start[r]
        for owner, share, tiles in known.found_in(h[begin : begin + w.per_row[r]], at[a:b] - begin, lo[a:b], hi[a:b], min_match, threshold):
            yield r, owner, share, tiles


MIN_MATCH, THRESHOLD = 4, 0.6


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``id, item_id, n_words, coverage, tiles`` for every document and item found in it."""
    context = docs.sparkSession.sparkContext
    source = without(docs, id_col, text_col)
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {dict(docs.dtypes)[id_col]}, item {dict(benchmark.dtypes)[item_col]}, n_words int, coverage double, tiles array<struct<text_start: int, item_start: int, words: int>>"
    tile_type = pa.list_(pa.struct([("text_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))

    def of_block(items: Items) -> DataFrame:
        shared = context.broadcast(items)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = shared.value
            found = list(_search(batch.column(1), known, min_match, threshold))
            columns = [
                batch.column(0).take(pa.array([r for r, *_ in found], pa.int64())),
                pa.array([known.ids[o] for _, o, _, _ in found], item_type),
                pa.array([len(known.words[o]) for _, o, _, _ in found], pa.int32()),
                pa.array([s for _, _, s, _ in found], pa.float64()),
                pa.array([[{"text_start": j, "item_start": i, "words": k} for j, i, k in sorted(t)] for *_, t in found], tile_type),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "item", "n_words", "coverage", "tiles"])

        return map_batches(source, one, schema)

    found = reduce(DataFrame.unionAll, map(of_block, _blocks(benchmark, min_match, item_col, item_text_col)))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input without the documents in which an item is found; all columns stay."""
    at = docs.columns.index(text_col)

    def without_block(rest: DataFrame, items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in _search(batch.column(at), shared.value, min_match, threshold)]] = False
            return batch.filter(pa.array(keep))

        return map_batches(rest, one, docs.schema)

    return reduce(without_block, _blocks(benchmark, min_match, item_col, item_text_col), docs)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "coverage", F.size("tiles").alias("n_tiles"), F.lit(True).alias("contaminated"))
