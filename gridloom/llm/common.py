"""Helpers shared by the operators: Arrow batches, word scanning on raw bytes, hashing, folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: odd multipliers of the 64-bit mixer
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(33))) * _M1
    x = (x ^ (x >> U64(33))) * _M2
    return x ^ (x >> U64(33))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType, max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes; ``fn`` may yield or return batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, max_bytes):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes`` at most (one row may be larger)."""
    rows = batch.num_rows
    if batch.nbytes <= max_bytes or rows <= 1:
        if rows:
            yield batch
        return
    half = rows // 2
    yield from sliced(batch.slice(0, half), max_bytes)
    yield from sliced(batch.slice(half), max_bytes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the rows' offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of many texts at once: byte ranges, owning rows and 64-bit hashes.

    ``is_word`` maps a byte to whether it belongs to a word (or to its kind of
    word: 0 is none, and words of different kinds may touch), ``fold`` maps a
    byte to the byte that counts (for instance lower case).  Words never cross
    rows.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, fold: np.ndarray):
        raw, self.offsets = text_bytes(column)
        self.raw = fold[raw]
        n = len(raw)
        kind = np.zeros(n + 1, np.uint8)
        kind[:n] = is_word[raw]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True  # a row's first byte starts a new word
        change = np.append(True, kind[1:] != kind[:-1]) | first
        begins = change & (kind > 0)
        ends = np.append(False, change[1:] & (kind[:-1] > 0))
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=len(self.offsets) - 1).astype(np.int64)
        self.row_start = np.concatenate(([0], np.cumsum(self.per_row)))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word: a polynomial of its bytes, from running sums."""
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = _powers(len(self.raw))
        sums = np.zeros(len(self.raw) + 1, U64)
        np.cumsum(_BYTE_VALUES[self.raw] * up[: len(self.raw)], out=sums[1:])
        # the base is odd, so it has an inverse: the word's place divides out
        value = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept per worker up to the longest batch."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            line = np.full(max(n, 1 << 16), b, U64)
            line[0] = 1
            _POWERS[name] = np.multiply.accumulate(line)
    return _POWERS["up"], _POWERS["down"]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: everything but space and \t \n \v \f \r
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared folder that ``spark.checkpoint.dir`` names."""
    from gridloom.session import cut_lineage

    return cut_lineage(df)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra input columns, whatever they are called, take no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, stem: str) -> str:
    """A prefix with which no column of the input begins."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = "_" + stem
    return stem
