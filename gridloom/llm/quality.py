"""Quality classifier by importance resampling.

Texts are bags of hashed words, punctuation runs and their bigrams; two equal
words in a row share one bigram of their own, so stuttering text is seen as
such.  Two generative models are counted over them: the target model over texts
labelled as good, the raw model over all texts.  A text's log weight is the sum
of the log ratios of its features.  The weights' Gumbel top-k is a sample
without replacement in proportion to the weights; its size k is the number of
texts whose weight reaches a cut.  A quarter of the good labelled texts is held
out of the target model; the cut is set on them so that all but one in
``1 / (1 - keep_target)`` reach it, as unlabelled good texts will.  The sample is
drawn by the weights to the power of ``1 / temperature``: the noise of the keys,
and with it the chance of a good text just above the cut to be left out, is
small.

The labels are a bounded sample (``max_labels``, in the order of a hash of the
id); the raw counts, the weights, k and the k-th key cover all texts.

Defined results: a null or empty text has weight 0; without labels of good texts
all weights are 0 and everything is kept; a document with several labels counts
as good only if all say so, null labels say nothing; rows that repeat an id
draw the same number; ties with the k-th key stay; further columns are kept as
they are; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import LOWER, NON_SPACE, U64, Words, byte_set, fresh, map_batches, mix, sliced, table, without, written

KINDS = NON_SPACE.astype(np.uint8) * 2
KINDS[byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1


@dataclass(frozen=True)
class Weigher:
    """Log ratios by bucket, and the cut of the log weight."""

    ratio: np.ndarray
    cut: float


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature."""
    w = Words(column, KINDS, LOWER)
    h = w.hashes()
    same_row = w.row[1:] == w.row[:-1]
    pairs = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[1:] == h[:-1]] = U64(0x5851F42D4C957F2D)
    items = np.concatenate((mix(h), pairs[same_row]))
    rows = np.concatenate((w.row, w.row[:-1][same_row]))
    return (items % U64(buckets)).astype(np.int64), rows


def feature_counts(labelled: DataFrame, buckets: int) -> DataFrame:
    """``bucket, raw, target`` of ``text, good`` rows; a task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sliced(batch):
                item, row = features(part.column(0), buckets)
                raw += np.bincount(item, minlength=buckets)
                good = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                target += np.bincount(item[good[row]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return labelled.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def label_sample(labels: DataFrame, max_labels: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id, good, held_out`` of at most ``max_labels`` labelled documents."""
    rows = without(labels, id_col, label_col).toDF("id", "label").filter("id IS NOT NULL AND label IS NOT NULL")
    chosen = rows.groupBy("id").agg((F.min("label") > 0).alias("good")).orderBy(F.xxhash64("id"), "id").limit(max_labels)
    return chosen.withColumn("held_out", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0)


def weighed(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", name: str = "log_weight") -> DataFrame:
    """All columns of the input and the log weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        item, row = features(batch.column(at), len(shared.value))
        total = np.bincount(row, shared.value[item], batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(total[: batch.num_rows])], [*batch.schema.names, name])

    return map_batches(docs, one, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 10000, max_labels: int = 20000, keep_target: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> Weigher:
    texts = without(docs, id_col, text_col).toDF("id", "text")
    sample = written(label_sample(labels, max_labels))  # at most max_labels rows: small enough to be sent to every task
    joined = texts.join(F.broadcast(sample), "id", "left")
    counts = feature_counts(joined.select("text", (F.col("good") & ~F.col("held_out")).alias("good")), buckets).collect()  # at most one row per bucket
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return Weigher(np.zeros(buckets), -math.inf)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    good = texts.join(F.broadcast(sample.filter("good AND held_out")), "id").select("text")
    reached = sorted(r["log_weight"] for r in weighed(good, ratio).select("log_weight").collect())  # of the sample
    return Weigher(ratio, reached[int(len(reached) * (1 - keep_target))] if reached else -math.inf)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, small: int = 2000) -> float:
    """The k-th largest of a column ``key``: histograms of ever narrower ranges, then the few values left."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.filter(F.col("key").between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        found = {r["slot"]: r for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for s in sorted(found, reverse=True):
            r = found[s]
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["lo"], r["hi"]
        if r["n"] <= small:
            rest = sorted((x["key"] for x in keys.filter(F.col("key").between(low, high)).select("key").collect()), reverse=True)
            return rest[k - above - 1]


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 1, temperature: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column, Column, float]:
    """The input with its weights: the table, its columns of log weight and key, and the key that the k-th text reaches."""
    weigher = fit(docs, labels, id_col=id_col, text_col=text_col)
    name = fresh(docs, "_log_weight")
    weight, key = F.col(name), F.col(name) + temperature * gumbel(id_col, seed)
    narrow = written(weighed(without(docs, id_col, text_col), weigher.ratio, text_col, name).select(weight.alias("weight"), key.alias("key")))
    k = narrow.filter(F.col("weight") >= weigher.cut).count()
    bound = kth_largest(narrow.select("key"), k) if k else math.inf
    return weighed(docs, weigher.ratio, text_col, name), weight, key, bound


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored, weight, key, bound = resampled(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", weight.alias("log_weight"), key.alias("key"), (key >= bound).alias("kept"))
