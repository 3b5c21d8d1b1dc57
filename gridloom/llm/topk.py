"""Exact top-k search by inner product with MaxScore.

A component is a term: a positive weight belongs to the posting list (d, +), a
negative one to (d, -).  For a query only the lists of its own signs can raise a
score; the opposite lists lower it.  In a shard every list has its largest
weight as a bound.  The lists with the smallest bounds whose sum stays below
the k-th best score so far are non-essential: a vector found in none of the
others cannot get into the result.  The essential lists are traversed, their
vectors are kept while sum plus remaining bounds can compete, and the
non-essential lists are probed for those only.  Shards give their k best, which
are merged.

Queries come in blocks of bounded size, vectors in shards of bounded size; a
task handles one block and one shard.

Defined results: vectors that are null or hold a null, NaN or infinite
component, and rows without id, take no part; rows that repeat an id with the
same vector count once, an id with several vectors is a candidate with each; a
row is no candidate of a query of its own id; missing components of shorter
vectors count as 0; ties go to the smaller id; fewer candidates than k give
fewer rows; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import shuffle_partitions, table, without

SHARD_ROWS, BLOCK_ROWS = 4096, 512


def quantised(column: str, scale: int = 256) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(column: str) -> Column:
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad


class Shard:
    """Posting lists of some vectors, with their bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((np.arange(len(ids)), ids))
        self.ids, self.x = ids[order], x[order]
        self.lists = {}
        for d in range(x.shape[1]):
            w = self.x[:, d]
            for sign in (1, -1):
                at = np.flatnonzero(w * sign > 0)
                if len(at):
                    own = np.abs(w[at])
                    heads = at[np.argpartition(-own, min(8, len(at) - 1))[:8]]
                    self.lists[d, sign] = (at, own, own.max(), heads)

    def best(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors of another id."""
        terms = [(abs(q[d]), *self.lists[d, s], d) for d in np.flatnonzero(q) if (d, s := 1 if q[d] > 0 else -1) in self.lists]
        bounds = np.array([t[0] * t[3] for t in terms])
        up = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[up])
        heads = np.unique(np.concatenate([terms[t][4] for t in up[::-1][:8]])) if terms else np.zeros(0, np.int64)
        heads = heads[self.ids[heads] != qid]
        floor_score = np.partition(self.x[heads] @ q, -k)[-k] if len(heads) >= k else None
        if floor_score is None or floor_score <= 0:
            found = np.flatnonzero(self.ids != qid)  # nothing can be left out yet
        else:
            spare = int(np.searchsorted(below, floor_score, side="left"))  # non-essential: their sum is less than the k-th best
            got = np.zeros(len(self.ids), self.x.dtype)
            for t in up[spare:]:
                weight, at, own = terms[t][:3]
                got[at] += weight * own
            left = below[spare - 1] if spare else 0
            found = np.flatnonzero((got > 0) & (got + left >= floor_score))
            got = got[found]
            for t in up[:spare][::-1]:
                weight, _, _, bound, _, d = (*terms[t][:3], terms[t][3], terms[t][4], terms[t][5])
                left -= weight * bound
                got = got + np.maximum(self.x[found, d] * q[d], 0)
                stay = got + left >= floor_score
                found, got = found[stay], got[stay]
            found = found[self.ids[found] != qid]
        score = self.x[found] @ q  # exact, with what the opposite lists take away
        top = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][top], score[top]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "vector", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` over integer vectors; ``queries`` picks the query rows."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("is_query", queries).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("vector"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "vector"])
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_query").cast("int")), F.lit(0)).alias("q"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    shards, blocks, width = -(-size["n"] // shard_rows) or 1, -(-size["q"] // block_rows) or 1, size["width"]
    spread = F.xxhash64("vec_id", "vector")
    tasks = max(1, min(4 * shards * blocks, 8 * shuffle_partitions(spark)))
    # both sides need keys of one type, or equal keys are dealt to different tasks
    own_shard, own_block = F.pmod(spread, F.lit(shards).cast("bigint")), F.pmod(spread, F.lit(blocks).cast("bigint"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.withColumn("shard", own_shard).withColumn("block", all_of(blocks))
    right = rows.filter("is_query").withColumn("block", own_block).withColumn("shard", all_of(shards))
    keys = ["block", "shard"]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            x, q = _matrix(a["vector"], width), _matrix(b["vector"], width)
            if float(np.abs(x).max()) * float(np.abs(q).max()) * width < 2.0**53:
                x, q = x.astype(np.float64), q.astype(np.float64)  # still exact integers, and faster
            shard = Shard(a["vec_id"].to_numpy(), x)
            for qid, mark, vector in zip(b["vec_id"], b["mark"], q):
                ids, scores = shard.best(qid, vector, k)
                out["query"] += [mark] * len(ids)
                out["query_id"] += [qid] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out)

    left = left.select(*keys, "vec_id", "vector").repartition(tasks, *keys)
    right = right.select(*keys, "vec_id", "vector", spread.alias("mark")).repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = without(rows, "vec_id", "embedding").filter(usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    return top_k(rows, F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
WHERE rank <= 5
"""
