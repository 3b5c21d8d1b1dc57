"""Product codes of vectors: k-means per part, with norm-of-sum bounds.

A vector of integers is cut into parts of equal length; each part position has
a codebook, fitted by a number of rounds of "assign every part to the nearest
entry, then replace each entry by the floor of its parts' mean", and a last
assignment gives the codes.

Bounds keep most parts from being compared with all entries again.  A part
carries the distance to its second nearest entry as it was when it was last
compared with all of them, and the number of that round, its stamp.  The
codebooks of all rounds are kept.  In a later round no other entry can be
nearer than that distance less the largest net displacement of an entry between
the stamped codebook and the present one: the norm of the sum of its moves, not
the sum of the moves' norms, which grows even if an entry comes back.  The
distance to the part's own entry is computed exactly.  Only a part that the
bound leaves open is compared with all entries, exactly, in integers.

Each round is one pass over a table in the shared folder: it reads vectors with
their codes, bounds and stamps, and writes them anew.  Sums per entry are added
up in the tasks and then in Spark; only codebooks (``parts`` x ``entries``
rows) come to the driver.

Defined results: a vector that is null, empty or holds null or non-finite
components takes no part; nor does one whose length differs from that of the
first such vector by id, or is not a multiple of ``parts``.  Ties go to the
lower index; rows with equal ids are ordered by their vectors when the first
entries are taken, null ids last; with fewer vectors than entries the codebooks
are smaller; an unused entry stays; an empty table gives an empty table.
Components beyond ``2**26`` in size (after scaling) raise an error, as exact
distances would leave the range of a double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import map_batches, table
from gridloom.session import scratch_path

STATE = "code array<smallint>, bound array<float>, stamp array<tinyint>"
#: above this many labels their sums are not broadcast
BROADCAST_LABELS = 200_000


def integers(vectors: DataFrame, vec_col: str, scale: int, parts: int) -> DataFrame:
    """Rows whose vectors take part, with their integer components as ``v``; the vector itself is dropped."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size(vec_col)
    kept = vectors.filter(F.col(vec_col).isNotNull() & (size > 0) & (size % parts == 0) & fine)
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    far = F.exists(scaled, lambda x: F.abs(x) > 1 << 26)
    checked = F.when(far, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(scaled.cast("array<int>"))
    return kept.withColumn("v", checked).drop(vec_col)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integers held as doubles."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ entries.T) + (entries * entries).sum(1)


def nearest(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, bound: np.ndarray | None, stamp: np.ndarray | None):
    """Assign the rows of ``x`` to the last codebook of one part position.

    Returns code, squared distance, and the bound and stamp to carry on.
    """
    entries, now, n = history[-1], len(history) - 1, len(x)
    far = np.float32(np.inf)
    if code is None:
        code, own = np.zeros(n, np.int64), np.zeros(n)
        bound, stamp, todo = np.zeros(n, np.float32), np.zeros(n, np.int8), np.arange(n)
    else:
        code, bound, stamp = code.astype(np.int64), bound.copy(), stamp.copy()
        own = ((x - entries[code]) ** 2).sum(1)
        # net displacement of the entry, other than a row's own, that moved most since the stamped round
        drift = np.zeros(n)
        for t in np.unique(stamp):
            moved = np.sqrt(((entries - history[t]) ** 2).sum(1)) * (1 + 1e-9)
            order = np.argsort(moved)
            rows = stamp == t
            second = moved[order[-2]] if len(moved) > 1 else 0.0
            drift[rows] = np.where(code[rows] == order[-1], second, moved[order[-1]])
        todo = np.flatnonzero(~(bound - drift > np.sqrt(own) * (1 + 1e-9)))
    if len(todo):
        d = squared(x[todo], entries)
        best = d.argmin(1)
        line = np.arange(len(todo))
        code[todo], own[todo] = best, d[line, best]
        d[line, best] = np.inf
        second = np.sqrt(d.min(1)) if d.shape[1] > 1 else np.full(len(todo), np.inf)
        low = second.astype(np.float32)
        bound[todo] = np.where(np.isinf(low), far, np.nextafter(low, np.float32(-1)))
        stamp[todo] = now
    return code, own, bound, stamp


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def assigned(rows: DataFrame, history: list[np.ndarray], final: bool = False) -> DataFrame:
    """One pass: the rows with new codes, bounds and stamps; the last pass gives ``code`` and ``error`` only."""
    parts = len(history[0])
    keep = [f for f in rows.schema.fields if f.name not in ("v", "code", "bound", "stamp")]
    n, known = len(keep), "code" in rows.columns
    ordered = rows.select(*[F.col(f"`{f.name}`") for f in keep], "v", *(["code", "bound", "stamp"] if known else []))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        v = _matrix(columns[n], np.float64)
        old = [_matrix(columns[n + 1 + i], t) for i, t in enumerate((np.int64, np.float32, np.int8))] if known else None
        width = v.shape[1] // parts
        got = [
            nearest(v[:, p * width : (p + 1) * width], [h[p] for h in history], *([o[:, p] for o in old] if old else (None,) * 3)) for p in range(parts)
        ]
        code, own, bound, stamp = (np.stack([g[i] for g in got], 1) for i in range(4))
        named = columns[:n] + ([] if final else [columns[n]]) + [_lists(code.astype(np.int16), pa.int16())]
        named += [pa.array(own.sum(1).astype(np.int64))] if final else [_lists(bound, pa.float32()), _lists(stamp, pa.int8())]
        return pa.RecordBatch.from_arrays(named, [f"c{i}" for i in range(len(named))])

    added = "code array<smallint>, error long" if final else f"v array<int>, {STATE}"
    schema = StructType([StructField(f.name, f.dataType) for f in keep] + list(StructType.fromDDL(added)))
    return map_batches(ordered, one, schema)


def entry_sums(rows: DataFrame, parts: int, entries: int) -> list[dict[tuple[int, int], list[int]]]:
    """Count and component sums of every used entry: ``{(part, entry): [count, sum, ...]}``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, code = _matrix(batch.column(0), np.float64), _matrix(batch.column(1), np.int64)
            width = v.shape[1] // parts
            if total is None:
                total = np.zeros((parts, width + 1, entries), np.int64)
            for p in range(parts):
                total[p, 0] += np.bincount(code[:, p], minlength=entries)
                for j in range(width):
                    # exact: a batch's sum of integers stays far below 2**53
                    total[p, j + 1] += np.bincount(code[:, p], v[:, p * width + j], entries).astype(np.int64)
        if total is not None:
            p, j, e = np.indices(total.shape).reshape(3, -1).astype(np.int32)
            used = np.broadcast_to(total[:, :1] > 0, total.shape).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (p, j, e, total.ravel())], ["p", "j", "e", "s"])

    sums = rows.select("v", "code").mapInArrow(run, "p int, j int, e int, s long")
    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("p", "e", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # codebook-sized
        out.setdefault((r["p"], r["e"]), {})[r["j"]] = int(r["s"])
    return {k: [d[j] for j in range(len(d))] for k, d in out.items()}


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks of all rounds (the last one is the one in use).

    The frame has the input's columns but the vector, and ``code array<smallint>, error long``.
    Input columns with the names ``v``, ``code``, ``error``, ``bound`` and ``stamp`` must be renamed before.
    """
    clash = {"v", "code", "error", "bound", "stamp"} & {c.lower() for c in vectors.columns if c != vec_col}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    spark = vectors.sparkSession
    rows = integers(vectors, vec_col, scale, parts)
    order = [F.col(id_col).asc_nulls_last(), "v"]
    first = [r["v"] for r in rows.select(id_col, "v").orderBy(*order).limit(1).collect()]
    if not first:
        return rows.drop("v").withColumns({"code": F.lit(None).cast("array<smallint>"), "error": F.lit(None).cast("bigint")}), []
    rows = rows.filter(F.size("v") == len(first[0]))
    seeds = np.array([r["v"] for r in rows.select(id_col, "v").orderBy(*order).limit(entries).collect()], np.float64)
    width = seeds.shape[1] // parts
    history = [np.stack([seeds[:, p * width : (p + 1) * width] for p in range(parts)])]
    for k in range(rounds):
        path = scratch_path(spark, f"codes-{k}")
        assigned(rows, history).write.parquet(path)
        rows = spark.read.parquet(path)
        book = history[-1].copy()
        for (p, e), (count, *sums) in entry_sums(rows, parts, seeds.shape[0]).items():
            book[p, e] = [s // count for s in sums]
        history.append(book)
    return assigned(rows, history, final=True), history


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``label_error``: the error summed over all rows with the same label, nulls together."""
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)  # a checked number of rows; beyond it, adaptive execution splits a hot label's rows
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def codebook_digest(book: np.ndarray | None) -> str:
    flat = [] if book is None else book.astype(np.int64).ravel().tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, history = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    path = scratch_path(spark, "codes-final")
    coded.write.parquet(path)
    return with_label_errors(spark.read.parquet(path)).select(
        "vec_id",
        F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0")))).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(history[-1] if history else None)).alias("codebooks_sha256"),
    )


def _round_sql(r: int) -> str:
    d = " + ".join(f"(x.x{j} - c.x{j}) * (x.x{j} - c.x{j})" for j in range(4))
    mean = ", ".join(f"CASE WHEN n IS NULL THEN c.x{j} ELSE (s{j} - (s{j} % n + n) % n) // n END AS x{j}" for j in range(4))
    sums = ", ".join(f"CAST(sum(x.x{j}) AS BIGINT) AS s{j}" for j in range(4))
    return f"""
), a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(({d}) * 64 + k) % 64 AS k, min(({d}) * 64 + k) // 64 AS d FROM x JOIN c{r} c USING (p) GROUP BY vec_id, p
), m{r} AS (
  SELECT p, k, count(*) AS n, {sums} FROM x JOIN a{r} USING (vec_id, p) GROUP BY p, k
), c{r + 1} AS MATERIALIZED (
  SELECT p, k, {mean} FROM c{r} c LEFT JOIN m{r} USING (p, k)"""


#: for vectors of 64 components, as all given ones are
OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, p, {", ".join(f"v[4 * p + {j + 1}] AS x{j}" for j in range(4))} FROM v, unnest(range(16)) u(p)
), c0 AS (
  SELECT p, k, {", ".join(f"x{j}" for j in range(4))}
  FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 64) USING (vec_id){_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
), e AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256
FROM e JOIN v USING (vec_id)
"""
