"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A text's set holds the distinct shingles of ``words`` consecutive words.  Equal
sets are folded to one class first.  A sketch has ``size`` coordinates.  In the
first ``size`` rounds each shingle is hashed into one coordinate per round, in as
many more rounds every shingle goes to the round's own coordinate; an earlier
round beats a later one, so all coordinates are filled and most sets are done
after a few rounds.  Bands of ``rows`` coordinates are the buckets.

In a bucket every member is compared with one leader, the member that meets
most others over all its buckets; so a large group of alike texts costs one
comparison per member.  Verified links join components.  Members that are left
outside a bucket's largest component get a leader of their own in a second
turn.  What is left is exact without comparing all with all: let x miss the
leader c, and D(x) be the signed difference of the sets x and c.  Then
|x - y| + |y - x| = |D(x)| + |D(y)| - 2 |D(x) n D(y)|, so a link of x and y
needs at least (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 common elements of D(x)
and D(y) (9 for 80 percent), which is more than 0.  With the elements in order
of their rarity, the first common one must come early enough in both that so
many can follow.  Only pairs of different components with such an element are
compared in full.  No link between bucket mates is lost.

With 40 bands of 5 rows a pair of similarity 0.8 meets with probability
1 - (1 - 0.8^5)^40 > 0.9999998.

Defined results: a null text or one without words has an empty set and is
linked with nothing; rows without id take no part, their component is null and
they are kept; rows that repeat an id belong to one node, which has the links
of all its texts; further columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import LOWER, NON_SPACE, U64, Words, map_batches, mix, table, without, written
from gridloom.llm.components import components

#: of bucket rows: a task of the later steps has about as many
ROWS_PER_TASK = 50_000
FULL = U64(0xFFFFFFFFFFFFFFFF)
VALUE_BITS = U64(40)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = Words(column, NON_SPACE, LOWER)
    h = w.hashes()
    out = []
    for k, (s, n) in enumerate(zip(w.row_start, w.per_row)):
        if n == 0:
            out.append(h[:0])
            continue
        m = min(words, int(n))
        joined = h[s : s + n - m + 1] * U64(0x9E3779B97F4A7C15)
        for j in range(1, m):
            joined = mix(joined + h[s + j : s + n - m + 1 + j])
        out.append(np.unique(mix(joined + U64(m))))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; rows of empty sets stay unfilled."""
    out = np.full((len(sets), size), FULL)
    flat = out.reshape(-1)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate([*sets, np.zeros(0, U64)])
    low = (U64(1) << VALUE_BITS) - U64(1)
    for i in range(2 * size):
        if not len(items):
            break
        v = mix(items ^ mix(np.array([i + 1], U64) * U64(0xA24BAED4963EE407)))
        place = (v >> VALUE_BITS).astype(np.int64) % size if i < size else i - size
        np.minimum.at(flat, rows * size + place, (U64(i) << VALUE_BITS) | (v & low))
        open_rows = (out == FULL).any(axis=1)
        if not open_rows.all():
            stay = open_rows[rows]
            rows, items = rows[stay], items[stay]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per set and band."""
    n, size = sketch.shape
    bands = size // rows
    grid = sketch[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grid[:, :, j])
    return key


def _described(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``id, n_shingles, set_key, bands`` of every text."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(batch.column(1), words)
        keys = band_keys(sketches(sets, bands * rows), rows).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1))),
            ],
            ["id", "n_shingles", "set_key", "bands"],
        )

    return map_batches(docs, one, "id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(batch.column(1), words)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "shingles"])

    return map_batches(docs, one, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    sizes = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    both = F.size(F.array_intersect("x", "y"))
    return pairs.coalesce(tasks).join(left, "a").coalesce(tasks).join(right, "b").filter(sizes).filter(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b").coalesce(tasks)


def _labelled(buckets: DataFrame, joined: DataFrame, tasks: int) -> DataFrame:
    """The buckets that still hold several components: ``bucket, node, weight, label``."""
    rows = buckets.join(joined, "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("label")).coalesce(tasks)
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    return rows.join(mixed, "bucket", "left_semi").coalesce(tasks)


def _star_pairs(rows: DataFrame, tasks: int) -> DataFrame:
    """The leader ``c`` of a bucket with every member ``y`` of another label."""
    first = F.struct((-F.col("weight")).alias("w"), F.xxhash64("node").alias("r"), F.col("node").alias("c"), F.col("label").alias("other"))
    leader = rows.groupBy("bucket").agg(F.min(first).alias("l")).select("bucket", "l.c", "l.other")
    return rows.join(leader, "bucket").filter("label <> other").select("c", F.col("node").alias("y")).coalesce(tasks).distinct()


def _outsiders(rows: DataFrame, tasks: int) -> DataFrame:
    """Members outside their bucket's largest component."""
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n")).coalesce(tasks)
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m")).select("bucket", F.col("m.label").alias("main"))
    return rows.join(main, "bucket").filter("label <> main").drop("main").coalesce(tasks)


def _pairs(star: DataFrame) -> DataFrame:
    return star.select(F.least("c", "y").alias("a"), F.greatest("c", "y").alias("b")).distinct()


def _missed_pairs(star: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs of different components that their differences to a common leader do not rule out."""
    named = labels.select(F.col("node").alias("y"), F.col("component").alias("label"))
    leads = labels.select(F.col("node").alias("c"), F.col("component").alias("lead"))
    rows = star.join(named, "y", "left").coalesce(tasks).join(leads, "c", "left").select("c", "y", F.coalesce("label", "y").alias("label"), F.coalesce("lead", "c").alias("lead")).coalesce(tasks)
    # a leader matters if one of at least two members is outside its component and the members do not all agree
    open_leads = rows.groupBy("c").agg(F.max((F.col("label") != F.col("lead")).cast("int")).alias("some"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("some = 1 AND lo < hi").select("c")
    rows = rows.join(open_leads, "c", "left_semi").coalesce(tasks)
    full = rows.join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("ys")), "y").coalesce(tasks).join(sets.select(F.col("node").alias("c"), F.col("shingles").alias("cs")), "c")
    # of the summed sizes: the largest difference of a linked pair
    share = (100 - percent) / (100 + percent)
    outside = F.col("label") != F.col("lead")
    delta = written(_differences(full.select("c", "y", "label", outside.alias("outside"), "ys", "cs").coalesce(tasks)))
    often = delta.groupBy("c", "more", "e").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("outside").cast("int")).alias("some"))
    ranked = delta.join(often, ["c", "more", "e"]).coalesce(tasks).withColumn("turn", F.row_number().over(Window.partitionBy("c", "y").orderBy("n", "e", "more")))
    # the rank counts all elements; a pair needs one that two components hold, and enough others after it
    useful = ranked.filter("lo < hi AND some = 1").coalesce(tasks).select("c", "more", "e", "y", "label", "outside", "turn", "d_size", "size", "lead_size")
    left_least = (F.col("d_size") - F.col("size") * (share * (1 + 100 / percent))) / 2
    right_least = (F.col("d_size") + (F.col("lead_size") - F.col("size")) * share) / 2
    in_prefix = lambda least: F.col("turn") <= F.col("d_size") + 1 - F.greatest(F.ceil(least - 1e-9), F.lit(1))
    left = useful.filter("outside").filter(in_prefix(left_least)).select("c", "more", "e", F.col("y").alias("x"), F.col("label").alias("other"), F.col("turn").alias("turn_x"), F.col("d_size").alias("d_x"), F.col("size").alias("size_x"))
    right = useful.filter(in_prefix(right_least)).select("c", "more", "e", "y", "label", "turn", "d_size", "size")
    common = (F.col("d_x") + F.col("d_size") - (F.col("size_x") + F.col("size")) * share) / 2
    enough = (1 + F.least(F.col("d_x") - F.col("turn_x"), F.col("d_size") - F.col("turn")) >= common - 1e-9) & (
        F.least("size_x", "size") * 100 >= F.greatest("size_x", "size") * percent
    )
    pairs = left.join(right, ["c", "more", "e"]).filter((F.col("label") != F.col("other")) & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).coalesce(tasks).distinct()


def _differences(full: DataFrame) -> DataFrame:
    """The elements by which a set ``ys`` differs from its leader's ``cs``, one per row, with the sizes."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, more, element, d_size, size, lead_size = [], [], [], [], [], []
        for k in range(batch.num_rows):
            y, c = (np.sort(batch.column(n)[k].values.to_numpy()) for n in (4, 5))
            gain, loss = np.setdiff1d(y, c, assume_unique=True), np.setdiff1d(c, y, assume_unique=True)
            n = len(gain) + len(loss)
            rows.append(np.full(n, k))
            more.append(np.repeat([True, False], [len(gain), len(loss)]))
            element += [gain, loss]
            for column, value in ((d_size, n), (size, len(y)), (lead_size, len(c))):
                column.append(np.full(n, value))
        at = pa.array(np.concatenate(rows))
        values = [pa.array(np.concatenate(x)) for x in (more, element, d_size, size, lead_size)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), *values], ["c", "y", "label", "outside", "more", "e", "d_size", "size", "lead_size"])

    return map_batches(full, one, "c long, y long, label long, outside boolean, more boolean, e long, d_size long, size long, lead_size long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row."""
    source = without(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    described = written(_described(source, words, bands, rows))
    # one node per distinct set, named by its smallest id
    named = described.filter("id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set_key").agg(F.min("id").alias("node"))
    chosen = named.join(classes.select("set_key", F.col("node").alias("id")), ["set_key", "id"], "left_semi")
    members = chosen.select(F.col("id").alias("node"), F.explode("bands").alias("bucket")).select("bucket", "node")
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("bucket", "n")
    placed = members.join(shared, "bucket").distinct()
    buckets = written(placed.select("bucket", "node", "n"))
    # no more tasks than these rows need: small tables leave small numbers of shuffle files
    tasks = 2 + buckets.count() // ROWS_PER_TASK
    buckets = buckets.coalesce(tasks)
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight")).coalesce(tasks)
    buckets = buckets.join(weights, "node").select("bucket", "node", "weight").coalesce(tasks)
    sets = written(_full_sets(source.join(weights.select(F.col("node").alias("id")), "id", "left_semi"), words).distinct()).coalesce(tasks)
    star = written(_star_pairs(buckets.withColumn("label", F.col("node")), tasks))
    links = written(_verified(_pairs(star), sets, percent, tasks))
    outside = _outsiders(_labelled(buckets, components(links), tasks), tasks)
    second = _pairs(_star_pairs(outside, tasks)).join(_pairs(star), ["a", "b"], "left_anti")
    links = links.unionAll(written(_verified(second, sets, percent, tasks)))
    joined = components(links)
    missed = _verified(_missed_pairs(star, joined, sets, percent, tasks), sets, percent, tasks)
    missed = written(missed)
    if not missed.isEmpty():
        joined = components(links.unionAll(missed))
    by_set = classes.join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = described.select("id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


_UPPER = "".join(map(chr, range(65, 91)))

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM w
), items AS (SELECT doc_id, unnest(s) AS g FROM sets),
 both_in AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_in JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (
  SELECT a AS doc_id, b AS other FROM two
  UNION SELECT r.doc_id, t.b FROM reach r JOIN two t ON r.other = t.a
), low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low USING (doc_id)
"""
