"""Removal of long repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document with a smaller id or earlier in the same one.  Strings are judged
on the input.

Equal strings must meet in one task without moving every suffix.  Every string
of ``length`` bytes is assigned to one of its substrings of ``gram`` bytes, the
one with the smallest hash (the leftmost, if several).  Equal strings choose the
same substring at the same offset, and neighbouring strings mostly choose the
same one, so a text falls into runs of starts, about one per 39 bytes.

1. Documents with equal texts are folded: all but the one with the smallest id
   repeat it in full.
2. Runs are counted by the hash of their substring; within a slice of texts a
   run that repeats a whole earlier one is settled at once, so a passage that a
   third of all documents share is sent once per slice, not once per document.
3. Runs whose substring occurs once cannot repeat and are dropped.  The others
   send their bytes; if the runs of one substring have more bytes than an array
   may hold, they send a 128-bit digest of the ``length`` bytes at each start.
4. Bucket by bucket the bytes of different runs are put end to end, the suffix
   array is built by two-stage sorting, and adjacent common prefixes of
   ``length`` bytes give the classes of equal strings.  All but the earliest of
   a class are repeats.  Digests are dealt by their value; equal ones are a class.
5. The repeats of each document are merged and cut out of its bytes.

The texts are shuffled once, by id; that exchange serves all steps.

Defined results: a null or empty text has no bytes and nothing is removed; rows
that repeat an id and its text are one place, so none is earlier than the
other, and give equal rows; texts of one id that differ are told apart by their
hash, and equal starts in them are no repeats of each other; rows without id
come after all ids; further columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import U64, map_batches, mix, shuffle_partitions, table, text_bytes, without
from gridloom.llm.suffix import same_prefix, suffix_array

LAST_ID = 2**63 - 1
BUCKET_BYTES = 8 << 20
ARRAY_BYTES = 4 << 20
#: starts of hot substrings that are folded at once
HOT_STARTS = 100_000
#: kinds of rows that go from step to step
RUN, REPEAT, HOT = 0, 1, 2


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place on (short ones at the end are meaningless)."""
    power = np.array([0x9E3779B97F4A7C15], U64)  # an array: numpy warns when a scalar wraps around
    out = np.zeros(len(raw), U64)
    block, size, done = mix(raw.astype(U64) + U64(1)), 1, 0
    while done < gram:
        if gram & size:
            part = np.zeros_like(block)
            part[: len(raw) - done] = block[done:]
            out = out * power + part
            done += size
        if done < gram:
            nxt = block * power
            nxt[: len(raw) - size] += block[size:]
            block, size, power = nxt, size * 2, power * power
    return mix(out)


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share their smallest gram: rows, first starts, numbers of starts, gram hashes."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < length:
        return none, none, none, none.view(U64)
    hashes = gram_hashes(raw, gram)
    bits = U64(max(int(n).bit_length(), 1))
    key = ((hashes >> bits) << bits) | np.arange(n, dtype=U64)
    width, low, span = length - gram + 1, key, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), starts)
    if not len(row):
        return none, none, none, none.view(U64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[row]
    best = (low[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]))))
    counts = np.diff(np.append(cut, len(row)))
    return row[cut], at[cut] - offsets[row[cut]], counts, hashes[best[cut]]


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for k in np.lexsort((end, start)):
        s, e = int(start[k]), int(end[k])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _pack(**columns: np.ndarray) -> bytes:
    """Equally long columns, one after the other; fields as in ``FIELDS``."""
    return b"".join(np.ascontiguousarray(columns[k], t).tobytes() for k, t in FIELDS)


def _unpack(payloads: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in FIELDS)
    parts: dict[str, list] = {k: [] for k, _ in FIELDS}
    for p in payloads:
        n, at = len(p) // size, 0
        for k, t in FIELDS:
            parts[k].append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, t) for (k, t), v in zip(FIELDS, parts.values())}


FIELDS = [("oid", "<i8"), ("key", "<i8"), ("start", "<i4"), ("count", "<i4"), ("kind", "<u1"), ("hash", "<u4")]
PLACES = "oid long, key long, start int, count int, kind int, hash long"


def _gathered(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Step 2, before the shuffle: packed runs by bucket, local repeats among them."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        oid, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        raw, offsets = text_bytes(batch.column(2))
        row, start, count, hashes = runs_of(raw, offsets, length, gram)
        if not len(row):
            return
        kind = np.zeros(len(row), np.uint8)
        keep = np.ones(len(row), bool)
        order = np.lexsort((start, key[row], oid[row], hashes))
        same = np.concatenate((hashes[order][1:] == hashes[order][:-1], [False]))
        often = same | np.concatenate(([False], same[:-1]))
        seen: dict[bytes, tuple[int, int, int]] = {}
        for k in order[often]:
            r, s = row[k], start[k]
            content = raw[offsets[r] + s : offsets[r] + s + count[k] + length - 1].tobytes()
            here = (int(oid[r]), int(s), int(key[r]))
            first = seen.setdefault(content, here)
            if first[:2] < here[:2]:
                kind[k] = REPEAT
            elif first == here and keep[k] and first is not here:
                keep[k] = False  # the same row again
        # neighbouring repeats of a text travel as one
        rep = np.flatnonzero((kind == REPEAT) & keep)
        joined = np.zeros(len(row), bool)
        if len(rep):
            glued = np.concatenate(([False], (row[rep][1:] == row[rep][:-1]) & (start[rep][1:] == start[rep][:-1] + count[rep][:-1])))
            heads = np.flatnonzero(~glued)
            count[rep[heads]] = np.add.reduceat(count[rep], heads)
            joined[rep[glued]] = True
        use = np.flatnonzero(keep & ~joined)
        spread = np.where(kind[use] == REPEAT, mix(key[row[use]].view(U64)), hashes[use])
        bucket = (spread % U64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        use, bucket = use[turn], bucket[turn]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.array([0])
        packs = [
            _pack(oid=oid[row[u]], key=key[row[u]], start=start[u], count=count[u], kind=kind[u], hash=hashes[u] >> U64(32))
            for u in (use[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        ]
        if packs:
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(packs, pa.binary())], ["bucket", "pack"])

    return map_batches(texts, one, "bucket long, pack binary")


def _repeated_runs(packed: DataFrame, length: int, array_bytes: int) -> DataFrame:
    """Step 2, after the shuffle, and 3: runs whose substring occurs more than once, and the repeats."""

    def one(group: pa.Table) -> pa.Table:
        f = _unpack([p for p in group.column("pack").to_pylist()])
        order = np.argsort(f["hash"], kind="stable")
        order = order[f["kind"][order] == RUN]
        h = f["hash"][order]
        same = np.concatenate((h[1:] == h[:-1], [False])) if len(h) else np.zeros(0, bool)
        often = same.copy()
        often[1:] |= same[:-1]
        head = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        if len(h):
            weight = np.add.reduceat(f["count"][order].astype(np.int64) + length - 1, np.flatnonzero(head))
            f["kind"][order[(weight > array_bytes)[np.cumsum(head) - 1]]] = HOT
        use = np.concatenate((order[often], np.flatnonzero(f["kind"] == REPEAT)))
        group_id = (np.int64(group.column("bucket")[0].as_py()) << 32) + f["hash"][use].astype(np.int64)
        return pa.table(
            {"oid": f["oid"][use], "key": f["key"][use], "start": f["start"][use], "count": f["count"][use], "kind": f["kind"][use].astype(np.int32), "hash": group_id}
        )

    return packed.groupBy("bucket").applyInArrow(one, PLACES)


def _with_bytes(joined: DataFrame, length: int) -> DataFrame:
    """Step 3: the bytes of each run; repeats pass without."""

    names = ("oid", "key", "start", "count", "kind", "hash", "bytes")

    def packed(cols: dict[str, list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in zip(names, types)], list(names))

    def folded(hot: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        """Starts of hot substrings: later ones of equal strings are settled here, the others go on."""
        first: dict[bytes, tuple[int, int]] = {}
        for oid, start, key, digest in sorted(hot):
            there = first.setdefault(digest, (oid, start))
            turn = int.from_bytes(digest[:8], "little", signed=True)
            yield (oid, key, start, 1, HOT, turn, digest) if there == (oid, start) else (oid, key, start, 1, REPEAT, turn, b"")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {k: [] for k in names}
        hot: list[tuple[int, int, int, bytes]] = []
        for oid, key, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode()
            for p in places:
                if p["kind"] == HOT:
                    hot += [(oid, s, key, hashlib.blake2b(raw[s : s + length], digest_size=16).digest()) for s in range(p["start"], p["start"] + p["count"])]
                    if len(hot) >= HOT_STARTS:
                        yield packed(dict(zip(names, map(list, zip(*folded(hot))))))
                        hot = []
                    continue
                cols["oid"].append(oid)
                cols["key"].append(key)
                for k in ("start", "count", "kind", "hash"):
                    cols[k].append(p[k])
                cols["bytes"].append(raw[p["start"] : p["start"] + p["count"] + length - 1] if p["kind"] == RUN else b"")
        yield packed(cols)
        if hot:
            yield packed(dict(zip(names, map(list, zip(*folded(hot))))))

    return map_batches(joined, one, PLACES + ", bytes binary")


def repeats_among(oid: np.ndarray, start: np.ndarray, count: np.ndarray, contents: list[bytes], length: int) -> list[np.ndarray]:
    """For every run, which of its starts have an earlier equal string among all the runs given."""
    first: dict[bytes, int] = {}
    for k in np.lexsort((start, oid)):
        first.setdefault(contents[k], int(k))
    chosen = sorted(first.values())
    text = np.frombuffer(b"\xff".join([*(contents[k] for k in chosen), b""]), np.uint8) + np.uint8(1)  # UTF-8 has no 0xff: the separator becomes 0
    sizes = np.array([len(contents[k]) + 1 for k in chosen])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(chosen)), sizes)
    offset = np.arange(len(text)) - begin[owner]
    starts = count[chosen]
    order = suffix_array(text, length)
    order = order[offset[order] < starts[owner[order]]]
    apart = np.concatenate(([True], same_prefix(text, order[:-1], order[1:], length) < length)) if len(order) else np.zeros(0, bool)
    classes = np.cumsum(apart) - 1
    doc = oid[chosen][owner[order]]
    place = start[chosen][owner[order]] + offset[order]
    rank = np.lexsort((place, doc, classes))
    head = np.concatenate(([True], np.diff(classes[rank]) != 0)) if len(rank) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc[rank] != doc[rank][lead]) | (place[rank] != place[rank][lead])
    is_repeat = np.zeros(len(text), bool)
    is_repeat[order[rank]] = later
    slot = {k: i for i, k in enumerate(chosen)}
    out = []
    for k, content in enumerate(contents):
        f = first[content]
        if oid[f] == oid[k] and start[f] == start[k]:
            b = begin[slot[f]]
            out.append(is_repeat[b : b + count[k]])
        else:
            out.append(np.ones(count[k], bool))  # all of it stands earlier, in the first run with these bytes
    return out


def _settled(runs: DataFrame, buckets: int, length: int, array_bytes: int) -> DataFrame:
    """Step 4: ranges of repeated starts."""

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hash", "ascending"), ("oid", "ascending"), ("key", "ascending"), ("start", "ascending")])
        col = {k: group.column(k).to_numpy() for k in ("oid", "key", "start", "count", "kind", "hash")}
        out: dict[str, list] = {k: [] for k in ("oid", "key", "start", "count")}
        done = np.flatnonzero(col["kind"] == REPEAT)
        for k in out:
            out[k].append(col[k][done])
        hot = np.flatnonzero(col["kind"] == HOT)
        if len(hot):
            digest = np.frombuffer(b"".join(group.column("bytes").take(hot).to_pylist()), U64).reshape(-1, 2)
            rank = np.lexsort((col["start"][hot], col["oid"][hot], digest[:, 1], digest[:, 0]))
            hot, digest = hot[rank], digest[rank]
            head = np.concatenate(([True], (digest[1:] != digest[:-1]).any(axis=1)))
            lead = hot[np.flatnonzero(head)[np.cumsum(head) - 1]]
            later = hot[(col["oid"][hot] != col["oid"][lead]) | (col["start"][hot] != col["start"][lead])]
            for k in out:
                out[k].append(col[k][later])
        rows = np.flatnonzero(col["kind"] == RUN)
        contents = group.column("bytes").take(rows).to_pylist()
        h = col["hash"][rows]
        ends = np.append(np.flatnonzero(np.diff(h)) + 1, len(h)) if len(h) else []
        size = np.cumsum([len(c) for c in contents])
        a = 0
        for i, b in enumerate(ends):  # whole groups, as many as fit into one array
            if i + 1 < len(ends) and size[ends[i + 1] - 1] - (size[a - 1] if a else 0) <= array_bytes:
                continue
            part = rows[a:b]
            for k, mask in zip(part, repeats_among(col["oid"][part], col["start"][part], col["count"][part], contents[a:b], length)):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                for s, e in zip(edge[::2], edge[1::2]):
                    for name, v in (("oid", col["oid"][k]), ("key", col["key"][k]), ("start", col["start"][k] + s), ("count", e - s)):
                        out[name].append(np.array([v]))
            a = b
        return pa.table({k: np.concatenate(v).astype(np.int64 if k in ("oid", "key") else np.int32) for k, v in out.items()})

    # a start of a hot substring weighs as much as some dozens of bytes of a run: more and smaller parts
    part = F.when(F.col("kind") == HOT, buckets + F.pmod(F.xxhash64("hash"), F.lit(16 * buckets))).otherwise(F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    return runs.withColumn("part", part).groupBy("part").applyInArrow(lambda g: one(g.drop_columns(["part"])), "oid long, key long, start int, count int")


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Step 5: ``id, n_bytes, removed`` spans and the kept bytes of every row."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, first, places = (batch.column(i) for i in range(4))
        sizes, spans, kept = [], [], []
        for text, is_first, found in zip(texts.to_pylist(), first.to_pylist(), places.to_pylist()):
            raw = (text or "").encode()
            if not is_first:
                gone = [(0, len(raw))] if len(raw) >= length else []
            else:
                found = found or []
                begin = np.array([p["start"] for p in found], np.int64)
                gone = merged(begin, begin + np.array([p["count"] for p in found], np.int64) + length - 1)
            at, parts = 0, []
            for s, e in gone:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            sizes.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in gone])
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return map_batches(joined, one, "id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """``id, n_bytes, removed, kept``: removed byte ranges and the remaining bytes."""
    spark = docs.sparkSession
    rows = without(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(LAST_ID)).alias("oid"), F.xxhash64("text").alias("key"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    parts = max(shuffle_partitions(spark), -(-total // (64 << 20)))
    firsts = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("oid", "key")).alias("f"))
    firsts = firsts.select(F.coalesce("f.oid", F.lit(LAST_ID)).alias("oid"), F.coalesce("f.key", F.lit(0)).alias("key"), F.lit(True).alias("is_first"))
    placed = rows.repartition(parts, "oid", "key")
    on = ["oid", "key"]
    distinct = placed.join(firsts, on).select("oid", "key", "text")  # a semi join would move below the shared exchange
    found = _repeated_runs(_gathered(distinct, length, gram, buckets), length, array_bytes)
    by_doc = found.groupBy(*on).agg(F.collect_list(F.struct("start", "count", "kind", "hash")).alias("places"))
    runs = _with_bytes(placed.join(by_doc, on).select("oid", "key", "text", "places"), length)
    spans = _settled(runs, buckets, length, array_bytes).groupBy(*on).agg(F.collect_list(F.struct("start", "count")).alias("places"))
    joined = placed.join(firsts, on, "left").join(spans, on, "left").select("oid", "text", F.coalesce("is_first", F.lit(False)).alias("is_first"), "places")
    return _cut(joined, length).select(F.when(F.col("id") < LAST_ID, F.col("id")).alias(id_col), "n_bytes", "removed", "kept")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT doc_id, i AS s, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS x
  FROM d, unnest(range(greatest(len(h) // 2 - 99, 0))) u(i)
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM g) WHERE k > 1
), b AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER w + 100, TRUE) AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS e
  FROM (SELECT doc_id, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM b) GROUP BY doc_id, n
), cuts AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), gone AS (
  SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last_end,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last_end, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def brute_force(texts: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The rule, place by place; for tests."""
    first: dict[bytes, tuple[int, int]] = {}
    data = sorted((i, (t or "").encode()) for i, t in texts)
    for i, b in data:
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (i, s))
    out = {}
    for i, b in data:
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] != (i, s):
                hit[s : s + length] = b"\1" * length
        n_spans = sum(hit[k] and not (k and hit[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(hit), n_spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest())
    return out
