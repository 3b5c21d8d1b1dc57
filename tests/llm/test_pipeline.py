"""The pipeline's stages, one after the other, against what each must do."""

import hashlib
import itertools
import re

import corpus_pipeline
from gridloom.llm import bpe

from ..conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, good, single, clean, private = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in start) - sum(labels.get(i) == 1 for i in good) <= 1
    # with this few labels only part of the bad texts can be told apart; see test_quality_rejects_bad_texts for a larger sample
    bad = [i for i in start if labels.get(i) == 0]
    assert sum(i in good for i in bad) < len(bad)
    shingles = {}
    for i, t in good.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    alike = lambda a, b: 100 * (n := len(shingles[a] & shingles[b])) >= 80 * (len(shingles[a]) + len(shingles[b]) - n)
    assert not any(alike(a, b) for a, b in itertools.combinations(single, 2))
    assert all(any(alike(i, j) for j in good if j != i) for i in set(good) - set(single))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in single.items() if any(x in t for x in items)}
    assert leaks and leaks <= set(single) - set(clean) and len(set(single) - set(clean)) <= len(leaks) + 1
    entity = re.compile(r"[\w.+-]+@[\w-]+\.\w+|(?<!\d)\d{16}(?!\d)|\d+\.\d+\.\d+\.\d+|\+1 \(\d+\) [\d-]+|\b[0-9a-f]{40}\b")
    for i, t in clean.items():
        found = entity.findall(t)
        assert (private[i] == t) if not found else not any(e in private[i] for e in found)
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    for r in rows:
        ids = enc.encode_ordinary(private[r["doc_id"]])
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(private[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() == 0
