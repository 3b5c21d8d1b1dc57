"""Periodic runs, chat formatting and vector codes against brute force and on odd input."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, codes, periodic

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CHATS = "conv_id long, turn long, role string, text string"


# ---- periodic runs


def runs_brute(words, min_length, times):
    """All distances, place by place; the smallest one of each stretch counts."""
    found, n = {}, len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(min_length, times * q):
                found.setdefault((s, i - s + q), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "times"), [(6, 4), (2, 2), (5, 3)])
def test_runs_against_brute_force(min_length, times):
    rng = random.Random(min_length)
    for _ in range(400):
        kinds = rng.randint(1, 3)
        x = [rng.randint(0, kinds) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5:
            x = x[:5] + x[: rng.randint(1, 6)] * rng.randint(2, 12) + x[5:]
        got = periodic.find_runs(np.array(x, np.int64), min_length, times).tolist()
        assert [tuple(r) for r in got] == runs_brute(x, min_length, times)


def test_runs_of_long_sequences():
    assert periodic.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    assert periodic.find_runs(np.arange(100_000) % 777).tolist() == [[0, 100_000, 777]]
    # one phrase ten thousand times, never near itself: many members and classes, no run
    x = np.arange(120_000) + 10
    for j in range(8):
        x[j::12] = j
    assert not len(periodic.find_runs(x))


def test_periodic_runs_operator(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", " \t\n\x0b\f\r ", "x", "a b " * 9, "é  \n" * 7, "  go on  " * 3000, texts[0], texts[0]]
    rows = [(k, t, None, 1, "r") for k, t in enumerate(texts)] + [(None, "b b b b b b b c", None, 1, "r"), (3, texts[3], None, 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int, runs string")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(df).collect()]
    want = []
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        runs = runs_brute(words, 6, 4) if len(words) < 5000 else [(0, 6000, 2)]
        gone = {w for s, length, q in runs for w in range(s + q, s + length)}
        want.append((i, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, times=1)


def test_planted_period(spark):
    import zlib

    df = spark.createDataFrame([(k, " w%d ".join(str(x) for x in range(k % 23)) % tuple(range(max(k % 23 - 1, 0))) if k % 23 else None) for k in range(300)], "doc_id long, text string")
    changed = 0
    for r in df.select("doc_id", "text", periodic.planted().alias("new")).collect():
        h, words = zlib.crc32(str(r["doc_id"]).encode()), (r["text"] or "").split()
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert (r["new"] or "").split() == words
    assert changed > 10


# ---- chat formatting


def chats_brute(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (
            len(turns),
            digest("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            digest("".join(t for r, t in turns if r == "assistant")),
            sum(len(chat.escape_role(r)) + len(chat.escape(t)) + 24 for r, t in turns),
        )
        for conv, turns in out.items()
    }


def test_escapes_are_reversible():
    rng = random.Random(2)
    bits = ["<", "|", "\\", ">", "im_end", "im_start", "<|im_end|>", "<\\|im_start|>", "\n", "n", "a"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert not any(m in chat.escape(t) for m in ("<|im_end|>", "<|im_start|>"))
        assert "\n" not in chat.escape_role(t)


@pytest.mark.parametrize("piece_bytes", [1 << 20, 200])
def test_chat_round_trip(spark, piece_bytes):
    rng = random.Random(7)
    texts = [None, "", "ok", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "ünï\n\n", "日本 \U0001f600", "word " * 300]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb<|im_end|>\\"]), rng.choice(texts)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"hot {t}") for t in range(800)]  # most rows are one conversation
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "there"), (50, None, "user", "first"), (50, 0, "assistant", "second")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], CHATS + ", ids string, part int").repartition(5)
    chats = chat.format_chats(df, PATH, PATTERN, piece_bytes)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.read_back(chats, PATH, PATTERN).collect()}
    assert got == chats_brute(rows)
    enc = bpe.encoding(PATH, PATTERN)
    for r in chats.collect():
        plain = b"".join({enc.n_vocab: b"<|im_start|>", enc.n_vocab + 1: b"<|im_end|>"}.get(i) or enc.decode_bytes([i]) for i in r["ids"])
        assert plain.decode() == r["formatted"] and len(r["ids"]) == len(r["loss"])


def test_chat_ties_and_empty(spark):
    same = spark.createDataFrame([(1, 0, "assistant", "x")] * 500 + [(1, 0, "user", "y")] * 2, CHATS).repartition(4)
    row = chat.read_back(chat.format_chats(same, PATH, PATTERN, 100), PATH, PATTERN).collect()
    assert len(row) == 1 and row[0]["n_turns"] == 502 and row[0]["loss_chars"] == 500
    assert chat.read_back(chat.format_chats(same.limit(0), PATH, PATTERN), PATH, PATTERN).collect() == []


def test_chat_very_long_text(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "long text. " * 400_000)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHATS), PATH, PATTERN), PATH, PATTERN).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"], got["formatted_chars"]) == chats_brute(rows)[1]


# ---- vector codes


def codes_brute(rows, parts, entries, rounds):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows]
    width = len(kept[0][1]) // parts
    seeds = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))[:entries]]
    cut = lambda v, p: [int(x) for x in v[p * width : (p + 1) * width]]
    books = [[cut(s, p) for s in seeds] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(seeds)):
                mine = [cut(v, p) for (_, v), g in zip(kept, got) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return [([k for _, k in g], sum(d for d, _ in g)) for g in assign()], books


@pytest.mark.parametrize("rounds", [2, 5])
def test_codes_against_brute_force(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8).round(1)]) for k in range(150)]
    rows += [(150 + k, rows[k][1]) for k in range(20)] + [(3, rows[9][1]), (None, rows[4][1])]  # copies, ties, repeated and null ids
    bad = [(7, None), (8, [1.0, None] * 4), (9, [float("nan")] * 8), (-5, [float("inf")] * 8), (-1, []), (500, [1.0] * 16), (501, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, label int, `odd name` string").repartition(3)
    coded, history = codes.compress(df, parts=4, entries=10, rounds=rounds)
    want, books = codes_brute(rows, 4, 10, rounds)
    assert history[-1].astype(int).tolist() == books and len(history) == rounds + 1
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded.collect())
    assert got == sorted((str(i), c, e) for (i, _), (c, e) in zip(rows, want))


def test_bounds_leave_parts_out_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (16, 4))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 4))).astype(float)
    history, state = [x[:16].copy()], (None, None, None)
    for _ in range(6):
        code, own, bound, stamp = codes.nearest(x, history, *state)
        d = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (d.argmin(1) == code).all() and (d.min(1) == own).all()
        state, book = (code, bound, stamp), history[-1].copy()
        for k in np.unique(code):
            book[k] = np.floor(x[code == k].sum(0) / (code == k).sum())
        history.append(book)
    assert (stamp < len(history) - 2).mean() > 0.5  # most were last compared with all entries in an earlier round


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<double>, label string"
    none = spark.createDataFrame([(1, None, "a")], schema)
    coded, history = codes.compress(none)
    assert coded.collect() == [] and history == [] and codes.with_label_errors(coded).collect() == []
    few = spark.createDataFrame([(2, [0.5] * 16, None), (1, [0.25] * 16, None), (3, [0.5] * 16, "b")], schema)
    rows = codes.with_label_errors(codes.compress(few)[0]).orderBy("vec_id").collect()
    assert [r["code"][0] for r in rows] == [0, 1, 1] and [r["label_error"] for r in rows] == [0, 0, 0]
    with pytest.raises(ValueError):
        codes.compress(few.withColumnRenamed("label", "Stamp"))
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, "a")], schema))[0].collect()
    book = np.arange(8).reshape(2, 2, 2)
    assert codes.codebook_digest(book) == hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()


def test_label_errors_keep_null_labels(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", 1)], "vec_id long, label string, error long")
    for bound in (200_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(codes, "BROADCAST_LABELS", bound)
            got = codes.with_label_errors(df).select(F.struct("vec_id", "label_error")).collect()
        assert sorted(tuple(r[0]) for r in got) == [(1, 11), (2, 11), (3, 1)]
