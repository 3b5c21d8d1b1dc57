"""Language identification of words and texts by a linear-chain conditional random field.

Every word gets a score per language: weights of its character n-grams (one to
four bytes of the padded, lower-cased word, so those at its borders are its
affixes) and of the word itself if the lexicon of the training words has it.
Learned transition weights connect neighbouring words, which lets a text switch
between languages.  Forward-backward gives the posterior of every word's
language; a text gets the language with the largest mean posterior.

The field is fitted on a bounded sample: of every language ``per_label`` texts
among those of at most ``train_bytes`` bytes, in the order of a hash of the id.  The
training sequences are stretches of one text and stretches put together from
texts of different languages.  Prediction reads whole texts and nothing else.

Defined results: a null text and one without letters is ``und`` with score 0;
without any labelled text everything is ``und``; a very long text is read whole,
in one batch of its own; a language without a usable text is not learned; a null id is kept and counts
as held out; repeated rows give repeated results; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import U64, Words, byte_set, map_batches, mix, table, without

LETTER_BYTES = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SAME = np.arange(256, dtype=np.uint8)
GRAM_BITS, LEXICON_BITS, CHAIN, OVERLAP = 16, 16, 64, 16
UNKNOWN = "und"


@dataclass
class Field:
    """Weights: one row per feature, one column per language."""

    labels: list[str]
    grams: np.ndarray  # [4 * 2^GRAM_BITS, K]
    lexicon: np.ndarray  # [2^LEXICON_BITS, K]
    known: np.ndarray  # 32-bit fingerprints of the lexicon's words, 0 for none
    step: np.ndarray  # [K, K] transitions
    start: np.ndarray  # [K]


class Scan:
    """Words of some texts and the features of their letters."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lower, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        self.words = w = Words(spaced, LETTER_BYTES, SAME)
        self.text = np.where(LETTER_BYTES[w.raw], w.raw, 32).astype(np.uint32)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature number of the n-gram at every place, and whether it lies in one padded word."""
        t = self.text
        far = [np.concatenate((t[j:], np.full(min(j, len(t)), 32, np.uint32)))[: len(t)] for j in range(n)]
        code = np.zeros(len(t), np.uint32)
        for x in far:
            code = (code << np.uint32(8)) | x
        inside = far[0] != 32 if n == 1 else np.ones(len(t), bool)
        for x in far[1:-1]:
            inside &= x != 32
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        return slot.astype(np.int64) + ((n - 1) << GRAM_BITS), inside


def lexicon_slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & U64((1 << LEXICON_BITS) - 1)).astype(np.int64), (hashes >> U64(32)).astype(np.uint32) | np.uint32(1)


def emissions(scan: Scan, field: Field) -> np.ndarray:
    """Score per word and language."""
    w = scan.words
    if not len(w.start):
        return np.zeros((0, len(field.labels)))
    sums = np.zeros((len(scan.text) + 1, len(field.labels)))
    for n in (1, 2, 3, 4):
        slot, inside = scan.grams(n)
        sums[1:] += field.grams[slot] * inside[:, None]
    np.cumsum(sums, axis=0, out=sums)
    out = sums[w.end] - sums[w.start - 1]  # n-grams that start at the space before the word or at one of its letters
    slot, mark = lexicon_slots(w.hashes())
    return out + field.lexicon[slot] * (field.known[slot] == mark)[:, None]


def posteriors(score: np.ndarray, lengths: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains [chains, CHAIN, K]: word posteriors and summed pair posteriors."""
    n, most, k = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    step, start = np.exp(field.step - field.step.max()), np.exp(field.start - field.start.max())
    ahead, back = np.zeros((n, most, k)), np.ones((n, most, k))
    live = np.arange(most)[None, :] < lengths[:, None]
    a = start * e[:, 0]
    ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, most):
        a = (ahead[:, t - 1] @ step) * e[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        b = (back[:, t + 1] * e[:, t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        back[:, t] = np.where(live[:, t + 1][:, None], b, 1.0)
    post = ahead * back
    post /= post.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(1, most):
        m = ahead[:, t - 1][:, :, None] * step * (e[:, t] * back[:, t])[:, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
        pairs += m[live[:, t]].sum(axis=0)
    return post, pairs


def fit(texts: list[str], langs: list[str], epochs: int = 3, rate: float = 0.2, seed: int = 7) -> Field:
    """Fit by AdaGrad on the log-likelihood of word labels."""
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    scan = Scan(pa.array(texts, pa.string()))
    w = scan.words
    gold_row = np.array([labels.index(x) for x in langs], np.int64)
    field = Field(labels, np.zeros((4 << GRAM_BITS, k)), np.zeros((1 << LEXICON_BITS, k)), np.zeros(1 << LEXICON_BITS, np.uint32), np.zeros((k, k)), np.zeros(k))
    slot, mark = lexicon_slots(w.hashes())
    field.known[slot] = mark
    known = field.known[slot] == mark
    gold = gold_row[w.row]
    slots = [scan.grams(n) for n in (1, 2, 3, 4)]
    # training chains: stretches of one text, and as many put together from several texts
    order = np.arange(len(w.start))
    chains = [order[i : i + CHAIN] for s, n in zip(w.row_start, w.per_row) for i in range(s, s + n, CHAIN)]
    bits = [c[i : i + 12] for c in chains for i in range(0, len(c), 12)]
    rng.shuffle(bits)
    chains += [np.concatenate(bits[i : i + 5]) for i in range(0, len(bits), 5)]
    used = {name: np.full_like(getattr(field, name), 1e-6) for name in ("grams", "lexicon", "step", "start")}

    def move(name: str, at: np.ndarray | slice, grad: np.ndarray) -> None:
        used[name][at] += grad**2
        getattr(field, name)[at] += rate * grad / np.sqrt(used[name][at])

    for _ in range(epochs):
        rng.shuffle(chains)
        for i in range(0, len(chains), 128):
            part = chains[i : i + 128]
            words = np.concatenate(part)
            lengths = np.array([len(c) for c in part])
            chain = np.repeat(np.arange(len(part)), lengths)
            place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # letters of these words, with the space before each
            size = w.end[words] - w.start[words] + 1
            owner = np.repeat(np.arange(len(words)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + w.start[words][owner] - 1
            active = [(s[at][ok[at]], owner[ok[at]]) for s, ok in slots]
            ids, own = np.concatenate([x for x, _ in active]), np.concatenate([x for _, x in active])
            e = np.stack([np.bincount(own, field.grams[ids, j], len(words)) for j in range(k)], axis=1)
            e += field.lexicon[slot[words]] * known[words][:, None]
            score = np.zeros((len(part), CHAIN, k))
            score[chain, place] = e
            post, pairs = posteriors(score, lengths, field)
            truth = np.eye(k)[gold[words]]
            grad = (truth - post[chain, place]) / len(part)
            rows, inverse = np.unique(ids, return_inverse=True)
            move("grams", rows, np.stack([np.bincount(inverse, grad[own, j], len(rows)) for j in range(k)], axis=1))
            rows, inverse = np.unique(slot[words], return_inverse=True)
            move("lexicon", rows, np.stack([np.bincount(inverse, grad[:, j], len(rows)) for j in range(k)], axis=1))
            inner = np.flatnonzero(place > 0)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[words[inner - 1]], gold[words[inner]]), 1)
            move("step", slice(None), (seen - pairs) / len(part))
            move("start", slice(None), grad[place == 0].sum(axis=0))
    field.grams, field.lexicon = field.grams.astype(np.float32), field.lexicon.astype(np.float32)
    return field


def word_posteriors(scan: Scan, field: Field) -> np.ndarray:
    """Posterior of every word's language.

    A text is read in chains of ``CHAIN`` words.  Every chain also reads
    ``OVERLAP`` words of the text on either side, so messages pass the cuts; what
    they carry from farther away fades with every step.
    """
    w, k = scan.words, len(field.labels)
    if not len(w.start):
        return np.zeros((0, k))
    most = CHAIN + 2 * OVERLAP
    place = np.arange(len(w.start)) - w.row_start[w.row]
    fresh = place % CHAIN == 0
    first = np.flatnonzero(fresh)
    begin = np.maximum(first - OVERLAP, w.row_start[w.row[first]])
    lengths = np.minimum(first + CHAIN + OVERLAP, w.row_start[w.row[first]] + w.per_row[w.row[first]]) - begin
    live = np.arange(most)[None, :] < lengths[:, None]
    score = np.zeros((len(first), most, k))
    score[live] = emissions(scan, field)[(begin[:, None] + np.arange(most))[live]]
    # posteriors only: the pair sums are for training
    e = np.exp(score - score.max(axis=2, keepdims=True))
    step, start = np.exp(field.step - field.step.max()), np.exp(field.start - field.start.max())
    ahead = np.zeros_like(e)
    a = np.where((begin == w.row_start[w.row[first]])[:, None], start, 1.0) * e[:, 0]
    ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, most):
        a = (ahead[:, t - 1] @ step) * e[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((len(lengths), k))
    for t in range(most - 1, -1, -1):
        here = ahead[:, t] * back
        ahead[:, t] = here / here.sum(axis=1, keepdims=True)
        b = (back * e[:, t]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        back = np.where((t < lengths)[:, None], b, 1.0)
    chain = np.cumsum(fresh) - 1
    return ahead[chain, place % CHAIN + (first - begin)[chain]]


def sample(docs: DataFrame, per_label: int = 250, train_bytes: int = 16384) -> tuple[list[str], list[str]]:
    """Bounded training sample of ``id, text, lang`` rows: ``per_label`` usable texts of every language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= train_bytes))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # a limit below the window keeps per_label ids of a task; texts of these are read afterwards
    chosen = usable.select("lang", "id").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_label)
    rows = usable.join(F.broadcast(chosen.drop("_n")), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text")).orderBy("id", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, field: Field | None, with_words: bool = False) -> DataFrame:
    """``id, lang, score`` of ``id, text`` rows; with words also their languages and posteriors in order."""
    words_type = ", words array<struct<word: string, lang: string, p: double>>" if with_words else ""
    schema = f"id {dict(docs.dtypes)['id']}, lang string, score double" + words_type
    shared = docs.sparkSession.sparkContext.broadcast(field)
    struct = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        field, texts = shared.value, batch.column(1)
        langs, scores, words = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
        if field is not None:
            scan = Scan(texts)
            w, post = scan.words, word_posteriors(scan, field)
            sums = np.zeros((len(post) + 1, len(field.labels)))
            np.cumsum(post, axis=0, out=sums[1:])
            sums = sums[w.row_start[1:]] - sums[w.row_start[:-1]]
            best = sums.argmax(axis=1)
            scores = np.clip(sums[np.arange(len(best)), best] / np.maximum(w.per_row, 1), 0.0, 1.0)
            letters = pc.match_substring_regex(texts.fill_null(""), r"\pL").to_pylist()
            langs = [field.labels[b] if n and has else UNKNOWN for b, n, has in zip(best, w.per_row, letters)]
            scores[[x == UNKNOWN for x in langs]] = 0.0
            if with_words:
                top = post.argmax(axis=1)
                for j in range(len(post)):
                    words[w.row[j]].append({"word": w.raw[w.start[j] : w.end[j]].tobytes().decode("utf-8", "replace"), "lang": field.labels[top[j]], "p": float(post[j, top[j]])})
        columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(words, struct)] if with_words else []), ["id", "lang", "score"] + (["words"] if with_words else []))

    return map_batches(docs, one, schema, max_bytes=1 << 19)  # a byte of text takes about a hundred of working memory


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").toDF("id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(True))
    texts, langs = sample(docs.filter(~held_out))
    found = identify(docs.select("id", "text"), fit(texts, langs) if texts else None)
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")
