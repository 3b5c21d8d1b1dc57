"""Byte-level BPE: encode and decode by a local rank file.

The merges are tiktoken's; Spark spreads the texts.  A text longer than
``piece_chars`` is cut at safe places first: before a single space that stands
between two characters that are not white space.  The pre-split pattern always
starts a match there, so the ids of the pieces, one after the other, are the
ids of the text, and no call has to hold a very long text at once.

Long runs of white space are taken out before that, as the pattern's last two
alternatives (``\\s+(?!\\S)|\\s+``) backtrack over the whole run.  The rule they
state is applied instead: a run is one match, without its last character if a
character follows that is not white space.  Both ends of the match are safe
places, and the match is merged by itself.

Defined results: a null or empty text gives no ids and empty bytes; a null id
is kept; repeated rows give repeated results; further input columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import sliced, table, without

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: the White_Space property of Unicode, which the pattern's ``\s`` stands for (fixed values)
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WHITE = re.compile(f"[{WHITE}]{{4096,}}")
#: a pattern under which any text is one match
ONE_MATCH = r"[\s\S]+"


@lru_cache(maxsize=2)
def encoding(rank_path: str, pattern: str):
    """The encoder of a rank file, once per Python worker."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece_chars: int) -> Iterator[str]:
    """Cut a long text at safe places, about every ``piece_chars`` characters."""
    at = 0
    while len(text) - at > piece_chars:
        m = SAFE.search(text, at + piece_chars)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str | None, piece_chars: int) -> list[int]:
    if not text:
        return []
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in LONG_WHITE.finditer(text):
        ids += _encode_pieces(enc, text[at : run.start()], piece_chars)
        at = run.end() - (run.end() < len(text))
        ids += _one_match(enc).encode_ordinary(text[run.start() : at])
    return ids + _encode_pieces(enc, text[at:], piece_chars)


def _encode_pieces(enc, text: str, piece_chars: int) -> list[int]:
    return [i for part in pieces(text, piece_chars) for i in enc.encode_ordinary(part)]


@lru_cache(maxsize=4)
def _one_match(enc):
    """The same ranks with a pattern under which a text is one match."""
    import tiktoken

    ranks = {enc.decode_single_token_bytes(i): i for i in range(enc.n_vocab)}
    return tiktoken.Encoding("one", pat_str=ONE_MATCH, mergeable_ranks=ranks, special_tokens={})


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, piece_chars: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded binary`` for every row; ``decoded`` is made from ``ids`` alone."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for part in sliced(batch, 4 << 20):
                ids = [np.asarray(encode_text(enc, t, piece_chars), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                back = [enc.decode_bytes(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.binary())],
                    ["id", "ids", "decoded"],
                )

    return without(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(coded)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
