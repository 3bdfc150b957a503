"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: forced-boundary splitting. A pair of bytes that never occurs side by side
inside any vocabulary token can never be merged across, so a text may be cut there.
The fragments are encoded independently, each distinct fragment of a batch once, and
the ids are concatenated. A cut must also leave the pre-tokenizer's pieces alone:
cuts are made only between characters that are not white space, and not before an
apostrophe (white space looks ahead, contractions look behind).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail.session import table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenizer of the byte-level vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FRAGMENT = 64  # least bytes of a fragment


class Codec:
    """The tokenizer and its table of byte pairs that may be cut; made once per Python worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pairs = self.cut_table()

    def cut_table(self) -> np.ndarray:
        """True at (a, b) if the pair occurs in no token and a cut there leaves the pieces alone."""
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.ranks:
            if len(token) > 1:
                run = np.frombuffer(token, np.uint8)
                inside[run[:-1], run[1:]] = True
        free = ~inside
        # both sides printable ASCII: never white space of any kind, never inside a character
        plain = np.zeros(256, dtype=bool)
        plain[0x21:0x7F] = True
        left, right = plain.copy(), plain.copy()
        right[ord("'")] = False
        return free & left[:, None] & right[None, :]

    def cuts(self, raw: bytes) -> list[int]:
        run = np.frombuffer(raw, np.uint8)
        if len(run) < 2 * FRAGMENT:
            return []
        places = np.flatnonzero(self.pairs[run[:-1], run[1:]]) + 1
        out, last = [], 0
        for p in places.tolist():
            if p - last >= FRAGMENT:
                out.append(p)
                last = p
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        memo: dict[str, list[int]] = {}
        out = []
        for text in texts:
            if not text:
                out.append([])
                continue
            raw = text.encode("utf-8", "replace")
            at = self.cuts(raw)
            ids: list[int] = []
            for lo, hi in zip([0, *at], [*at, len(raw)], strict=True):
                part = raw[lo:hi].decode("utf-8")
                got = memo.get(part)
                if got is None:
                    got = memo[part] = self.encoding.encode_ordinary(part)
                ids += got
            out.append(ids)
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encoded(docs: DataFrame, key: str, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """(key, out): the token ids of each row's text; null and empty texts give an empty list.

    One narrow pass without a shuffle; repeated keys are kept as they are. White
    space alone is text and is encoded. Invalid bytes are read as U+FFFD.
    """
    where = path or f"{TOKENIZERS}/{BYTE_BPE}"
    name = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                ids = codec(where).encode(_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, out])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {name}, `{out}` array<int>")


def token_counts(docs: DataFrame, keys: list[str], text: str, out: str = "tokens", path: str | None = None) -> DataFrame:
    """(*keys, out): the number of tokens of each row's text; 0 for null and empty texts."""
    where = path or f"{TOKENIZERS}/{BYTE_BPE}"
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                sizes = [len(x) for x in codec(where).encode(_texts(part.column(len(keys))))]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], pa.array(sizes, pa.int64())], [*keys, out])

    return docs.select(*keys, text).mapInArrow(run, f"{fields}, `{out}` long")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by the byte-level vocabulary, without special tokens."""
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id"), "ids")
