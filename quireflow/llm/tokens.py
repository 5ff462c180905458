"""Encoding of texts by a public byte-level BPE vocabulary, exactly, by dynamic programming over prefixes.

For each prefix of a piece exactly one vocabulary entry is the last token of the prefix's encoding. An automaton over
all entries gives the entries that end at each place; an entry is the last token if the prefix before it is empty or
ends, in its own encoding, with a token that may stand before it. Two tokens may stand side by side if their joined
bytes encode as just these two. Following the last tokens back from the end gives the ids.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .spread import spread

VOCABULARY = os.environ.get("QUIREFLOW_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut into pieces before byte pairs are merged.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept in memory per worker, of pieces and of token pairs; beyond it the memory is emptied, results stay the same.
KEPT = 400_000


class ByteEncoder:
    """ids(text) of one vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PIECES):
        with open(path, "rb") as f:
            entries = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in entries}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.side: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for b, i in self.rank.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Parts left of short bytes after merging the pair of lowest rank, the leftmost first, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min(((rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes of two tokens is these two. With a as -1: whether b's bytes encode as b alone."""
        key = ((a + 1) << 32) | b
        got = self.side.get(key)
        if got is None:
            if len(self.side) >= KEPT:
                self.side.clear()
            x, y = b"" if a < 0 else self.bytes_of[a], self.bytes_of[b]
            got = self.side[key] = self.merged(x + y) == ([x, y] if x else [y])
        return got

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        one = self.rank.get(data)
        if one is not None and self.beside(-1, one):
            return (one,)
        n = len(data)
        last = [-1] * (n + 1)  # id of the last token of each prefix
        span = [0] * (n + 1)
        beside = self.beside
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            stop = end + 1
            if span[stop]:
                continue
            begin = stop - size
            if (begin == 0 or span[begin]) and beside(last[begin], token):
                last[stop], span[stop] = token, size
        out: list[int] = []
        at = n
        while at > 0:
            out.append(last[at])
            at -= span[at]
        out.reverse()
        return tuple(out)

    def ids(self, text: str | None) -> array:
        """Ids without special tokens; their names in a text are ordinary text. Null and empty texts give none."""
        out = array("i")
        if not text:
            return out
        known = self.known
        for p in self.find(text):
            got = known.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) < 200:
                    if len(known) >= KEPT:
                        known.clear()
                    known[p] = got
            out.extend(got)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder per worker process."""
    return ByteEncoder(path, pattern)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PIECES) -> DataFrame:
    """key and ids of each row's text; an empty list for null and empty texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = texts.slice(lo, 1000)
                flat, ends = array("i"), [0]
                for t in part:
                    flat.extend(enc.ids(t.as_py()))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype="int32")), pa.array(np.frombuffer(flat, dtype="int32")))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 1000), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(work, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PIECES) -> DataFrame:
    """keys and n_tokens, the number of ids of each row's text (0 for null and empty ones)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            n = pa.array([len(enc.ids(t.as_py())) for t in batch.column(len(keys))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], n], names=[*keys, "n_tokens"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(df.select(*keys, text)).mapInArrow(work, f"{kinds}, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
