"""Problem 8: the whole corpus as token ids of a public byte-level BPE.

Merges are scheduled by a rank queue: one bucket of linked-list positions per merge rank and a hierarchical bitmap of the
ranks whose bucket is not empty. Find-first-set gives the next rank; entries whose pair was merged away meanwhile are
stale and skipped. A pre-token of n bytes takes O(n) queue steps whatever its length; short pre-tokens repeat, and their
ids are kept in a bounded table per worker.

Defined results: null and empty texts give an empty list; strings that spell special tokens are ordinary text; lone
surrogates cannot occur in a Spark string; rows with a null id keep it; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("LEXWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT, KEPT_BYTES = 100_000, 64


class RankQueue:
    """Positions by merge rank; ``pop`` gives the least rank and its positions. Three levels of 64-bit words cover 262,144 ranks."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self):
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        w, m = rank >> 6, rank >> 12
        self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
        self.mid[m] = self.mid.get(m, 0) | 1 << (w & 63)
        self.top |= 1 << m

    def pop(self) -> tuple[int, list[int]]:
        m = (self.top & -self.top).bit_length() - 1
        word = self.mid[m]
        w = m << 6 | (word & -word).bit_length() - 1
        low = self.low[w]
        rank = w << 6 | (low & -low).bit_length() - 1
        low &= low - 1
        self.low[w] = low
        if not low:
            word &= word - 1
            self.mid[m] = word
            if not word:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Ids of texts by ranked byte-pair merges."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                queue.push(r, i)
        while queue.top:
            rank, positions = queue.pop()
            positions.sort()
            for i in positions:
                a = part[i]
                j = right[i]
                if a is None or j >= n:
                    continue
                both = a + part[j]
                if ranks.get(both) != rank:
                    continue  # stale
                part[i], part[j] = both, None
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                    r = ranks.get(both + part[k])
                    if r is not None:
                        queue.push(r, i)
                h = left[i]
                if h >= 0:
                    r = ranks.get(part[h] + both)
                    if r is not None:
                        queue.push(r, h)
        return tuple(ranks[p] for p in part if p is not None)

    def encode(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for word in self.split(text):
            ids = kept.get(word)
            if ids is None:
                raw = word.encode("utf-8", "replace")
                ids = self.merge(raw)
                if len(raw) <= KEPT_BYTES:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[word] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _path(folder: str, name: str) -> str:
    return os.path.join(folder, name)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: every row's text as token ids. Nothing is shuffled."""
    path = _path(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, ends = [], [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat += bpe.encode(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``: the texts that the ids stand for; no ids are the empty text."""
    path = _path(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: piece for piece, i in encoder(path).ranks.items()}
        for batch in batches:
            texts = [b"".join(pieces[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``; null and empty texts have none."""
    path = _path(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts = [len(bpe.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["doc_id", "n_tokens"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens int")
