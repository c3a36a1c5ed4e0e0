"""Problem 7: token ids of every document by a public byte-level BPE vocabulary, by a pair occurrence index.

The pieces of all texts of an Arrow batch are cut by the vocabulary's pattern; pieces not met before are laid out as one
sequence of byte tokens. An index maps each adjacent pair to all its positions. The pairs' ranks are applied in ascending
order: a rank is merged at all its positions at once, left to right, and the lists of the pairs beside it are updated. Pieces
do not touch each other, so this equals merging each alone, at a cost that follows the number of merges, also for pieces
without any break.

Defined cases: NULL and empty text have an empty list of ids; text that looks like a special token is ordinary text; a very
long text is encoded whole; repeated rows are encoded alike; further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import spread

#: Where the public vocabularies lie, and the vocabulary of the registered queries.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pieces for this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary is shipped to the workers, so its size is bounded.
MAX_BYTES = 64 << 20
#: Pieces remembered by a worker; beyond that it starts anew, with the same results.
REMEMBERED = 400_000


def load(path: str) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    return raw


class Encoder:
    def __init__(self, raw: bytes):
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.cut = regex.compile(PATTERN).findall
        self.start = [self.rank[bytes([b])] for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], int | None] = {}

    def _rank_of(self, pair: tuple[int, int]) -> int | None:
        if pair not in self.pairs:
            self.pairs[pair] = self.rank.get(self.bytes[pair[0]] + self.bytes[pair[1]])
        return self.pairs[pair]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not known yet, all together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.pairs.clear()
        words: list[str] = []
        token: list[int] = []
        begin: list[int] = []
        for p in pieces:
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.known[p] = (whole,)
                continue
            words.append(p)
            begin.append(len(token))
            token.extend(self.start[b] for b in raw)
            token.append(-1)  # pieces do not touch
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(len(token) - 1):
            if token[i] >= 0 and token[i + 1] >= 0:
                index.setdefault((token[i], token[i + 1]), []).append(i)
        active = [(r, pair) for pair in index if (r := self._rank_of(pair)) is not None]
        heapq.heapify(active)
        while active:
            new, pair = heapq.heappop(active)
            positions = index.pop(pair, None)
            if not positions:
                continue
            positions.sort()
            left, right = pair
            for i in positions:
                j = after[i]
                if token[i] != left or j >= len(token) or token[j] != right:
                    continue  # a merge before took part of it
                token[i], token[j] = new, -2
                k = after[i] = after[j]
                if k < len(token):
                    before[k] = i
                    if token[k] >= 0:
                        self._add(index, active, (new, token[k]), i)
                h = before[i]
                if h >= 0 and token[h] >= 0:
                    self._add(index, active, (token[h], new), h)
        for w, i in zip(words, begin):
            ids = []
            while token[i] != -1:
                ids.append(token[i])
                i = after[i]
            self.known[w] = tuple(ids)

    def _add(self, index: dict, active: list, pair: tuple[int, int], at: int) -> None:
        r = self._rank_of(pair)
        if r is None:
            return
        if pair not in index:
            index[pair] = []
            heapq.heappush(active, (r, pair))
        index[pair].append(at)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn({p for pieces in cut for p in pieces} - self.known.keys())
        if not all(p in self.known for pieces in cut for p in pieces):  # the memory was cleared in between
            self.learn({p for pieces in cut for p in pieces} - self.known.keys())
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in cut]


_encoders: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    """One per worker process, kept between its tasks."""
    key = hash(raw)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw)
    return _encoders[key]


#: Texts encoded at a time by a worker.
SLICE = 512


def encode(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every document."""
    raw = documents.sparkSession.sparkContext.broadcast(load(f"{folder}/{vocabulary}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(raw.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                b = batch.slice(k, SLICE)
                ids = e.encode(b.column("text").to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(bytes_of: dict[int, bytes], ids: list[int]) -> str:
    return b"".join(bytes_of[i] for i in ids).decode()


def decode(encoded: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the way back; an id that the vocabulary lacks is an error."""
    raw = encoded.sparkSession.sparkContext.broadcast(load(f"{folder}/{vocabulary}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(raw.value)
        for b in batches:
            texts = [None if ids is None else decode_ids(e.bytes, ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def sizes(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of ``text``."""
    raw = documents.sparkSession.sparkContext.broadcast(load(f"{folder}/{vocabulary}"))
    out = documents.select(*keep).schema.add("tokens", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(raw.value)
        for batch in batches:
            text = batch.column("text")
            counts = [len(x) for k in range(0, batch.num_rows, SLICE) for x in e.encode(text.slice(k, SLICE).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int32())], [*keep, "tokens"])

    return spread(documents.select(*keep, "text")).mapInArrow(run, out)
