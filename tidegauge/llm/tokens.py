"""Encoding of texts by a public byte-level BPE vocabulary, in numpy matrices."""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegauge.session import spread

#: Folder of the public vocabularies; a parameter of every caller.
TOKENIZERS = os.environ.get("TIDEGAUGE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the vocabulary's public description splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of more bytes than this leave the matrices and are merged one by one, with the same result.
LONGEST_ROW = 512
#: Distinct pieces that a worker remembers.
REMEMBERED = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Ids of the single bytes, and for each pair of ids that merges its merged id, which is its rank too."""

    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    slots: np.ndarray = field(init=False)
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        """An open-addressing table of the pairs, filled in rounds."""
        self.bits = max(4, int(len(self.keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        at, left = self._hash(self.keys), np.arange(len(self.keys))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            at, left = (at[~placed] + 1) & (len(self.slots) - 1), left[~placed]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it doesn't merge; a negative id is padding."""
        keys = (left.astype(np.int64) << 20) | right
        out = np.full(keys.shape, _NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, result = keys.ravel(), out.ravel()
        at = self._hash(flat[todo])
        while len(todo):
            slot = self.slots[at]
            used = slot >= 0
            hit = used.copy()
            hit[used] = self.keys[slot[used]] == flat[todo[used]]
            result[todo[hit]] = self.merged[slot[hit]]
            go = used & ~hit
            todo, at = todo[go], (at[go] + 1) & (len(self.slots) - 1)
        return result.reshape(keys.shape)


def load_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
    """From a file of base64 tokens and ranks: every split of a token into two tokens is a pair that merges to it."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                keys.append((a << 20) | b)
                merged.append(rank)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Vocabulary(byte_ids, np.array(keys, np.int64), np.array(merged, np.int32))


def merge_rows(vocabulary: Vocabulary, rows: list[bytes]) -> list[np.ndarray]:
    """Ids of rows of about one length.

    All rows stand in one padded matrix. Each round every row merges its leftmost
    pair of least rank and closes the hole; rows without a pair leave the matrix.
    """
    lengths = np.array([len(r) for r in rows])
    width = int(lengths.max())
    ids = np.full((len(rows), width), -1, np.int32)
    ids[np.arange(width) < lengths[:, None]] = vocabulary.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
    out: list = [None] * len(rows)
    names = np.arange(len(rows))
    ranks = vocabulary.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 0), _NONE, np.int32)
    while True:
        if ranks.shape[1]:
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ranks)), best]
        else:
            least = best = np.full(len(ids), _NONE)
        done = least == _NONE
        for i in np.flatnonzero(done):
            row = ids[i]
            out[names[i]] = row[row >= 0].copy()
        if done.all():
            return out
        go = ~done
        ids, ranks, names, lengths = ids[go], ranks[go], names[go], lengths[go] - 1
        best, least = best[go], least[go]
        n, width = np.arange(len(ids)), int(lengths.max())
        # Columns after the merged pair move one to the left.
        source = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
        ids = np.where(np.arange(width) < lengths[:, None], np.take_along_axis(ids, np.minimum(source, ids.shape[1] - 1), axis=1), -1)
        ids[n, best] = least
        shifted = np.take_along_axis(ranks, np.minimum(source[:, : width - 1], ranks.shape[1] - 1), axis=1)
        ranks = np.where(np.arange(width - 1) < lengths[:, None] - 1, shifted, _NONE)
        for step in (-1, 0):
            at = best + step
            inside = (at >= 0) & (at + 1 < lengths)
            if inside.any():
                r, c = n[inside], at[inside]
                ranks[r, c] = vocabulary.ranks(ids[r, c], ids[r, c + 1])


def merge_long(vocabulary: Vocabulary, row: bytes) -> np.ndarray:
    """Ids of one very long piece: the same merges by a queue of pairs over a linked list."""
    ids = vocabulary.byte_ids[np.frombuffer(row, np.uint8)].tolist()
    n = len(ids)
    first = vocabulary.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(int(r), i) for i, r in enumerate(first) if r != _NONE]
    heapq.heapify(queue)
    known: dict[tuple[int, int], int] = {}

    def rank(i: int, j: int) -> int:
        pair = (ids[i], ids[j])
        if pair not in known:
            known[pair] = int(vocabulary.ranks(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
        return known[pair]

    while queue:
        r, i = heapq.heappop(queue)
        if ids[i] < 0 or after[i] >= n or rank(i, after[i]) != r:
            continue
        j = after[i]
        ids[i], ids[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(i, after[i])) != _NONE:
                heapq.heappush(queue, (x, i))
        if before[i] >= 0 and (x := rank(before[i], i)) != _NONE:
            heapq.heappush(queue, (x, before[i]))
    return np.array([t for t in ids if t >= 0], np.int32)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes], cells: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each piece, bucketed by length; a matrix has so many cells at most."""
    out: list = [None] * len(pieces)
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(lengths, kind="stable")
    short = order[lengths[order] <= LONGEST_ROW]
    for i in order[len(short):]:
        out[i] = merge_long(vocabulary, pieces[i])
    start = 0
    while start < len(short):
        top = max(8, 1 << int(lengths[short[start]] - 1).bit_length()) if lengths[short[start]] > 0 else 8
        stop = min(int(np.searchsorted(lengths[short], top, side="right")), start + max(1, cells // top))
        chosen = short[start:stop]
        for i, ids in zip(chosen, merge_rows(vocabulary, [pieces[i] for i in chosen])):
            out[i] = ids
        start = stop
    return out


class Encoder:
    """Encodes lists of texts, remembering the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        ids = encode_pieces(self.vocabulary, [p.encode("utf-8") for p in pieces])
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        for p in pieces:
            self.known[p] = len(self.known)
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; a null or empty text has none."""
        if len(self.known) > REMEMBERED:
            self._clear()
        parts = [self.split(t) if t else [] for t in texts]
        fresh = {p for part in parts for p in part} - self.known.keys()
        if fresh:
            self._learn(list(fresh))
        known = self.known
        index = np.array([known[p] for part in parts for p in part], np.int64)
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(total)]
        count = np.cumsum([0] + [len(p) for p in parts])
        offsets = np.concatenate([[0], ends])[count]
        return offsets, ids


_encoder: dict[int, Encoder] = {}


def encode_texts(documents: DataFrame, key: str, text: str, vocabulary: Vocabulary, batch_chars: int = 4_000_000) -> DataFrame:
    """key and ids (list of int) of every row, repeated rows and null keys too.

    Whatever a text holds is ordinary text: strings of special tokens get no ids
    of their own. A null and an empty text give an empty list. Further columns
    are ignored. Rows are encoded where they lie, unless they lie in fewer parts than there are
    cores; texts are
    taken in lots of about batch_chars characters, a longer one alone.
    """
    shared = documents.sparkSession.sparkContext.broadcast(
        (vocabulary.byte_ids, vocabulary.keys, vocabulary.merged)
    )

    mark = zlib.crc32(vocabulary.keys.tobytes())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder.get(mark)
        if encoder is None:
            _encoder.clear()
            encoder = _encoder[mark] = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, held = 0, 0
            for i, t in enumerate([*texts, None]):
                held += len(t) if t else 0
                if i == len(texts) or held > batch_chars and i > start:
                    offsets, ids = encoder.encode(texts[start:i])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), lists], ["key", "ids"])
                    start, held = i, len(t) if t else 0

    slim = spread(documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text")))
    kind = dict(slim.dtypes)["key"]
    return slim.mapInArrow(encoded, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
