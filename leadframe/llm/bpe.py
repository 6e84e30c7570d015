"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

The distinct words of a block are laid out as linked symbols. An inverted index from token pair (named by the rank of
its merge) to symbol positions is popped in rank order; each merge is applied at all its positions in the block, and
only the pairs on either side of a merged position are looked up again. Words recur, so a worker remembers their ids.

Ids are those of the ranks file, each match of the split pattern encoded separately, without special tokens. Decoding
maps the ids back to bytes, which are compared by digest.

Defined cases: null and empty texts have no tokens (digest of the empty string). Any valid UTF-8 is encoded without
loss. Every input row gives one output row; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Lexicon, pieces
from .shared import gather, spans, tidy


class Ranks:
    """Tables of a rank file: lines of a token in base64 and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        token = [b""] * size
        for word, number in self.rank.items():
            token[number] = word
        self.length = np.array([len(t) for t in token], np.int64)
        self.offset = np.append(0, np.cumsum(self.length))
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        pairs = {}
        for word, number in self.rank.items():
            for cut in range(1, len(word)):
                left, right = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = number
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        # A merge of a symbol with itself may overlap with the next position; only those ranks need care.
        self.doubled = {n for k, n in pairs.items() if k >> 32 == k & 0xFFFFFFFF}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 if there is none."""
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.offset[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]

    def replay(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word boundaries in them) of the words data[edge[i]:edge[i+1]], none of them empty."""
        n = len(data)
        symbol = np.append(self.byte[data], -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[edge[1:] - 1] = n  # the place n stands for no neighbour
        before[edge[:-1]] = n
        before = np.append(before, n)
        rank = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.pair_rank(symbol[inner], symbol[inner + 1])

        found = inner[rank[inner] >= 0]
        found = found[np.argsort(rank[found], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[found])) + 1
        first = {int(rank[places[0]]): places for places in np.split(found, cuts)} if len(found) else {}
        later: dict[int, list[int]] = {}
        heap = list(first)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places, more = first.pop(r, None), later.pop(r, None)
            if more:
                more = np.array(sorted(set(more)))
                places = more if places is None else np.union1d(places, more)
            elif places is None:
                continue
            places = places[rank[places] == r]
            if r in self.doubled and len(places) > 1:
                places = _apart(places, after)
            if not len(places):
                continue
            right = after[places]
            beyond = after[right]
            symbol[places] = r
            symbol[right] = -1
            rank[right] = -1
            after[places] = beyond
            before[beyond] = places
            before[n] = n
            left = before[places]
            left = left[left < n]
            open_ = places[beyond < n]
            rank[places] = -1
            touched = np.concatenate([left, open_])
            new = self.pair_rank(symbol[touched], symbol[after[touched]])
            rank[touched] = new
            good = new >= 0
            for number, place in zip(new[good].tolist(), touched[good].tolist()):
                if number in later:
                    later[number].append(place)
                else:
                    later[number] = [place]
                    heapq.heappush(heap, number)
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.append(0, np.cumsum(alive))[edge]


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places that are left if each, from the left, rules out the one right after it."""
    keep, ruled = [], -1
    for place, following in zip(places.tolist(), after[places].tolist()):
        if place != ruled:
            keep.append(place)
            ruled = following
    return np.array(keep)


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(ranks(path).replay)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the token ids of each text. `path` is opened on each worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon(path)
        for batch in batches:
            data, starts, ends = spans(batch.column(1))
            for rows, a, b in pieces(data, starts, ends, 1 << 62):
                ids, bounds = known.lookup(*gather(data, a, b))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes): the bytes that the ids stand for; null ids give no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            out = [table.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode and decode each text, keeping only digests of both."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = lexicon(path), ranks(path)
        for batch in batches:
            data, starts, ends = spans(batch.column(1))
            n = batch.num_rows
            tokens = np.zeros(n, np.int64)
            of_ids, of_bytes = [sha256() for _ in range(n)], [sha256() for _ in range(n)]
            for rows, a, b in pieces(data, starts, ends):
                ids, bounds = known.lookup(*gather(data, a, b))
                text = table.decode(ids)
                cut = np.append(0, np.cumsum(table.length[ids]))[bounds].tolist()
                bounds = bounds.tolist()
                for i, row in enumerate(rows.tolist()):
                    tokens[row] += bounds[i + 1] - bounds[i]
                    of_ids[row].update(ids[bounds[i] : bounds[i + 1]])
                    of_bytes[row].update(text[cut[i] : cut[i + 1]])
            hexes = [pa.array([h.hexdigest() for h in x], pa.string()) for x in (of_ids, of_bytes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), *hexes], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
