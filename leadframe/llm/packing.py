"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the waiting examples that fit, it takes the one whose size
vector, in units of the limits, has the largest dot product with what is left of them. Where examples may be cut, the
last segment of a sequence is the head of an example cut to the gap, so the sequence is full; what is left when the
input ends is cut to powers of two, which need no padding.

Packing runs within each input partition, with a window of waiting examples: no shuffle, bounded memory, and only the
last few sequences of a partition are short. A sequence id holds the partition's number, so ids are unique and a task
that runs again on the same rows gives the same ids.

`pack_examples` packs whole examples under all three limits, with loss-bearing tokens counted apart. `pack_texts` cuts texts
whose every token bears loss, so there the limit on loss is that on tokens, and tokens and segments are what binds.

Defined cases: null and empty texts are one token, the closing id 0. Texts of any length are encoded whole, in chunks, and
cut; their ids (4 bytes each) are held until the text ends, and of what then waits to be placed, fewer than a sequence's. An empty table gives an empty result. An example that can't be cut and exceeds a limit by
itself gets a sequence of its own, marked oversize. Repeated rows are packed each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import CHUNK, Lexicon, pieces
from .shared import gather, keeps, spans, tidy

CAPACITY, SEGMENTS, WINDOW, WORDS = 1024, 128, 1024, 8192


class Packer:
    """One partition's packing. Examples are (handle, start, tokens, loss); a placement adds sequence and offset."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True, window: int = WINDOW, first_sequence: int = 0):
        if min(capacity, segments, window, capacity if loss is None else loss) < 1:
            raise ValueError("limits are at least 1")
        if cut and loss is not None and loss < capacity:
            raise ValueError("cutting supposes that every token bears loss, so the limit on loss can't be below that on tokens")
        self.limits = np.array([capacity, segments, capacity if loss is None else loss], float)
        self.capacity, self.cut, self.window = capacity, cut, window
        self.sequence = first_sequence
        self.size = np.zeros((window, 3))
        self.entry: list = [None] * window
        self.waiting = 0
        self.placed: list[tuple] = []

    def add(self, handle, tokens: int, loss: int, start: int = 0) -> None:
        """Take an example, or what of it begins at token `start` and has `tokens` more."""
        if self.cut:
            while tokens >= self.capacity:
                self._place(handle, start, self.capacity, 0, False)
                self.sequence += 1
                start, tokens = start + self.capacity, tokens - self.capacity
            loss = tokens
        elif tokens > self.limits[0] or loss > self.limits[2]:
            self._place(handle, 0, tokens, 0, True)
            self.sequence += 1
            return
        if tokens == 0 and start:
            return
        if self.waiting == self.window:
            self.fill()
        self._wait(handle, start, tokens, loss)

    def _wait(self, handle, start: int, tokens: int, loss: int) -> None:
        self.size[self.waiting] = tokens, 1, loss
        self.entry[self.waiting] = (handle, start)
        self.waiting += 1

    def _take(self, i: int) -> tuple:
        taken, tokens, loss = self.entry[i], int(self.size[i, 0]), int(self.size[i, 2])
        self.waiting -= 1
        self.size[i], self.entry[i] = self.size[self.waiting], self.entry[self.waiting]
        self.entry[self.waiting] = None
        return (*taken, tokens, loss)

    def _place(self, handle, start: int, tokens: int, offset: int, oversize: bool) -> None:
        self.placed.append((handle, start, tokens, self.sequence, offset, oversize))

    def fill(self, upto: int | None = None) -> None:
        """Build one sequence from what waits, of `upto` tokens at most."""
        left = self.limits.copy()
        left[0] = upto or self.capacity
        offset = 0
        while self.waiting and left[1] >= 1:
            size = self.size[: self.waiting]
            fits = (size <= left).all(axis=1)
            if self.cut and left[1] == 1:
                fits &= size[:, 0] == left[0]
            if fits.any():
                score = size @ (left / self.limits**2)
                score[~fits] = -1
                handle, start, tokens, loss = self._take(int(score.argmax()))
            elif self.cut and left[0] >= 1:
                i = int(size[:, 0].argmax())
                handle, start, tokens, loss = self._take(i)
                if tokens > left[0]:
                    head = int(left[0])
                    self._wait(handle, start + head, tokens - head, tokens - head)
                    tokens = loss = head
            else:
                break
            self._place(handle, start, tokens, offset, False)
            offset += tokens
            left -= (tokens, 1, loss)
            if self.cut and left[0] < 1:
                break
        self.sequence += 1

    def finish(self) -> None:
        while self.waiting:
            total = int(self.size[: self.waiting, 0].sum())
            self.fill(1 << (total.bit_length() - 1) if self.cut and 0 < total < self.capacity else None)


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << 40


def pack_examples(
    examples: DataFrame, id_col: str, tokens_col: str, loss_col: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW
) -> DataFrame:
    """(id_col, tokens, sequence_id, offset, oversize): whole examples, never cut. Null counts are 0."""
    kind = examples.schema[id_col].dataType.simpleString()
    count = lambda name: F.greatest(F.coalesce(F.col(name).cast("long"), F.lit(0)), F.lit(0))
    rows = examples.select(F.col(id_col).alias("id"), count(tokens_col).alias("tokens"), count(loss_col or tokens_col).alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, segments, loss, False, window, _first_sequence())

        def out() -> pa.RecordBatch:
            done, packer.placed = packer.placed, []
            columns = [pa.array([d[k] for d in done], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], at), *columns], names=["id", "tokens", "sequence_id", "offset", "oversize"])

        at = None
        for batch in batches:
            at = batch.column(0).type
            for handle, tokens, bearing in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(handle, tokens, bearing)
            yield out()
        if at is not None:
            packer.finish()
            yield out()

    return rows.mapInArrow(tidy(run), f"id {kind}, tokens long, sequence_id long, offset long, oversize boolean").withColumnRenamed("id", id_col)


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word once: its pre-tokenizer makes words independent.

    Texts that spell one of the vocabulary's added tokens are given to the library whole, as it cuts them there first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # in words, which can't hold a whole added token
        self.words = Lexicon(self._words)

    def _words(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, cuts = data.tobytes(), edge.tolist()
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for at in range(0, len(cuts) - 1, WORDS):  # the library's results are large objects
            here = cuts[at : at + WORDS + 1]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(here, here[1:])], add_special_tokens=False)]
            ids.append(np.fromiter((x for word in found for x in word), np.uint32))
            sizes.append(np.array([len(word) for word in found]))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _whole(self, text: bytes) -> np.ndarray:
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        finally:
            self.tokenizer.encode_special_tokens = True

    def ids(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, row boundaries in them) for rows data[edge[i]:edge[i+1]] of UTF-8."""
        raw = data.tobytes()
        if not any(token in raw for token in self.added):
            return self.words.lookup(data, edge)
        rows = []
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            special = any(token in raw[a:b] for token in self.added)
            rows.append(self._whole(raw[a:b]) if special else self.words.lookup(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))

    @property
    def limit(self) -> int:
        """Bytes of text at a time. Long rows are cut before a space; an added token with a space in it forbids that."""
        return 1 << 62 if any(b" " in token for token in self.added) else CHUNK


def full_and_rest(name, ids: np.ndarray, capacity: int) -> Iterator[tuple[tuple, int, int]]:
    """(handle, tokens, start) of what fills sequences by itself, and of the rest that waits. A handle is the document's id, some
    of its token ids, where they begin, and how many it has. The rest is a copy, so that the document can go."""
    full = len(ids) // capacity * capacity
    if full:
        yield (name, ids[:full], 0, len(ids)), full, 0
    if full < len(ids):
        yield (name, ids[full:].copy() if full else ids, full, len(ids)), len(ids) - full, full


@lru_cache(2)
def encoder(path: str) -> Encoder:
    keeps("packing", encoder.cache_clear)
    return Encoder(path)


def pack_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, window: int = WINDOW, closing: int = 0) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    `path` is the tokenizer's file, opened on each worker; its pre-tokenizer is the byte-level one with its own pattern.
    Every token bears loss, the `closing` id too."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        packer = Packer(capacity, segments, None, True, window, _first_sequence())

        def out(kind) -> pa.RecordBatch:
            done, packer.placed = packer.placed, []
            sums = [crc32(ids[start - base : start - base + n]) for (_, ids, base, _), start, n, *_ in done]
            columns = ([d[1] for d in done], [d[2] for d in done], sums, [d[0][3] for d in done], [d[3] for d in done], [d[4] for d in done])
            return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], kind), *(pa.array(c, pa.int64()) for c in columns)], names=names)

        at = None
        for batch in batches:
            at = batch.column(0).type
            data, starts, ends = spans(batch.column(1))
            handles = batch.column(0).to_pylist()
            parts: list[np.ndarray] = []
            last = None

            def add() -> None:
                ids = np.concatenate([*parts, np.array([closing], "<u4")], dtype="<u4")
                for handle, tokens, start in full_and_rest(handles[last], ids, capacity):
                    packer.add(handle, tokens, 0, start)

            for rows, a, b in pieces(data, starts, ends, known.limit):
                ids, bounds = known.ids(*gather(data, a, b))
                for i, row in enumerate(rows.tolist()):
                    if last is not None and row != last:
                        add()
                        parts = []
                    last = row
                    parts.append(ids[bounds[i] : bounds[i + 1]])
                yield out(at)
            if last is not None:
                add()
            yield out(at)
        if at is not None:
            packer.finish()
            yield out(at)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, "packing"), schema).withColumnRenamed("id", id_col)
