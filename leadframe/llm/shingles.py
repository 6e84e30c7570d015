"""Word shingles of texts: their hashes, the sets of them, and an exact search for similar sets.

Words are runs of bytes other than ASCII white space, with A-Z in lower case; a shingle is some words in a row with a space
between them. A text with fewer words is one shingle, a text without words (null, empty, white space) has none.

Texts of any length are hashed in pieces that are cut at blanks and overlap by a shingle less a word, so that besides the
text itself only its hashes are held, 8 bytes for a word.

Similar sets are those of which PART of WHOLE of the union is common. Candidates that no fingerprint leads to come from
prefixes: put all shingles in one order, the same for every text. A set of n shingles shares at least 0.8 n of them with any
partner, so the first n - ceil(0.8 n) + 1 shingles, its prefix, and that of the partner have one in common; more than one,
in fact, and how many follows from the two sizes (`needed`). Pairs that share fewer keys are not similar and need no look at
their sets. Any order is exact; the one used puts shingles last that recur among the documents, the more often the later, so that
common passages seldom become keys.

Under a key of up to three nodes all pairs are given out. Under a larger one nodes are paired with the first and the
foregoing one, then with some pivots, which links most of a group of similar texts without all its pairs. Pairs that are then
still in different components are compared where they lie, in blocks of bounded size, by bitmaps of their sets: two sets
have no more in common than their bitmaps, and what places in them are shared by several shingles of a set. Only pairs that
may be similar by that are given out. This last part is what makes the search whole; its work, not its output, grows with
the square of the number of such nodes under a key.

Texts that have one prefix shingle in common often have dozens, and so the same pairs under each. Large keys therefore meet at
the home of a key, its smallest node, which is the same for keys of mostly the same nodes: there a node and its bitmap lie once
for all keys, and a pair is given out once for all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, durable, gather, gathered, slices, spans, tidy
from .xxh64 import SPARE, hash_ranges

SEED = 42
CHUNK = 1 << 19  # bytes of text at a time
#: Two sets are similar if 5 x their common shingles is 4 x their union or more.
PART, WHOLE = 4, 5
LOT = 1 << 21
HEAVY = 1 << 18
BLOCK = 4096
BITS = 1 << 23
PIVOTS = 8
#: Places in the bitmap of a set.
PLACES = 1024
#: Places for each shingle in the bitmap by which a pair is looked at before its sets are.
SPREAD = 8
#: Texts, and pairs of sets, in one Arrow batch.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 2048, 512
#: Sets, or pairs of them, in one task at most, about.
SETS_AT_ONCE = 2048
#: A list of up to this many nodes is broadcast, 4 MB; a longer one is joined by a shuffle.
FEW_ENDS = 1 << 18
#: Keys of up to this many nodes give all their pairs at once.
FEW = 3
MET = "home long, key long, node long, n int, a long, b long, need int"
#: Rows of keys that one block of a home has at most, about, and pairs that a task remembers.
KEYS_AT_ONCE, PAIRS_SEEN = 1 << 18, 1 << 18


# --- words and hashes ---------------------------------------------------------------------------------------------


def word_stream(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows data[edge[i]:edge[i+1]], lower-cased in A-Z, with one space after each.

    Returns the normalised bytes (and SPARE more), each word's start and end in them, and the number of words in each row."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    data = low[data]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~blank
    begins = first.copy()
    begins[1:] &= blank[:-1]
    heads = edge[:-1][edge[:-1] < edge[1:]]
    begins[heads] = first[heads]
    solid = np.flatnonzero(first)
    word = np.cumsum(begins)[solid] - 1
    place = np.arange(len(solid)) + word
    n_words = int(word[-1]) + 1 if len(word) else 0
    out = np.full(len(solid) + n_words + SPARE, 32, np.uint8)
    out[place] = data[solid]
    starts = place[np.flatnonzero(begins[solid])]
    ends = np.concatenate([starts[1:] - 1, [len(solid) + n_words - 1]]) if n_words else starts
    upto = np.concatenate([[0], np.cumsum(begins)])[edge]
    return out, starts, ends, np.diff(upto)


def hashes(data: np.ndarray, edge: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, repeats included, row after row; how many each row has)."""
    text, starts, ends, words = word_stream(data, edge)
    counts = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(words)), counts)
    left = (np.cumsum(words) - words)[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    right = left + np.minimum(words[row], shingle) - 1
    h = np.zeros(len(row), np.uint64)
    for at in range(0, len(row), 1 << 15):
        a, b = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
        h[at : at + (1 << 15)] = hash_ranges(text, starts[a], ends[b] - starts[a], SEED)
    return h, counts


def blank_from(data: np.ndarray, at: int) -> int:
    """The first white space at or after this place, or the end."""
    for begin in range(at, len(data), 1 << 16):
        part = data[begin : begin + (1 << 16)]
        found = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(found):
            return begin + int(found[0])
    return len(data)


def hashes_of_long(data: np.ndarray, shingle: int, limit: int = CHUNK) -> np.ndarray:
    """The hashes of one long row's shingles, from pieces of about `limit` bytes that end at white space."""
    found, held, at = [np.zeros(0, np.uint64)], np.zeros(0, np.uint8), 0
    while at < len(data):
        cut = blank_from(data, min(len(data), at + limit))
        piece = np.concatenate([held, data[at:cut]])
        text, starts, ends, words = word_stream(piece, np.array([0, len(piece)]))
        n = len(starts)
        if n >= shingle:
            left = starts[: n - shingle + 1]
            found.append(hash_ranges(text, left, ends[shingle - 1 :] - left, SEED))
        if n:  # the last words go on to the next piece, where they begin the shingles that reach into it
            first = max(0, n - shingle + 1)
            held = text[starts[first] : ends[-1] + 1] if first < n else held[:0]
        at = cut
    if len(found) == 1 and len(held):
        return hash_ranges(held, np.zeros(1, np.int64), np.array([len(held) - 1]), SEED)
    return np.concatenate(found)


def hashed(column, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, hashes, counts) for groups of rows of an Arrow text column."""
    data, starts, ends = spans(column)
    for a, b in slices(starts, ends, CHUNK):
        if b - a == 1 and ends[a] - starts[a] > CHUNK:
            h = hashes_of_long(data[starts[a] : ends[a]], shingle)
            yield a, b, h, np.array([len(h)])
        else:
            yield a, b, *hashes(*gather(data, starts[a:b], ends[a:b]), shingle)


def fingerprint_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each row: a bit is 1 if it is set in over half the row's hashes."""
    ones = np.zeros((len(counts), 64), np.int64)
    row_of = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(h), 1 << 15):
        row = row_of[at : at + (1 << 15)]
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(row, prepend=-1))
        ones[row[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


# --- sets ---------------------------------------------------------------------------------------------------------


def sets_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of row i, ascending, are hashes[bounds[i]:bounds[i+1]]."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row)) if len(counts) > 1 else np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(counts)))])


def nodes_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for the empty one."""
    size = np.diff(bounds)
    node = np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    node[some] = hash_ranges(h.view(np.uint8), 8 * bounds[some], 8 * size[some], SEED).view(np.int64)
    return node


def bitmaps(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets x PLACES / 64) the bitmap of each set of hashes."""
    out = np.zeros((len(size), PLACES // 8), np.uint8)
    for at in range(0, len(size), 4096):
        part = size[at : at + 4096]
        begin = int(size[:at].sum())
        places = np.zeros((len(part), PLACES), bool)
        places[np.repeat(np.arange(len(part)), part), h[begin : begin + int(part.sum())] % np.uint64(PLACES)] = True
        out[at : at + 4096] = np.packbits(places, axis=1)
    return out.view(np.uint64)


def wide_bitmaps(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of each set of hashes with SPREAD places for each of them, or up to twice as many: a power of two, PLACES at
    least. Two such bitmaps can be compared after the larger one is folded."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        places = max(PLACES, 1 << (SPREAD * (b - a) - 1).bit_length())
        bits = np.zeros(places, bool)
        bits[(h[a:b] & np.uint64(places - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits).tobytes())
    return out


class Seen:
    """The nodes that a task has met lately: a bounded memory that saves repetitions and never changes a result."""

    def __init__(self, capacity: int = 1 << 16):
        self.known: set[int] = set()
        self.capacity = capacity

    def fresh(self, node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which of the wanted rows have a node that wasn't met."""
        out = np.zeros(len(node), bool)
        for i in np.flatnonzero(wanted).tolist():
            x = int(node[i])
            if x not in self.known:
                out[i] = True
                self.known.add(x)
        if len(self.known) > self.capacity:
            self.known.clear()
        return out


def _lists(size: np.ndarray, h: np.ndarray, valid: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)), mask=pa.array(~valid))


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    """(key, count) of the hashes that occur in several of the sets."""
    h = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    count = np.diff(np.append(head, len(h)))
    return pa.RecordBatch.from_arrays([pa.array(h[head[count > 1]].view(np.int64)), pa.array(count[count > 1])], names=["key", "count"])


def heavy_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of the HEAVY shingles that recur most among all documents, roughly.

    A task counts its sets in lots of about LOT shingles, and only what recurs within a lot goes on. So nothing that is
    frequent is missed, and what is shuffled is small; the counts only set the order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, h, counts in hashed(batch.column(0), shingle):
                held.append(sets_of(h, counts)[0])
                size += len(held[-1])
                if size >= LOT:
                    yield _repeated(held)
                    held, size = [], 0
        yield _repeated(held)

    counted = docs.select(text_col).mapInArrow(tidy(run), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        top = counted.orderBy(F.desc("count"), "key").limit(HEAVY).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], top.column("count").to_numpy()[order]


def marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, print, node, fp, n, bits, wide, prefix) of every row: a hash of its text, that of its set, its fingerprint, the size of
    its set; `bits` and `wide`, the set's bitmaps, and `prefix` only with the first of a task's rows that has a node, else null."""
    kind = docs.schema[id_col].dataType.simpleString()
    heavy, often = heavy_shingles(docs, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for a, b, every, counts in hashed(batch.column(2), shingle):
                fp = fingerprint_bits(every, counts)
                h, bounds = sets_of(every, counts)
                node, size = nodes_of(h, bounds), np.diff(bounds)
                fresh = seen.fresh(node, np.ones(b - a, bool))
                rank = np.zeros(len(h), np.int64)
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    rank = np.where(heavy[place] == h, often[place], 0)
                row = np.repeat(np.arange(b - a), size)
                length = np.where(fresh & (size > 0), size + 1 - -(-PART * size // WHOLE), 0)
                order = np.lexsort((h, rank, row))
                order = order[np.arange(len(h)) - bounds[row] < length[row]]
                own = batch.slice(a, b - a)
                new = h[fresh[row]]
                bits = iter(bitmaps(new, np.where(fresh, size, 0)[fresh]))
                bits = pa.array([next(bits).tobytes() if f else None for f in fresh], pa.binary())
                wide = iter(wide_bitmaps(new, np.append(0, np.cumsum(size[fresh]))))
                wide = pa.array([next(wide) if f else None for f in fresh], pa.binary())
                columns = [own.column(0), own.column(1), pa.array(node), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32)), bits, wide, _lists(length, h[order], fresh)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "print", "node", "fp", "n", "bits", "wide", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, print long, node long, fp long, n int, bits binary, wide binary, prefix array<long>")


def sets_for(docs: DataFrame, text_col: str, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of these nodes (node, distinct), and of a few others: a bitmap of 1 MB holds back nearly all of them
    before the shuffle."""
    slot = F.pmod("node", F.lit(BITS))
    words = nodes.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for _, _, every, counts in hashed(batch.column(0), shingle):
                h, bounds = sets_of(every, counts)
                node, size = nodes_of(h, bounds), np.diff(bounds)
                at = node % BITS
                wanted = seen.fresh(node, (bitmap[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1)
                h = h[np.repeat(wanted, size)]
                yield pa.RecordBatch.from_arrays([pa.array(node[wanted]), _lists(size[wanted], h, wanted[wanted])], names=["node", "shingles"])

    found = docs.select(text_col).mapInArrow(tidy(run), "node long, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


# --- pairs of sets ------------------------------------------------------------------------------------------------


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("left", "right"):
            column = batch.column(name)
            sides.append((column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])))
        (x, xs), (y, ys) = sides
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            both = np.sort(np.concatenate([x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]]))
            common = int((both[1:] == both[:-1]).sum())
            ok[i] = WHOLE * common >= PART * (len(both) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])


def _may_agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
            x, y = (np.frombuffer(b.as_py(), np.uint8) for b in (x, y))
            while len(x) > len(y):
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] | y[len(y) // 2 :]
            hidden = min(int(k) - int(np.bitwise_count(b).sum()) for k, b in ((n[i], x), (m[i], y)))
            common = int(np.bitwise_count(x & y).sum()) + hidden
            ok[i] = (PART + WHOLE) * common >= PART * (n[i] + m[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])


def plausible(pairs: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """(a, b, ok): whether the sets of the nodes a and b may be similar by their wide bitmaps, an eighth of the sets' bytes."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = nodes.select("node", "n", "wide").join(F.broadcast(ends) if 2 * many <= FEW_ENDS else ends, "node", "left_semi")
    both = pairs.select("a", "b").join(own.select(F.col("node").alias("a"), "n", F.col("wide").alias("left")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("wide").alias("right")), "b")
    with arrow_rows(pairs.sparkSession, PAIRS_AT_ONCE):
        return durable(gathered(both.select("a", "b", "n", "m", "left", "right").mapInArrow(tidy(_may_agree), "a long, b long, ok boolean"), many, SETS_AT_ONCE))


def judged(docs: DataFrame, text_col: str, shingle: int, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, ok): whether the sets of the nodes a and b are similar. `pairs` and `nodes` (node, n, wide) are durable.

    Long texts share passages and are cut out by bitmaps as long as they; only what may be similar is compared as sets."""
    first = plausible(pairs, nodes, pairs.count())
    apart, pairs = first.where("not ok"), first.where("ok").select("a", "b")
    many = pairs.count()
    if not many:
        return apart
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    with arrow_rows(pairs.sparkSession, TEXTS_AT_ONCE):
        sets = durable(gathered(sets_for(docs, text_col, ends, shingle), 2 * many, SETS_AT_ONCE))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    with arrow_rows(pairs.sparkSession, PAIRS_AT_ONCE):
        return apart.union(durable(gathered(both.select("a", "b", "left", "right").mapInArrow(tidy(_agreeing), "a long, b long, ok boolean"), many, SETS_AT_ONCE)))


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many prefix shingles similar sets of n and m have in common at least.

    Common shingles that aren't in both prefixes lie behind that prefix which ends first, so there are no more of them than
    the larger of what the sets have behind their prefixes."""
    common = -(-PART * (n + m) // (PART + WHOLE))
    behind = np.maximum(-(-PART * n // WHOLE), -(-PART * m // WHOLE)) - 1
    return np.maximum(1, common - behind)


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return WHOLE * np.minimum(n, m) >= PART * np.maximum(n, m)


def _met_batch(home=None, key=None, node=None, n=None, a=None, b=None, need=None) -> pa.RecordBatch:
    """Rows of large keys (home, key, node, n), or pairs of nodes (a, b, need)."""
    rows = len(node) if node is not None else len(a)
    null = lambda x, kind: pa.nulls(rows, kind) if x is None else pa.array(x, kind)
    columns = [null(home, pa.int64()), null(key, pa.int64()), null(node, pa.int64()), null(n, pa.int32()), null(a, pa.int64()), null(b, pa.int64()), null(need, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["home", "key", "node", "n", "a", "b", "need"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n) sorted by key and node: the pairs of small keys, and of large ones the rows and the pairs of each
    with the first and the foregoing."""
    held = [np.zeros(0, np.int64)] * 3  # rows of the last key: all if there are few, else the first and the last one
    large = False  # whether those held have been given out
    for batch in itertools.chain(batches, [None]):
        new = [np.zeros(0, np.int64)] * 3 if batch is None else [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "n")]
        key, node, n = (np.concatenate(x) for x in zip(held, new))
        done = len(held[0]) if large else 0
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        again[:done] = False
        key, node, n = key[~again], node[~again], n[~again]
        if not len(key):
            continue
        head = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(head, len(key)))
        many = size > FEW
        many[0] |= large
        cut = len(key) if batch is None or many[-1] else int(head[-1])
        if batch is not None:
            large = bool(many[-1])
            ends = [head[-1], len(key) - 1] if large else slice(cut, None)
            held = [x[ends] for x in (key, node, n)]
        here = np.arange(len(key))
        first, of_many = np.repeat(head, size), np.repeat(many, size)
        rows = np.flatnonzero(of_many & (here >= done) & (here < cut))
        yield _met_batch(home=node[first[rows]], key=key[rows], node=node[rows], n=n[rows])
        second = np.flatnonzero((here > first) & (here >= done) & (here < cut))
        far = second[second - 1 != first[second]]
        x, y = np.concatenate([second, far]), np.concatenate([first[second], far - 1])
        fit = _sizes_fit(n[x], n[y])
        x, y = x[fit], y[fit]
        yield _met_batch(a=np.minimum(node[x], node[y]), b=np.maximum(node[x], node[y]), need=needed(n[x], n[y]))


def met(marks: DataFrame) -> DataFrame:
    """What the nodes that share a prefix shingle have to do with each other, as MET: nodes of large keys, and pairs."""
    rows = marks.where("n > 0 and prefix is not null").select(F.explode("prefix").alias("key"), "node", "n")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(_meetings), MET)


def neighbours(meeting: DataFrame) -> DataFrame:
    """(a, b): the pairs that were given out under as many keys as they need. Of pairs that share small keys only, none is
    missing; those that share a large one are left to `apart`, if need be."""
    counted = meeting.where("a is not null").groupBy("a", "b", "need").agg(F.count("*").alias("c"))
    return counted.where("c >= need").select("a", "b")


def _rest_pairs(rows: dict[str, np.ndarray], keys: np.ndarray, own: np.ndarray, pivots: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one group (home, i, j) and one key in different components that may be similar by their sizes and
    bitmaps; only those with one of some `pivots` rows under the key, or all if that is None. Where a group is of two blocks,
    only pairs of both. `keys` are those of the rows, one after another; `own` is the row of each."""
    home, i, j, node, n, root, mine, bits = (rows[c] for c in ("home", "i", "j", "node", "n", "root", "mine", "bits"))
    group = np.cumsum((np.diff(home, prepend=home[:1]) != 0) | (np.diff(i, prepend=i[:1]) != 0) | (np.diff(j, prepend=j[:1]) != 0))
    order = np.lexsort((n[own], keys, group[own]))
    key, at = keys[order], own[order]
    here = np.arange(len(key))
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[at[1:]] != group[at[:-1]]))[: len(key)])
    size = np.diff(np.append(head, len(key)))
    stop = np.repeat(head + size, size)
    pivot = np.ones(len(key), bool)
    if pivots is not None:
        run = np.repeat(np.arange(len(head)), size)
        by_node = np.lexsort((node[at], run))  # nodes are hashes, so the first ones are a choice at random
        pivot[by_node] = here - head[run] < pivots
    hidden = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles that share a place with another

    def similar(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = _once(x, y)  # a pair under many keys is looked at once
        fit = np.zeros(len(x), bool)
        for k in range(0, len(x), 1 << 16):
            a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[a], hidden[b])
            fit[k : k + (1 << 16)] = (PART + WHOLE) * common >= PART * (n[a] + n[b])
        return x[fit], y[fit]

    found, open_, waiting = [(at[:0], at[:0])], [(at[:0], at[:0])], 0
    live, lag = here, 1
    while len(live):
        live = live[live + lag < stop[live]]
        live = live[_sizes_fit(n[at[live]], n[at[live + lag]])]  # sizes ascend, so what is too large now stays so
        a, b = at[live], at[live + lag]
        hit = (pivot[live] | pivot[live + lag]) & (root[a] != root[b]) & ((i[a] == j[a]) | (mine[a] != mine[b]))
        open_.append((np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit])))
        waiting += int(hit.sum())
        if waiting >= PAIRS_SEEN:
            found.append(similar(*map(np.concatenate, zip(*open_))))
            open_, waiting = [(at[:0], at[:0])], 0
        lag += 1
    found.append(similar(*map(np.concatenate, zip(*open_))))
    x, y = _once(*map(np.concatenate, zip(*found)))
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), each once."""
    order = np.lexsort((b, a))
    new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(order)]
    return a[order[new]], b[order[new]]


class SeenPairs:
    """The pairs that a task has given out lately: a bounded memory that saves repetitions and never changes a result."""

    def __init__(self, capacity: int = PAIRS_SEEN):
        self.a, self.b, self.capacity = np.zeros(0, np.int64), np.zeros(0, np.int64), capacity

    def fresh(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """(a, b): those of the pairs that weren't given out."""
        known = len(self.a)
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        order = np.lexsort((b, a))  # stable, so a known pair comes before its repetitions
        first = order[np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))[: len(order)]]
        new = first[first >= known]
        self.a, self.b = (a[first], b[first]) if len(first) <= self.capacity else (a[:0], b[:0])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _by_group(batches: Iterator[pa.RecordBatch], pivots: int | None) -> Iterator[pa.RecordBatch]:
    """`_rest_pairs` of rows sorted by group; the last group of a batch waits for the next one."""
    seen, held = SeenPairs(), None

    def found(rows: dict[str, np.ndarray], keys: np.ndarray) -> pa.RecordBatch:
        return seen.fresh(*_rest_pairs(rows, keys, np.repeat(np.arange(len(rows["node"])), rows["many"]), pivots))

    for batch in batches:
        rows = {c: batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names if c not in ("bits", "keys")}
        data, starts, ends = spans(batch.column("bits"))
        rows["bits"] = gather(data, starts, ends)[0].reshape(-1, PLACES // 8).copy().view(np.uint64)
        rows["many"] = batch.column("keys").value_lengths().to_numpy().astype(np.int64)
        keys = batch.column("keys").flatten().to_numpy()
        if held is not None:
            rows, keys = {c: np.concatenate([held[0][c], rows[c]]) for c in rows}, np.concatenate([held[1], keys])
        if not len(rows["node"]):
            continue
        other = np.flatnonzero((rows["home"] != rows["home"][-1]) | (rows["i"] != rows["i"][-1]) | (rows["j"] != rows["j"][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        edge = int(rows["many"][:cut].sum())
        held = ({c: x[cut:] for c, x in rows.items()}, keys[edge:])
        if cut:
            yield found({c: x[:cut] for c, x in rows.items()}, keys[:edge])
    if held is not None:
        yield found(*held)


def housed(meeting: DataFrame) -> DataFrame:
    """(home, node, n, keys): the large keys of each node, by their homes."""
    return meeting.where("key is not null").groupBy("home", "node").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys"))


def apart(homes: DataFrame, nodes: DataFrame, tree: DataFrame, block: int, pivots: int | None) -> DataFrame:
    """(a, b): pairs of nodes in different components that share a large key and may be similar, all or those with pivots.
    `homes`, from `housed`, and `nodes` (node, bits) are durable."""
    rooted = homes.join(tree.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("home").agg(F.count("*").alias("rows"), F.sum(F.size("keys")).alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("held") / KEYS_AT_ONCE)).cast("int")
    mixed = durable(gathered(mixed.select("home", blocks.alias("blocks")), nodes.count()))
    dealt = rooted.join(mixed, "home").join(nodes.select("node", "bits"), "node")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("home", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "n", "root", "mine", "bits", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, pivots)

    return dealt.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(tidy(run), "a long, b long").distinct()
