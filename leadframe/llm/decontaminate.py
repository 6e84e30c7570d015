"""Benchmark passages in documents, by winnowed fingerprints that guarantee every shared span of SPAN words.

Words are runs of ASCII letters (A-Z in lower case), digits and characters beyond ASCII. A window is SPAN consecutive words of
an item, or all of an item that has fewer. A document's word is hit if it lies in any occurrence of a window.

Winnowing keeps, of each SPAN - GRAM + 1 neighbouring GRAM-word hashes, the least one (the last of equals). The same SPAN words
have the same hashes, so wherever a window occurs its document keeps a hash that an item keeps as well. Items of fewer words
than SPAN can't be found that way; for each number of words that such items have, every hash of so many words is kept, which is
winnowing with windows of one hash.

1. Items give their fingerprints and windows. A bitmap of the fingerprints, 1 MB whatever their number, goes to the executors.
2. Documents are read once. Of their fingerprints those are kept whose bit is set, with the hashes of the windows around them.
3. Fingerprints of documents and items are joined. Each hit is extended: the windows around it are joined with the items'
   windows, and overlapping ones are merged to spans.

Text is never shuffled, and a fingerprint that very many documents or items share is never paired: both joins ask whether a
hash occurs, and only a document's distinct windows are joined with their items. Words are compared by 64-bit XXH64 and windows
by 64-bit sums of these, so different texts count as equal with a probability of about 2**-64 for each comparison.

Defined cases: null, empty and wordless texts have no words and no hits; wordless items have no windows. Items without an id
take no part. Repeated documents give a row each; rows of one item id count as one item with all their windows. Texts of any
length are read whole, in pieces; what is held beside the text is 12 bytes for a word. No documents give no rows; no items
leave all documents clean. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, gather, slices, spans, tidy
from .shingles import blank_from, word_stream
from .xxh64 import hash_ranges

SPAN, GRAM = 10, 5
SEED = 0
#: Bytes of text, and words, at a time.
CHUNK, WORDS = 1 << 19, 1 << 16
#: The bitmap has 2**BITS bits.
BITS = 23
#: Tables of hashes with so many rows at most are broadcast, 4 MB; larger ones are joined by a shuffle.
FEW = 1 << 18
#: Fixed value: an odd multiplier, the fractional part of the golden ratio.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

FOUND = "array<struct<size:int,print:bigint,start:bigint,windows:array<bigint>>>"


# --- words and hashes -----------------------------------------------------------------------------------------------


def _letters() -> np.ndarray:
    """Each byte as it is in words, or a space."""
    table = np.full(256, 32, np.uint8)
    for first, last in ((48, 58), (97, 123), (128, 256)):
        table[first:last] = np.arange(first, last)
    table[65:91] = np.arange(97, 123)
    return table


LETTERS = _letters()


def _hashes(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each row)."""
    text, starts, ends, counts = word_stream(data, edge)
    return hash_ranges(text, starts, ends - starts, SEED), counts


def word_hashes(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, hashes, counts) for groups of rows of an Arrow text column."""
    data, starts, ends = spans(column)
    for a, b in slices(starts, ends, CHUNK):
        if b - a == 1 and ends[a] - starts[a] > CHUNK:
            row, at, found = LETTERS[data[starts[a] : ends[a]]], 0, [np.zeros(0, np.uint64)]
            while at < len(row):
                cut = blank_from(row, min(len(row), at + CHUNK))
                found.append(_hashes(row[at:cut], np.array([0, cut - at]))[0])
                at = cut
            h = np.concatenate(found)
            yield a, b, h, np.array([len(h)])
        else:
            part, edge = gather(data, starts[a:b], ends[a:b])
            yield a, b, *_hashes(LETTERS[part], edge)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words that begin at each place, as far as there are so many."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, size):
            out *= FACTOR
            out += h[k : n + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def winnowed(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The places of the least of grams[i:i+width], the last of equals, for each i in `at` (ascending); each place once."""
    least, place = grams[at], at.copy()
    for k in range(1, width):
        here = grams[at + k]
        lower = here <= least
        least = np.where(lower, here, least)
        place = np.where(lower, at + k, place)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


def prints(h: np.ndarray, counts: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Fingerprints of rows whose word hashes are h: (size, their hashes, their places in h, first and last place where a window
    that holds them may begin, within the row). `sizes` are the lengths under SPAN at which every hash is kept."""
    edge = np.append(0, np.cumsum(counts))
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for low in range(0, len(h), WORDS):
        part = h[low : low + WORDS + SPAN - 1]
        own = row[low : low + WORDS + SPAN - 1]
        for size in [SPAN, *sizes]:
            if len(part) < size:
                continue
            at = np.flatnonzero(own[: len(part) - size + 1] == own[size - 1 :])
            at = at[at < WORDS]
            if size < SPAN:
                yield size, rolled(part, size)[at], at + low, at + low, at + low
            else:
                grams = rolled(part, GRAM)
                place = winnowed(grams, at, SPAN - GRAM + 1)
                of = own[place]
                first = np.maximum(place + low - (SPAN - GRAM), edge[of])
                yield size, grams[place], place + low, first, np.minimum(place + low, edge[of + 1] - SPAN)


# --- items ----------------------------------------------------------------------------------------------------------


def _items(benchmark: DataFrame, id_col: str, text_col: str, schema: str, emit) -> DataFrame:
    """`emit(h, counts)` gives (row, size, hash) arrays for a group of items."""
    fields = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = fields.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, counts in word_hashes(batch.column(1)):
                row, size, value = emit(h, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(size, pa.int32()), pa.array(value.view(np.int64))], names=["item", "size", schema])

    return fields.mapInArrow(tidy(run), f"item {kind}, size int, {schema} long")


def _whole(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, size, hash) of the rows that have words but fewer than SPAN."""
    edge = np.append(0, np.cumsum(counts))
    short = np.flatnonzero((counts > 0) & (counts < SPAN))
    value = [rolled(h[edge[r] : edge[r] + counts[r]], int(counts[r])) for r in short.tolist()]
    return short, counts[short], np.concatenate([np.zeros(0, np.uint64), *value])


def _item_prints(h: np.ndarray, counts: np.ndarray):
    row = np.repeat(np.arange(len(counts)), counts)
    found = [(row[place], value) for _, value, place, _, _ in prints(h, counts, [])]
    short, size, whole = _whole(h, counts)
    rows = np.concatenate([short, *(r for r, _ in found)]).astype(np.int64)
    return rows, np.concatenate([size, *(np.full(len(r), SPAN) for r, _ in found)]), np.concatenate([whole, *(v for _, v in found)])


def _item_windows(h: np.ndarray, counts: np.ndarray):
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[: max(0, len(row) - SPAN + 1)] == row[SPAN - 1 :]) if len(row) >= SPAN else np.zeros(0, np.int64)
    short, size, whole = _whole(h, counts)
    return np.concatenate([short, row[at]]).astype(np.int64), np.concatenate([size, np.full(len(at), SPAN)]), np.concatenate([whole, rolled(h, SPAN)[at]])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the highest BITS bits of `print`: 2**BITS bits, whatever the number of rows."""
    place = F.shiftrightunsigned(F.col("print"), 64 - BITS)
    blocks = hashes.groupBy((place / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(place % 32768).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for block, bits in blocks.collect():
        out[block * 4096 : (block + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _met(table: DataFrame) -> DataFrame:
    """A table of hashes, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= FEW else table


# --- documents ------------------------------------------------------------------------------------------------------


def suspected(docs: DataFrame, bits: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, found): a row for each document; `found` holds its fingerprints whose bit is set: their size, hash,
    where the first window around them begins, and the hashes of these windows. `row` tells rows with equal ids apart."""
    fields = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = fields.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)

    def judged(h: np.ndarray, counts: np.ndarray) -> pa.Array:
        known = shared.value
        edge = np.append(0, np.cumsum(counts))
        got = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2]
        for size, value, place, first, last in prints(h, counts, sizes):
            bit = (value >> np.uint64(64 - BITS)).astype(np.int64)
            hit = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            many = last[hit] - first[hit] + 1
            begin = np.repeat(first[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
            if size < SPAN:
                windows = value[hit]
            else:
                windows = np.zeros(len(begin), np.uint64)
                for k in range(0, len(begin), WORDS):
                    windows[k : k + WORDS] = rolled(h[begin[k : k + WORDS, None] + np.arange(SPAN)].T, SPAN)[0]
            row = np.searchsorted(edge, place[hit], "right") - 1
            got.append([row, np.full(len(hit), size), first[hit] - edge[row], many, value[hit], windows])
        row, size, start, many, value, _ = (np.concatenate(x) for x in zip(*got))
        # The fingerprints of a row come in no order here; their windows are moved along.
        order = np.argsort(row, kind="stable")
        begin = (np.cumsum(many) - many)[order]
        stop = np.cumsum(many[order])
        windows = np.concatenate([g[5] for g in got])[np.repeat(begin - stop + many[order], many[order]) + np.arange(int(many.sum()))]
        columns = [pa.array(size[order], pa.int32()), pa.array(value[order].view(np.int64)), pa.array(start[order]), lists(many[order], pa.array(windows.view(np.int64)))]
        each = pa.StructArray.from_arrays(columns, names=["size", "print", "start", "windows"])
        return lists(np.bincount(row, minlength=len(counts)), each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, counts in word_hashes(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), judged(h, counts)], names=["id", "n_words", "found"])

    rows = fields.mapInArrow(tidy(run), f"id {kind}, n_words long, found {FOUND}")
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


class Hits:
    """Documents and the windows that occur in them.

    `documents`: (row, id, n_words, suspect), a row for each document. `windows`: (row, start, size, hash), a row for each
    place of a document where an item's window begins. `items`: (item, size, hash), the items' windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        known = durable(_items(benchmark, item_col, item_text_col, "print", _item_prints).select("size", "print").distinct())
        sizes = sorted(r[0] for r in known.select("size").where(F.col("size") < SPAN).distinct().collect())
        self.items = durable(_items(benchmark, item_col, item_text_col, "hash", _item_windows).distinct())
        windows = durable(self.items.select("size", "hash").distinct())
        rows = durable(suspected(docs, bitmap(known), sizes, id_col, text_col))
        self.documents = rows.select("row", "id", "n_words", (F.size("found") > 0).alias("suspect"))
        met = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*").join(_met(known), ["size", "print"], "left_semi")
        around = met.select("row", "size", "start", F.posexplode("windows").alias("k", "hash")).select("row", (F.col("start") + F.col("k")).alias("start"), "size", "hash")
        self.windows = durable(around.join(_met(windows), ["size", "hash"], "left_semi").distinct())

    def covered(self) -> DataFrame:
        """(row, n_hit): how many words of a document lie in windows."""
        before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("size")
        fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
        return self.windows.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))

    def matched(self) -> DataFrame:
        """(row, item): the items whose windows occur in a document."""
        return self.windows.select("row", "size", "hash").distinct().join(self.items, ["size", "hash"]).select("row", "item").distinct()

    def spans(self) -> DataFrame:
        """(id, item, start, words): the longest runs of a document's words that are covered by an item's windows."""
        at = self.windows.join(self.items, ["size", "hash"]).select("row", "item", "start", (F.col("start") + F.col("size")).alias("end"))
        order = Window.partitionBy("row", "item").orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
        runs = at.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", island)
        runs = runs.groupBy("row", "item", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return self.documents.where("suspect").select("row", "id").join(runs, "row").select("id", "item", "start", (F.col("end") - F.col("start")).alias("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, contaminated): a row for each document; `items` are the ids, as strings, sorted."""
    hits = Hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    items = hits.matched().groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = hits.covered().join(items, "row")
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    suspects = hits.documents.where("suspect").join(found, "row", "left").select("id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))
    clean = hits.documents.where("not suspect").select("id", "n_words", zero.alias("n_hit"), none.alias("items"))
    return clean.unionByName(suspects).select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = f"""
with d as materialized (
    select row_number() over () as k, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w
    from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w
    from benchmark where item_id is not null
), bw as materialized (
    select distinct item_id, least(len(w), {SPAN}) as n, array_to_string(w[i : i + {SPAN - 1}], ' ') as win
    from (select *, unnest(range(1, 2 + greatest(len(w) - {SPAN}, 0))) as i from b where len(w) > 0) x
), dw as (
    select k, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d join (select distinct n from bw) s on len(w) >= n) x
), hit as materialized (
    select k, i, dw.n, dw.win from dw where (dw.n, dw.win) in (select n, win from bw)
), words as (
    select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) x group by k
), found as (
    select k, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct k, cast(item_id as varchar) as item from hit join bw on bw.n = hit.n and bw.win = hit.win) x group by k
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (k) left join found using (k)
"""
