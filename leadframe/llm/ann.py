"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are brought to length 1, where the Euclidean distance orders like the cosine. A table hashes by HASHES functions
floor((a.x + b) / WIDTH) with Gaussian (2-stable) a. A query looks in its own bucket and in perturbed buckets, in the order
of their estimated success: the sum of squared distances to the bucket borders that are crossed. Which sets of borders are
worth trying comes from a template ordered by expected cost; each query puts the template in order by its own distances.
What the tables find is merged and ranked exactly by cosine in double precision on the original vectors.

Every row is indexed. A table has more functions the more rows there are, so that buckets stay small, as long as that
leaves them selective. The number of probes is fitted: the true neighbours of SAMPLE_QUERIES rows are looked up among all
rows, and the fewest probes are taken that find TARGET of them; the share of rows that those lead to is measured on SAMPLE
rows. If no number of probes reaches the target, every row is ranked.

Two ways lead to the same candidates. Where the buckets are selective, an index is joined: rows lie under (table, slot of
the code), queries go to the slots of their probes only, and large slots are split over parts, queries too. Where they are
not, as with vectors without structure, whose neighbours are hardly nearer than any row, a join would copy most rows many
times; then blocks of rows, each hashed once, meet the blocks of queries, and probes choose rows within.

Defined cases: those of blocks.py; zero vectors take no part. Fewer candidates than k give fewer rows. A query whose buckets
hold fewer than k rows is ranked against all rows (or, in blocks, against all of such a block), so none comes back short.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .shared import as_array, durable

TABLES, HASHES, MOST_HASHES, WIDTH = 12, 8, 24, 1.5
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 128, 0.94
#: Up to this share of all rows for a query, found by the fit, the index is joined.
SELECTIVE = 0.05
#: Rows of a table in one slot on average, and rows or queries of a slot in one part at most, about.
PER_SLOT, PER_PART = 2048, 8192
#: Bits of a code that tell whether a block has any row with them.
LOW = (1 << 16) - 1
#: Where queries look at more than this share of a block, all products of unit vectors are taken at once.
DENSE = 1 / 16
PROBES = (1, 2, 4, 8, 16, 32, 64, 96, 128, 192, 256, 384, 512, 768, 1024)


@lru_cache(4)
def template(m: int = HASHES) -> np.ndarray:
    """Sets of crossed borders as rows of 0 and 1 over the 2 m borders from near to far, in order of expected cost.

    Border j and border 2 m - 1 - j are the two of one hash, as their distances add up to the width. Sets are made in order
    of cost: from one by moving its last border outwards, or by taking in the next one too."""
    cost = np.array([j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)])
    sets, heap = [()], [(cost[0], (0,))]
    while heap and len(sets) < 2 * PROBES[-1]:
        spent, last = heapq.heappop(heap)
        if not any(2 * m - 1 - x in last for x in last):
            sets.append(last)
        far = last[-1] + 1
        if far < 2 * m:
            heapq.heappush(heap, (spent - cost[far - 1] + cost[far], (*last[:-1], far)))
            heapq.heappush(heap, (spent + cost[far], (*last, far)))
    out = np.zeros((len(sets), 2 * m), np.int64)
    for row, chosen in zip(out, sets):
        row[list(chosen)] = 1
    return out


def hashes_for(rows: int) -> int:
    """Functions of a table for so many rows: a bucket should not fill up as rows are added, and a function parts the rows
    by about one and a half bits."""
    return int(np.clip(HASHES + math.ceil(math.log2(max(1, rows / SAMPLE)) / 1.5), HASHES, MOST_HASHES))


class Tables:
    """The hash functions, the same on every worker, for vectors of one dimension."""

    def __init__(self, dim: int, hashes: int = HASHES, seed: int = 0):
        rng = np.random.default_rng((seed, dim))
        self.hashes = hashes
        self.a = rng.normal(size=(TABLES, MOST_HASHES, dim))[:, :hashes].transpose(0, 2, 1)
        self.b = rng.uniform(0, WIDTH, (TABLES, MOST_HASHES))[:, :hashes]
        self.mix = (rng.integers(1, 1 << 62, (TABLES, MOST_HASHES)) | 1)[:, :hashes]

    def place(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket coordinates, distance above the lower border in widths)."""
        f = (unit @ self.a[table] + self.b[table]) / WIDTH
        cell = np.floor(f)
        return cell.astype(np.int64), f - cell

    def code(self, cell: np.ndarray, table: int) -> np.ndarray:
        return (cell * self.mix[table]).sum(1)

    def probes(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(queries x probes) codes of the buckets to visit, best first."""
        cell, above = self.place(unit, table)
        distance = np.concatenate([above, 1 - above], axis=1) ** 2
        near = np.argsort(distance, axis=1)
        sets = template(self.hashes)[: max(2 * probes, 64)]
        cost = np.take_along_axis(distance, near, axis=1) @ sets.T
        if probes < cost.shape[1]:
            first = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(cost, first, axis=1), axis=1, kind="stable"), axis=1)
        else:
            first = np.argsort(cost, axis=1, kind="stable")
        step = np.where(near < self.hashes, -1, 1) * self.mix[table][near % self.hashes]
        return self.code(cell, table)[:, None] + np.take_along_axis(step @ sets.T, first, axis=1)


def unit(vecs: np.ndarray) -> np.ndarray:
    scaled = vecs / np.abs(vecs).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Block:
    """Some rows with their codes in every table, sorted."""

    def __init__(self, tables: Tables, rows: np.ndarray):
        self.tables, self.rows, self.size, self.codes = tables, rows, len(rows), []
        for t in range(TABLES):
            code = tables.code(tables.place(rows, t)[0], t)
            order = np.argsort(code)
            some = np.zeros(LOW + 1, bool)
            some[code & LOW] = True
            self.codes.append((code[order], order, some))

    def candidates(self, queries: np.ndarray, probes: int | None) -> np.ndarray:
        """(queries x rows) which rows some probe of some table finds; all if `probes` is None."""
        seen = np.full((len(queries), self.size), probes is None)
        for t in range(TABLES if probes else 0):
            code, order, some = self.codes[t]
            wanted = self.tables.probes(queries, t, probes)
            maybe = np.flatnonzero(some[wanted & LOW])  # most buckets that are asked for are empty in a block
            which, place = _found(code, wanted.ravel()[maybe, None])
            seen[maybe[which] // wanted.shape[1], order[place]] = True
        return seen


def _found(code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of every place of the sorted codes that holds one of the query's wanted codes."""
    lo, hi = np.searchsorted(code, wanted), np.searchsorted(code, wanted, "right")
    size = (hi - lo).ravel()
    stop = np.cumsum(size)
    row = np.repeat(np.repeat(np.arange(len(wanted)), wanted.shape[1]), size)
    return row, np.repeat(lo.ravel() - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def cosine(query: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they lie."""
    big, all_big = np.abs(query).max(), np.abs(vecs).max(1, keepdims=True)
    if 1e-100 < big < 1e100 and all_big.min() > 1e-100 and all_big.max() < 1e100:
        big, all_big = 1.0, 1.0
    q, v = query / big, vecs / all_big
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def nearest_of(query: np.ndarray, query_unit: np.ndarray, near: np.ndarray, vecs: np.ndarray, units: np.ndarray, ids: np.ndarray, k: int, products: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k of the rows `near` with the largest cosine, ties to the smaller id, best first.

    A product of unit vectors, taken here unless those of all rows are given, sets aside what is clearly farther; what is left
    is scored exactly."""
    if not len(near):
        return near, np.zeros(0)
    if len(near) > 4 * k:
        rough = units[near] @ query_unit if products is None else products[near]
        near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
    score = cosine(query, vecs[near])
    keep = blocks.k_largest(score, ids[near], k)
    return near[keep], score[keep]


def best(k: int, probes: int | None) -> blocks.Best:
    last = [None, None]  # a block and its rows: it meets one block of queries after another

    def select(q_ids, q_vecs, c_ids, c_vecs):
        if last[0] is None or not np.array_equal(last[0], c_vecs):
            last[:] = c_vecs.copy(), Block(Tables(c_vecs.shape[1]), unit(c_vecs))
        block, c_unit, q_unit = last[1], last[1].rows, unit(q_vecs)
        queries, found, values = [], [], []
        for at in range(0, len(q_ids), 64):
            some = q_unit[at : at + 64]
            seen, other = block.candidates(some, probes), c_ids != q_ids[at : at + 64, None]
            seen &= other
            few = seen.sum(1) < k
            seen[few] = other[few]
            products = some @ c_unit.T if seen.mean() > DENSE else None
            for i, row in enumerate(seen):
                keep, score = nearest_of(q_vecs[at + i], some[i], np.flatnonzero(row), c_vecs, c_unit, c_ids, k, None if products is None else products[i])
                queries.append(np.full(len(keep), at + i))
                found.append(keep)
                values.append(score)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *queries]), np.concatenate([empty, *found]), np.concatenate([np.zeros(0), *values])

    return select


def by_buckets(rows: DataFrame, is_query: Column, k: int, probes: int, hashes: int = HASHES) -> DataFrame:
    """(query_id, vec_id, score): for every query, the k best of each slot that its probes lead to, by joining the index.

    Slots are parts of a table's codes by remainder. A slot with many rows is dealt over parts by a hash of the id, and so
    are its queries; every part of rows meets every part of queries."""
    slots = max(1, -(-rows.count() // PER_SLOT))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, vecs in _by_dim(batch):
                tables, units = Tables(dim, hashes), unit(vecs)
                for t in range(TABLES):
                    code = tables.code(tables.place(units, t)[0], t)
                    yield _keyed(mine, dim, t, code % slots, pa.array(code), "code")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, vecs in _by_dim(batch):
                tables, units = Tables(dim, hashes), unit(vecs)
                for t in range(TABLES):
                    code = tables.probes(units, t, probes)
                    query = np.repeat(np.arange(len(code)), code.shape[1])
                    order = np.lexsort((code.ravel(), (code % slots).ravel(), query))
                    query, code = query[order], code.ravel()[order]
                    head = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(code % slots, prepend=-1) != 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(code)), pa.int32()), pa.array(code))
                    yield _keyed(mine.take(pa.array(query[head])), dim, t, code[head] % slots, lists, "codes")

    key = ["dim", "tab", "slot"]
    fields = "dim int, tab int, slot long, id long, vec array<double>"
    held = rows.mapInArrow(index, f"{fields}, code long")
    wanted = rows.where(is_query).mapInArrow(asked, f"{fields}, codes array<long>")
    parts = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / PER_PART).alias(name))
    split = durable(parts(held, "rows_in").join(parts(wanted, "queries_in"), key))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = held.join(split, key).withColumn("i", part("rows_in")).withColumn("j", each("queries_in")).select(*key, "i", "j", "id", "vec", "code")
    right = wanted.join(split, key).withColumn("j", part("queries_in")).withColumn("i", each("rows_in")).select(*key, "i", "j", "id", "vec", "codes")

    def meet(here: pa.Table, queries: pa.Table) -> pa.Table:
        ids, code = here.column("id").to_numpy(), here.column("code").to_numpy()
        out = [[], [], []]
        if len(ids) and queries.num_rows:
            order = np.argsort(code, kind="stable")
            ids, code, vecs = ids[order], code[order], _matrix(here.column("vec"))[order]
            units, asked_vecs = unit(vecs), _matrix(queries.column("vec"))
            asked_units = unit(asked_vecs)
            for q, (query, codes) in enumerate(zip(queries.column("id").to_pylist(), as_array(queries.column("codes")))):
                near = _found(code, codes.values.to_numpy()[None, :])[1]
                near = near[ids[near] != query]
                place, score = nearest_of(asked_vecs[q], asked_units[q], near, vecs, units, ids, k)
                for whole, more in zip(out, (np.full(len(place), query), ids[place], score)):
                    whole.append(more)
        columns = [np.concatenate([np.zeros(0), *x]) if n == 2 else np.concatenate([np.zeros(0, np.int64), *x]) for n, x in enumerate(out)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    grouped = [*key, "i", "j"]
    return left.groupBy(*grouped).cogroup(right.groupBy(*grouped)).applyInArrow(meet, "query_id long, vec_id long, score double").distinct()


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        mine = batch.filter(pa.array(dims == dim))
        yield dim, mine, _matrix(mine.column("vec"))


def _matrix(column) -> np.ndarray:
    column = as_array(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keyed(mine: pa.RecordBatch, dim: int, table: int, slot: np.ndarray, last: pa.Array, name: str) -> pa.RecordBatch:
    n = mine.num_rows
    columns = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(slot), mine.column("id"), mine.column("vec"), last]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "tab", "slot", "id", "vec", name])


def fit_probes(asked: np.ndarray, true: np.ndarray, sample: np.ndarray, hashes: int, target: float = TARGET) -> tuple[int | None, float]:
    """(the fewest probes that find `target` of the true neighbours, the share of rows they lead to); None if none do.

    asked: queries; true: (queries x k x dim) their neighbours; sample: rows that the share is measured on. All are unit
    vectors."""
    tables = Tables(sample.shape[1], hashes)
    needed = np.full(true.shape[:2], PROBES[-1])
    for t in range(TABLES):
        wanted = tables.probes(asked, t, PROBES[-1])
        own = tables.code(tables.place(true.reshape(-1, true.shape[2]), t)[0], t).reshape(needed.shape)
        same = wanted[:, None, :] == own[:, :, None]
        needed = np.minimum(needed, np.where(same.any(2), same.argmax(2), PROBES[-1]))
    for probes in PROBES:
        if (needed < probes).mean() >= target:
            return probes, float(Block(tables, sample).candidates(asked, probes).mean())
    return None, 1.0


def fitted(rows: DataFrame, k: int) -> tuple[int | None, float, int]:
    """(probes, share of rows, hashes) for these rows: the true neighbours of SAMPLE_QUERIES rows are looked up among all."""
    drawn = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(SAMPLE).select("dim", "id", "vec").toArrow()
    dims = drawn.column("dim").to_numpy()
    if not len(dims):
        return None, 1.0, HASHES
    common = int(np.bincount(dims).argmax())
    sample = drawn.filter(pa.array(dims == common))
    ids = sample.column("id").to_pylist()[:SAMPLE_QUERIES]
    alike = rows.where(F.col("dim") == common)
    near = blocks.search(alike, F.col("id").isin(ids), best(k, None), k, "double").orderBy("query_id", "rank").select("query_id", "vec_id").toArrow()
    # At most SAMPLE_QUERIES * k ids, so no join is needed, of which one side would have to be shuffled.
    held = alike.where(F.col("id").isin(near.column("vec_id").unique().to_pylist())).dropDuplicates(["id"]).select("id", "vec").toArrow()
    at = {x: i for i, x in enumerate(held.column("id").to_pylist())}
    vecs = unit(_matrix(held.column("vec")))[[at[x] for x in near.column("vec_id").to_pylist()]] if near.num_rows else np.zeros((0, common))
    queries, first, many = np.unique(near.column("query_id").to_numpy(), return_index=True, return_counts=True)
    full = many == k
    if not full.any():
        return None, 1.0, HASHES
    z = unit(_matrix(sample.column("vec")))
    place = {x: i for i, x in enumerate(ids)}
    asked = z[[place[q] for q in queries[full].tolist()]]
    true = np.stack([vecs[at : at + k] for at in first[full].tolist()])
    hashes = hashes_for(rows.count())
    probes, share = fit_probes(asked, true, z, hashes)
    if hashes > HASHES and (probes is None or share > SELECTIVE):
        hashes = HASHES
        probes, share = fit_probes(asked, true, z, hashes)
    return probes, share, hashes


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, joined: bool | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query`, an expression of `id`, holds.

    Unless `probes` is given it is fitted, with SAMPLE_QUERIES rows chosen by a hash of their ids, and so is, unless `joined`
    is given, whether the index is joined or blocks meet."""
    rows = blocks.usable(vectors, id_col, vec_col, True)
    share, hashes = 1.0, HASHES
    if probes is None:
        probes, share, hashes = fitted(rows, k)
    if not (share <= SELECTIVE if joined is None else joined) or probes is None:
        return blocks.search(rows, is_query, best(k, probes), k, "double")
    found = durable(by_buckets(rows, is_query, k, probes, hashes))
    # Queries that found fewer than k rows: against all rows.
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = rows.where(is_query).select("id").distinct().join(enough, "id", "left_anti")
    if not short.isEmpty():
        lone = rows.join(short.withColumn("lone", F.lit(True)), "id", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
        whole = blocks.search(lone, F.col("lone"), best(k, None), k, "double").select("query_id", "vec_id", "score")
        found = found.union(whole).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
