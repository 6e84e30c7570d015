"""A stated set of query vectors against all vectors, in blocks.

Candidates are gathered, within their partitions, into blocks of bounded size; queries are dealt into blocks by a hash.
Every query block meets every candidate block in an equi-join on a salt: candidate blocks are dealt over the salts, query
blocks are copied to each, and there are no more salts than blocks or tasks to fill. Copies are shuffled and merged, never
broadcast: Spark guesses their size from that of the queries, and all of them would go through the driver. A pair of blocks
gives each query's best few, and those are merged by a window whose first step runs before the shuffle. No row is tied to a
key of the data, so a vector that many rows share makes no task longer.

Vectors of another dimension than the query's are no candidates for it. Null vectors, vectors with null or non-finite
components, and rows without id take no part. An empty table, or no query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_array

QUERY_ROWS, CANDIDATE_BYTES = 512, 1 << 22


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, vec as array<double>, dim) of the rows that take part."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & vec.isNotNull() & (F.size("vec") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists(vec, lambda x: x != 0))
    return rows.withColumn("dim", F.size("vec"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = as_array(column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def candidate_blocks(rows: DataFrame, salts: int) -> DataFrame:
    """(dim, salt, ids, vecs): blocks as the bytes of int64 and float64 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: dict[int, list] = {}
        made = TaskContext.get().partitionId()

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal made
            held = waiting.pop(dim)
            made += 1
            ids, vecs = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            values = ([dim], [made % salts], [ids.astype("<i8").tobytes()], [vecs.astype("<f8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["dim", "salt", "ids", "vecs"])

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                most = max(1, CANDIDATE_BYTES // (8 * dim))
                for at in range(0, mine.num_rows, most):
                    part = mine.slice(at, most)
                    held = waiting.setdefault(dim, [])
                    if sum(len(h[0]) for h in held) + part.num_rows > most and held:
                        yield emit(dim)
                        held = waiting.setdefault(dim, [])
                    held.append((part.column(0).to_numpy(), _matrix(part.column(1), dim)))
        for dim in list(waiting):
            yield emit(dim)

    return rows.mapInArrow(run, "dim int, salt int, ids binary, vecs binary")


def query_blocks(rows: DataFrame, salts: int) -> DataFrame:
    """(dim, salt, q_ids, q_vecs), each block once for every salt."""
    blocks = -(-max(1, rows.count()) // QUERY_ROWS)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    gathered = rows.groupBy("dim", block).agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("q"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    return gathered.select("dim", copies, F.col("q.id").alias("q_ids"), F.col("q.vec").alias("q_vecs"))


def salts_for(rows: DataFrame) -> int:
    """As many as there are full blocks of candidates, but enough to keep all cores busy, and no more than shuffles have parts."""
    spark = rows.sparkSession
    full = rows.groupBy("dim").count().agg(F.sum(F.ceil(F.col("count") * F.col("dim") * 8 / CANDIDATE_BYTES))).first()[0]
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(int(full or 0), 2 * spark.sparkContext.defaultParallelism)))


Best = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(rows: DataFrame, is_query: Column, best: Best, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score), rank from 1, best first, ties to the smaller id.

    `best(query ids, query vectors, candidate ids, candidate vectors)` gives (query position, candidate position, score)
    of the k best of each query in a pair of blocks, without the query itself."""
    salts = salts_for(rows)
    candidates, queries = (side.repartition(salts, "dim", "salt") for side in (candidate_blocks(rows, salts), query_blocks(rows.where(is_query), salts)))
    pairs = candidates.join(queries.hint("merge"), ["dim", "salt"])
    score_arrow = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                c_ids = np.frombuffer(batch.column(1)[i].as_buffer(), "<i8")
                c_vecs = np.frombuffer(batch.column(2)[i].as_buffer(), "<f8").reshape(-1, dim)
                q_ids = batch.column(3).slice(i, 1).flatten().to_numpy()
                q_vecs = batch.column(4).slice(i, 1).flatten().flatten().to_numpy().reshape(-1, dim)
                q, c, score = best(q_ids, q_vecs, c_ids, c_vecs)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(c_ids[c]), pa.array(score, score_arrow)], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "vecs", "q_ids", "q_vecs").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def k_largest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, best first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        tied = np.flatnonzero(score == least)
        if len(tied) > k - len(above):
            tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]
        keep = np.concatenate([above, tied])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))]
