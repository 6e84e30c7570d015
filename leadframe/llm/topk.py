"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are integers: floor(1024 * x) of each component. In a pair of blocks every dimension is a term with its postings,
the candidates whose weight there isn't zero. The queries' non-zero weights are taken term by term; each scatters its
products with the postings into dense score arrays, one per query; where hardly a weight is zero, the term's whole column is
taken. Arrays are tiles that fit a core's cache. Then the k best are selected, and blocks are merged.

Scores are exact, in 32 bits where no sum can be larger, else in 64; where weights are so large that 64 bits might not hold,
sums are taken in Python integers and what lies outside is set to the nearest 64-bit number. Other defined cases are those of blocks.py; a zero vector takes part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from . import blocks

SCALE = 1024
#: Queries and candidates of a tile.
TILE = 32, 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def weights(vecs: np.ndarray) -> np.ndarray:
    whole = np.floor(SCALE * vecs)
    if np.abs(whole).max(initial=0) < 2.0**62:
        return whole.astype(np.int64)
    return np.array([[int(x) for x in row] for row in whole], object)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """(queries x candidates) inner products, term at a time."""
    top = [int(np.abs(x).max(initial=0)) for x in (queries, candidates)]
    most = top[0] * top[1] * queries.shape[1]
    exact = np.int32 if most < 1 << 31 else np.int64 if most < MOST else object
    by_term = [np.ascontiguousarray(x.T, exact) for x in (queries, candidates)]
    scores = np.zeros((len(queries), len(candidates)), exact)
    for a in range(0, len(queries), TILE[0]):
        for b in range(0, len(candidates), TILE[1]):
            _add(*(x[:, at : at + size] for x, at, size in zip(by_term, (a, b), TILE)), scores[a : a + TILE[0], b : b + TILE[1]])
    return scores


def _add(queries: np.ndarray, candidates: np.ndarray, scores: np.ndarray) -> None:
    """Adds the products of all terms, which are rows here, to `scores`."""
    asks, posts = np.count_nonzero(queries, axis=1).tolist(), np.count_nonzero(candidates, axis=1).tolist()
    total, product = np.zeros(scores.shape, scores.dtype), np.empty(scores.shape, scores.dtype)
    for q, c, asking, posting in zip(queries, candidates, asks, posts):
        if 2 * asking > len(q) and 2 * posting > len(c):
            np.multiply(q[:, None], c, out=product)
            np.add(total, product, out=total)
        elif asking and posting:
            asking, posting = np.flatnonzero(q), np.flatnonzero(c)
            total[np.ix_(asking, posting)] += q[asking, None] * c[posting]
    scores[...] = total


def best(k: int) -> blocks.Best:
    def select(q_ids, q_vecs, c_ids, c_vecs):
        q_weights, c_weights = weights(q_vecs), weights(c_vecs)
        queries, found, values = [], [], []
        for at in range(0, len(q_ids), 256):
            scores = accumulate(q_weights[at : at + 256], c_weights)
            for i, row in enumerate(scores):
                others = np.flatnonzero(c_ids != q_ids[at + i])
                if row.dtype == object:
                    row = np.clip(row, LEAST, MOST).astype(np.int64)
                keep = others[blocks.k_largest(row[others], c_ids[others], k)] if len(others) < len(row) else blocks.k_largest(row, c_ids, k)
                queries.append(np.full(len(keep), at + i))
                found.append(keep)
                values.append(row[keep])
        return np.concatenate(queries), np.concatenate(found), np.concatenate(values)

    return select


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query`, an expression of `id`, holds."""
    return blocks.search(blocks.usable(vectors, id_col, vec_col, False), is_query, best(k), k, "long")
