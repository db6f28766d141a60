"""Nearest neighbours by largest inner product: a block matrix join of int8 tiles with error bounds.

Each vector is scaled to int8. Integer products of a tile (exact in float32 up to 1,024 components) give every
inner product with a bound on its quantisation error. A candidate whose upper bound reaches the k-th largest
lower bound of its query survives; survivors are recomputed from the original vectors in double precision,
and heaps merge the tiles' lists. No candidate is lost, so recall is 1.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import search

#: Queries of a tile that are compared at a time.
STEP = 256


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, for its fast products), the scale of each row, and the sum of |value| x scale."""
    scale = np.abs(m).max(axis=1) / 127
    scale[scale == 0] = 1e-300
    q = np.rint(m / scale[:, None]).astype("int8")
    return q.astype("float32"), scale, np.abs(q.astype("int64")).sum(axis=1) * scale


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in order; in a wider format where that overflows, so that a result is infinite at worst."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        beyond = ~np.isfinite(total)
        if beyond.any():
            total[beyond] = (a[beyond].astype(np.longdouble) * b[beyond].astype(np.longdouble)).sum(axis=1).astype("float64")
    return total


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 matrices held as float32; strips of 1,024 components keep each sum below 2 ** 24."""
    return sum((a[:, j : j + 1024] @ b[:, j : j + 1024].T).astype("float64") for j in range(0, a.shape[1], 1024))


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Equal vectors tie in every query: one stands for the first k + 1 of them, as ids ascend.
    _, first, of = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[order], np.arange(len(first)))
    copies = np.minimum(np.diff(np.r_[begins, len(order)]), k + 1)
    own = matrix[first]
    q, q_scale, q_sum = quantised(queries)
    c, c_scale, c_sum = quantised(own)
    dim, out = matrix.shape[1], []
    for a in range(0, len(queries), STEP):
        b = slice(a, a + STEP)
        with np.errstate(over="ignore", invalid="ignore"):
            about = integer_products(q[b], c) * q_scale[b, None] * c_scale
            bound = 0.5 * (q_sum[b, None] * c_scale + q_scale[b, None] * c_sum) + 0.25 * dim * q_scale[b, None] * c_scale
            bound = bound * 1.000001 + 1e-9 * np.abs(about) + 1e-300
            # What overflows has no bounds, so it survives.
            low, high = np.nan_to_num(about - bound, nan=-np.inf, neginf=-np.inf), np.nan_to_num(about + bound, nan=np.inf, posinf=np.inf)
        low[~np.isfinite(high)] = -np.inf
        # The query's own row may be among the best, hence k + 1.
        if about.shape[1] > k + 1:
            least = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)]
            row, column = np.nonzero(high >= least[:, None])
        else:
            row, column = (x.ravel() for x in np.indices(about.shape))
        scores = dot(queries[b][row], own[column])
        n = copies[column]
        at = np.repeat(begins[column], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found, asked = ids[order[at]], np.repeat(query_ids[b][row], n)
        other = found != asked
        out.append((asked[other], found[other], np.repeat(scores, n)[other]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.array([], "int64"), np.array([], "int64"), np.array([], "float64"))


def merge(lists: list[list[tuple]], k: int) -> list[tuple]:
    return list(islice(heapq.merge(*lists), k))


def nearest(vectors: DataFrame, k: int = 20, queries: Column | None = None, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) for the stated queries, over column id; by default every 20th id.

    Null ids and vectors that are null, empty, zero or hold a null or non-finite component take no part.
    Rows that repeat an id count once, with the smallest of their vectors; ties go to the smaller id;
    fewer than k candidates are all returned; vectors meet those of their own length. Other columns are ignored.
    """
    queries = F.col("id") % 20 == 0 if queries is None else queries
    return search(vectors, queries, k, tile, merge, "double", nonzero=True, **how)
