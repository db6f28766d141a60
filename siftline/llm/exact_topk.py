"""Exact top-k search by integer inner product: tiled products, partial selection in a tile, a tree of merges.

Scaled components travel as 16-bit integers where they fit. Queries come in groups, candidates in parts; one task
holds a group of queries and what is best for each so far, and a part's blocks pass by it, one after another. So
candidates are sent once for each group, queries once for each part, and k rows leave for each query and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import FAN_IN, QUERY_ROWS, ROWS, blocks_of, usable
from .common import bounded_batches, materialize

STEP = 256
SCALE = 1024
#: Blocks of queries that a task holds.
GROUP = 64
NEVER = np.iinfo("int64").min
TOPS = "query_block int, block int, query_id long, vec_id long, score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in double precision where no sum can pass 2 ** 53, else in 64-bit integers, or in unbounded ones that then have to fit."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype("int64")
    if most < 2.0**62:
        return a.astype("int64") @ b.astype("int64").T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    if exact.size and max(-exact.min() - 1, exact.max()) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype("int64")


def encode(matrix: np.ndarray) -> bytes:
    """Scaled components as 16-bit integers, or as doubles where one doesn't fit."""
    with np.errstate(over="ignore"):
        m = np.floor(SCALE * matrix)
    if not np.isfinite(m).all():
        raise OverflowError("a component does not fit a double after scaling")
    return m.astype("<i2" if m.size and -(2**15) <= m.min() and m.max() < 2**15 else "<f8").tobytes()


def decode(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and components as floats, of single precision where they came as 16-bit integers."""
    ids = np.frombuffer(ids, "<i8")
    short = len(matrix) == 2 * dim * len(ids)
    return ids, np.frombuffer(matrix, "<i2").astype("f4").reshape(-1, dim) if short else np.frombuffer(matrix, "<f8").reshape(-1, dim)


def norm(m: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", m, m, dtype="f8").max(initial=0)))


class Best:
    """The k best candidates so far of each of some queries."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def ask(self, block: int, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.parts.append((np.full(len(ids), block, "i4"), ids, matrix))

    def begin(self) -> None:
        blocks, ids, matrices = zip(*self.parts)
        self.parts, self.blocks, self.ids, self.queries = [], np.concatenate(blocks), np.concatenate(ids), np.concatenate(matrices)
        shape = (len(self.ids), self.k)
        self.norm, self.score, self.found, self.there = norm(self.queries), np.full(shape, NEVER), np.zeros(shape, "i8"), np.zeros(shape, bool)

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        # By Cauchy and Schwarz no partial sum is larger, so single precision adds such integers exactly.
        single = self.queries.dtype == matrix.dtype == np.float32 and self.norm * norm(matrix) * 1.000001 < 2**24
        for a in range(0, len(self.ids), STEP):
            q = self.queries[a : a + STEP]
            scores = q @ matrix.T if single else products(q.astype("f8"), matrix.astype("f8"))
            least = self.score[a : a + STEP, -1].astype(scores.dtype)
            keep = scores >= least[:, None]
            # One more than k, as a query may meet itself.
            n = min(self.k + 1, len(ids))
            if np.count_nonzero(keep) > 8 * n * len(q):
                least = np.maximum(least, np.partition(scores, -n, axis=1)[:, -n])
                level = scores == least[:, None]
                # Of those level with the last place the first n stay, as ids ascend.
                keep = (scores > least[:, None]) | (level & (np.cumsum(level, axis=1, dtype="i4") <= n))
            row, column = np.nonzero(keep)
            other = ids[column] != self.ids[a + row]
            if other.any():
                row, column = row[other], column[other]
                self.take(a + row, ids[column], scores[row, column].astype("i8"))

    def take(self, row: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(row)
        old = self.there[rows]
        row = np.r_[np.repeat(rows, old.sum(axis=1)), row]
        found, score = np.r_[self.found[rows][old], found], np.r_[self.score[rows][old], score]
        row, found, score, place = first(row, found, score, self.k)
        self.there[row, place], self.found[row, place], self.score[row, place] = True, found, score

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        row, place = np.nonzero(self.there)
        for a in range(0, len(row), 1 << 16):
            r, p = row[a : a + (1 << 16)], place[a : a + (1 << 16)]
            yield self.blocks[r], self.ids[r], self.found[r, p], self.score[r, p]


def first(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first, with their places from 0; ties go to the smaller id."""
    order = np.lexsort((found, ~score, query))
    query, found, score = query[order], found[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k
    return query[keep], found[keep], score[keep], place[keep]


def tops_of(asked: DataFrame, groups: int, base: DataFrame, parts: int, tasks: int, k: int) -> DataFrame:
    """TOPS: the k best of each query in each part of the candidates, numbered by `block`."""
    left = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), (F.col("block") / GROUP).cast("int").alias("group"), "dim", F.lit(0).alias("side"), "block", "ids", "matrix")
    right = base.select(F.pmod("block", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", F.lit(1).alias("side"), "block", "ids", "matrix")
    met = left.union(right).repartition(tasks, "part", "group", "dim").sortWithinPartitions("part", "group", "dim", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for blocks, query, found, score in best.rows() if best and not best.parts else ():
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(query), key[0], "i4")), pa.array(query), pa.array(found), pa.array(score)], ["query_block", "block", "query_id", "vec_id", "score"])

        key = best = None
        for batch in batches:
            part, group, dim, side, block, ids, matrix = batch.columns
            for i in range(batch.num_rows):
                now = part[i].as_py(), group[i].as_py(), dim[i].as_py()
                if now != key:
                    yield from out()
                    key, best = now, Best(k)
                own = decode(ids[i].as_buffer(), matrix[i].as_buffer(), now[2])
                if side[i].as_py() == 0:
                    best.ask(block[i].as_py(), *own)
                    continue
                if best.parts:
                    best.begin()
                if hasattr(best, "ids"):  # else nothing asks for vectors of this length
                    best.meet(*own)
        yield from out()

    return met.mapInArrow(run, TOPS)


def exact_topk(vectors: DataFrame, k: int = 10, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the stated queries, over column id; by default every 100th id.

    A component x counts as floor(1024 x). Null ids and vectors that are null, empty or hold a null or
    non-finite component take no part; zero vectors do. Rows that repeat an id count once, with the smallest
    of their vectors; ties go to the smaller id; fewer than k candidates are all returned; vectors meet those
    of their own length. A score that does not fit 64 bits is an error. Other columns are ignored.
    """
    queries = F.col("id") % 100 == 0 if queries is None else queries
    good = materialize(usable(vectors, key, vector, False), "vectors")
    base, n = blocks_of(good, rows, encode)
    asked, m = blocks_of(good.where(queries), query_rows, encode)
    tasks, groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m // GROUP)
    parts = min(n, max(1, tasks // groups))
    tops = tops_of(bounded_batches(asked), groups, base, parts, tasks, k)

    def merged(t: pa.Table) -> pa.Table:
        query, found, score, place = first(*(t[c].to_numpy() for c in ("query_id", "vec_id", "score")), k)
        return pa.table({"query_block": pa.array(np.full(len(query), t["query_block"][0].as_py(), "i4")), "block": pa.array(np.full(len(query), t["to"][0].as_py(), "i4")), "query_id": query, "rank": pa.array((place + 1).astype("i4")), "vec_id": found, "score": score})

    # A tree: FAN_IN parts of a block of queries at a time, until one list a query is left.
    while True:
        level = tops.withColumn("to", (F.col("block") / FAN_IN).cast("int"))
        tops = level.groupBy("query_block", "to").applyInArrow(merged, "query_block int, block int, query_id long, rank int, vec_id long, score long")
        if parts <= FAN_IN:
            return tops.select("query_id", "rank", "vec_id", "score")
        parts = -(-parts // FAN_IN)
        tops = tops.drop("rank")
