"""Tiles of a stated query set against all rows: the scaffolding of both vector searches.

Vectors are dealt by a hash of their id into blocks of about `rows` vectors, each one row that holds ids and
a matrix as bytes. Every block of queries meets every block of candidates in one task, a tile; memory is that
of a tile, and what leaves a tile is k rows a query at most. The query set is what the caller states; the
work is queries x rows, as exact search is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

QUERY_ROWS, ROWS = 1024, 8192
#: Tops of so many tiles meet in one merge.
FAN_IN = 16


def usable(vectors: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id, v): one row for each id, without null ids and null, empty, or non-finite vectors. Of rows with one id the smallest vector stays."""
    # Single precision stays what it is; the rest becomes double.
    kind = vectors.select(F.col(vector)).schema[0].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    rows = rows.where(F.exists(v, lambda x: x != 0)) if nonzero else rows
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def largest(rows: DataFrame) -> int:
    """How many rows have vectors of the most frequent length."""
    return rows.groupBy(F.size("v")).count().agg(F.max("count")).first()[0] or 0


def blocks_of(rows: DataFrame, size: int, encode: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> tuple[DataFrame, int]:
    """(block, dim, ids, matrix): ids ascend within a block; vectors of different lengths are in different blocks."""
    n = max(1, -(-largest(rows) // size))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        matrix = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table({"block": [key[0]], "dim": [key[1]], "ids": [t["id"].to_numpy().astype("<i8").tobytes()], "matrix": [encode(matrix.reshape(t.num_rows, -1))]}, schema=pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]))

    packed = rows.withColumn("block", block).withColumn("dim", F.size("v")).groupBy("block", "dim").applyInArrow(pack, "block int, dim int, ids binary, matrix binary")
    return packed, n


def unpack(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int, tile: Callable, merge: Callable, score: str, nonzero: bool = False, key: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which `queries`, over column id, holds.

    tile(query ids, query matrix, ids, matrix, k) returns arrays (query id, id, score) with at least the k best
    of that tile; merge(tops, k) makes one list of several, each a list of (-score, id).
    """
    good = materialize(usable(vectors, key, vector, nonzero), "vectors")
    base, n = blocks_of(good, rows)
    asked, _ = blocks_of(good.where(queries), query_rows)
    kind = "double" if score == "double" else "long"
    # Each block of queries goes to every block of candidates.
    sent = asked.select(F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    pairs = sent.join(base, ["block", "dim"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                query, found, scores = tile(*unpack(r["query_ids"], r["query_matrix"], r["dim"]), *unpack(r["ids"], r["matrix"], r["dim"]), k)
                # Best first by query, and then k rows of each.
                order = np.lexsort((found, -scores, query))
                query, found, scores = query[order], found[order], scores[order]
                starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], int)
                place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), r["query_block"], "int32")), pa.array(np.full(keep.sum(), r["block"], "int32")), pa.array(query[keep]), pa.array(found[keep]), pa.array(scores[keep])], ["query_block", "block", "query_id", "vec_id", "score"])

    tops = pairs.select("query_block", "block", "dim", "query_ids", "query_matrix", "ids", "matrix").mapInArrow(tiles, f"query_block int, block int, query_id long, vec_id long, score {kind}")

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, own in part.groupby("query_id", sort=False):
            lists = [list(zip((-t["score"]).tolist(), t["vec_id"].tolist())) for _, t in own.groupby("from", sort=False)]
            out += [(query, rank, vec, -minus) for rank, (minus, vec) in enumerate(merge(lists, k), 1)]
        got = pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        return got.assign(query_block=part["query_block"].iat[0], block=part["to"].iat[0], query_id=got["query_id"].astype("int64"), rank=got["rank"].astype("int32"), vec_id=got["vec_id"].astype("int64"))[["query_block", "block", "query_id", "rank", "vec_id", "score"]]

    # A tree: FAN_IN tiles of a block of queries at a time, until one list a query is left.
    while True:
        parts = -(-n // FAN_IN)
        level = tops.withColumn("to", (F.col("block") / FAN_IN).cast("int")).withColumn("from", F.col("block"))
        # Part of the query keeps a merge small, whatever the block of queries holds.
        group = level.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(8)))
        tops = group.groupBy("query_block", "to", "part").applyInPandas(merged, f"query_block int, block int, query_id long, rank int, vec_id long, score {kind}")
        if parts == 1:
            return tops.select("query_id", "rank", "vec_id", "score")
        n = parts
