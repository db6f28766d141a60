"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts form an atomic group. Groups lie in the order of a 64-bit hash of their text, cut into
65,536 units by its upper 16 bits, so what is atomic never spans units and the driver holds at most
65,536 sizes, however large the table. Over these ordered sizes the smallest feasible capacity of a
shard is found by binary search with a greedy check; the cuts then lie as near to equal sizes as that
capacity allows. One scan reads the texts; all else runs on a digest of a few bytes a row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

UNIT_BITS = 16
OVERHEAD = 16


def fits(ends: list[int], shards: int, capacity: int) -> bool:
    """Whether greedy filling needs at most so many shards; ends: running totals of the ordered sizes."""
    at, done = 0, 0
    for _ in range(shards):
        done = bisect_right(ends, at + capacity)
        if done == len(ends):
            return True
        at = ends[done - 1] if done else 0
    return False


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and for each shard but the first the index of its first size.

    Shards may be empty where there are fewer sizes than shards. No sizes: capacity 0, all cuts 0.
    """
    if not sizes:
        return 0, [0] * (shards - 1)
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(ends, shards, middle) else (middle + 1, high)
    # The earliest start from which the last k shards can still take all that follows.
    earliest, start = [], len(sizes)
    for _ in range(shards):
        earliest.append(start)
        before = ends[-1] - low if start == len(sizes) else ends[start - 1] - low if start else 0
        start = 0 if before <= 0 else bisect_left(ends, before) + 1
    cuts, at, done = [], 0, 0
    for left in range(shards - 1, 0, -1):
        least, most = max(earliest[left], done), max(done, bisect_right(ends, at + low))
        goal = at + (ends[-1] - at) / (left + 1)
        cut = bisect_left(ends, goal)
        over = ends[cut] - goal if cut < len(ends) else float("inf")
        cut = cut + 1 if over < goal - (ends[cut - 1] if cut else 0) else cut
        done = min(max(cut, least), most)
        at = ends[done - 1] if done else 0
        cuts.append(done)
    return low, cuts


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Put every row into a shard: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16. A null text counts as empty and shares its group. Rows with
    equal texts, repeated rows and null keys among them, share a shard; each row takes a slot of its own.
    An empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digest = materialize(docs.select(
        F.col(key), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - UNIT_BITS).cast("int").alias("_unit"),
    ), "digest")
    units = sorted(digest.groupBy("_unit").agg(F.sum("size"), F.count("*")).collect())
    _, cuts = minimax_cuts([u[1] for u in units], shards)
    starts = [units[c][0] if c < len(units) else 1 << UNIT_BITS for c in cuts]
    shard = reduce(lambda a, b: a + b, [(F.col("_unit") >= s).cast("int") for s in starts], F.lit(0))
    ranked = gapless_rank(digest.withColumn("shard", shard), sum(u[2] for u in units), "shard", "_unit", [key, "size", "text_crc32"], "slot")
    return ranked.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
