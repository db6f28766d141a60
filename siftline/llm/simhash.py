"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at `radius` or fewer differing bits. Their 64 bits are dealt into partitions, bits that
agree often into the same one. Thresholds t_i with sum t_i = radius - partitions + 1 make sure that any two
that link agree within t_i bits in some partition i: were all partitions to differ by t_i + 1 or more, they
would differ by radius + 1 bits. Dynamic programming picks the thresholds (-1 leaves a partition out), and the
number of partitions, of least estimated candidate count. A fingerprint is then put under each value within
t_i bits of its own in partition i, and those that meet under a value are verified.

Under a value that very many share, pairs are not formed: within `radius` 2, two fingerprints link just when
some 64-bit value lies within one bit of both, so each is put under its 65 such values, and the 65 at most
that meet there all link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_scope
from .components import components
from .fingerprints import add_fingerprint

BITS, WORDS, RADIUS = 64, 3, 2
#: Fingerprints that meet under one value are paired up to this many; above, they go through their midpoints.
PAIRED = 64
#: What a key costs next to verifying a candidate pair.
KEY_COST = 4
#: Fewer fingerprints are planned for as so many.
LEAST = 1000


def flips(bits: list[int], within: int) -> list[int]:
    """Signed masks of at most `within` of these bits."""
    return [int(np.uint64(sum(1 << b for b in c)).view("int64")) if c else 0 for n in range(within + 1) for c in combinations(bits, n)]


def signed(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], "u8").view("i8")[0])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, the share with each bit set, and how strongly each two bits correlate: 64 + 64 x 64 sums."""
    def sums(batches):
        import pyarrow as pa

        n, ones, pairs = 0, np.zeros(BITS), np.zeros((BITS, BITS))
        for batch in batches:
            b = np.unpackbits(batch.column(0).to_numpy().view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("float32")
            for a in range(0, len(b), 1 << 20):
                n, ones, pairs = n + len(b[a : a + (1 << 20)]), ones + b[a : a + (1 << 20)].sum(axis=0, dtype="f8"), pairs + (b[a : a + (1 << 20)].T @ b[a : a + (1 << 20)])
        flat = np.concatenate([[n], ones, pairs.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="i4")), pa.array(flat)], ["i", "x"])

    total = np.zeros(1 + BITS + BITS * BITS)
    for i, x in fps.select("fp").mapInArrow(sums, "i int, x double").groupBy("i").sum("x").collect():
        total[i] = x
    n = max(total[0], 1)
    p, pair = total[1 : 1 + BITS] / n, total[1 + BITS :].reshape(BITS, BITS) / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    return int(total[0]), p, np.abs(pair - np.outer(p, p)) / spread


def partition_bits(correlation: np.ndarray, count: int) -> list[list[int]]:
    """Parts of equal size to within one bit; each grows from the strongest pair left by the bit that goes best with it."""
    left, parts = set(range(BITS)), []
    for i in range(count):
        size = len(left) // (count - i)
        rest = sorted(left)
        sub = correlation[np.ix_(rest, rest)] - 2 * np.eye(len(rest))
        part = [rest[int(np.argmax(sub.max(axis=1)))]]
        while len(part) < size:
            rest = sorted(left - set(part))
            part.append(rest[int(np.argmax(correlation[np.ix_(rest, part)].sum(axis=1)))])
        parts.append(sorted(part))
        left -= set(part)
    return parts


def agreement(p: np.ndarray, bits: list[int], within: int) -> float:
    """Estimated share of pairs that differ by at most `within` of these bits."""
    chance = np.zeros(within + 1)
    chance[0] = 1
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        chance = chance * (1 - differ) + np.r_[0, chance[:-1]] * differ
    return float(chance.sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that add up to `total` at least cost; costs[i][t + 1] for thresholds from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, more in enumerate(row, -1):
                if have + t not in step or cost + more < step[have + t][0]:
                    step[have + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def plan(n: int, p: np.ndarray, correlation: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, over the number of partitions that costs least."""
    best = (float("inf"), [])
    for count in range(1, radius + 3):
        parts = partition_bits(correlation, count)
        costs = []
        for part in parts:
            row = [0.0]
            for t in range(radius + 1):
                keys = len(flips(part, t))
                row.append(KEY_COST * n * keys + n * n / 2 * agreement(p, part, min(2 * t, len(part))))
            costs.append(row)
        cost, chosen = allocate(costs, radius - count + 1)
        if cost < best[0]:
            best = (cost, [(part, t) for part, t in zip(parts, chosen) if t >= 0])
    return best[1]


def under(fp: Column, masks: list[int]) -> Column:
    return F.array(*[fp.bitwiseXOR(F.lit(m)) if m else fp for m in masks])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: enough links between the distinct fingerprints of (fp) that all within `radius` (2 at most) are connected by them."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0 to 2")
    n, p, correlation = bit_statistics(fps)
    keys = None
    for i, (part, t) in enumerate(plan(max(n, LEAST), p, correlation, radius)):
        own = fps.select("fp", F.lit(i).alias("part"), F.explode(under(F.col("fp").bitwiseAND(F.lit(signed(part))), flips(part, t))).alias("value"))
        keys = own if keys is None else keys.union(own)
    if keys is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    counts = materialize(keys.groupBy("part", "value").count().where("count > 1"), "values")
    # Grouped by a hash of the value, so that Spark may split a join on values that very many share; values that meet by chance only add pairs to verify.
    some = keys.join(counts.where(F.col("count") <= PAIRED), ["part", "value"]).groupBy(F.xxhash64("part", "value")).agg(F.collect_set("fp").alias("g"))
    first = some.select("g", F.explode("g").alias("a"))
    paired = first.select("a", F.explode(F.filter("g", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= radius))).alias("b"))
    many = keys.join(counts.where(F.col("count") > PAIRED), ["part", "value"]).select("fp").distinct()
    if radius == 2:
        met = many.select("fp", F.explode(under(F.col("fp"), flips(list(range(BITS)), 1))).alias("value"))
        star = met.groupBy("value").agg(F.collect_set("fp").alias("g"), F.min("fp").alias("a")).where(F.size("g") > 1)
        starred = star.select("a", F.explode("g").alias("b")).where("a < b")
    else:
        # Within one bit: a neighbour is one of 64 values.
        met = many.select(F.col("fp").alias("a"), F.explode(under(F.col("fp"), flips(list(range(BITS)), radius))).alias("b"))
        starred = met.join(many.select(F.col("fp").alias("b")), "b").select("a", "b").where("a < b")
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: key, fp (signed long), component_id, the smallest key that it reaches over links.

    Rows with one fingerprint link, those without words (null and empty texts) among them. A null key is a row
    like any other, and is the component_id only where every key of the component is null. Repeated rows come
    back as often. Texts of any length are read whole. Other columns are ignored; an empty table gives no rows.
    """
    with scratch_scope(docs.sparkSession) as keep:
        rows = keep(materialize(add_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words), "fingerprints"))
        fps = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
        label = components(links(fps.select("fp"), radius))
        of = keep(materialize(fps.join(label, fps["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root")), "roots"))
        least = keep(materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "least"))
    classes = of.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")
