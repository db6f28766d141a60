"""Near-duplicate documents by SimHash fingerprints, verified on their word shingles.

First the 64-bit fingerprints of whole texts go through the generalised pigeonhole of simhash.py: thresholds by
dynamic programming over estimated candidates, at two differing bits. What it links is verified on the shingles.

Documents of similarity 0.8 differ in too many of 64 bits for any cheap probe, so wide fingerprints find the others. For them a document's distinct shingles
are dealt by hash into classes of a few, and each class has a 64-bit SimHash of its own; together they are one wide
fingerprint. Bits of one class depend on the same shingles, so each class is one partition of the generalised
pigeonhole: an edit changes few classes, and the rest agree in all bits. A probed class has threshold 0, all others
-1. How many to probe follows from the similarity: with `probes` classes of s shingles a pair of similarity j
misses all with probability (1 - j ** s) ** probes. Whatever meets is verified on the shingles themselves.

Equal sets of shingles are one representative from the start. A value that few share gives pairs. Of a value that
more share no pairs are formed: each member is first compared with one other, which links most copies, and then
every two members that are not linked yet are compared, in tiles of two blocks of bounded size. A tile gives only
links that join something. No two that share a value are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, materialize, scratch_scope
from .components import components
from .fingerprints import hashes, majority, shingles
from .simhash import links as pigeonhole
from .words import forget

WORDS, SIMILARITY, PROBES = 5, 0.8, 12
#: Shingles a class holds on average, at least; members of one value that are paired, others are compared in tiles.
CLASS, PAIRED = 3, 32
#: A tile's block holds about so many members, and so many shingles or one member. Columns multiplied at a time.
BLOCK, BLOCK_SHINGLES, STEP = 256, 1 << 17, 1 << 12
BLOCKS = pa.schema([("value", pa.int64()), ("block", pa.int32()), ("mains", pa.int32()), ("others", pa.int32()), ("labels", pa.binary()), ("ends", pa.binary()), ("sets", pa.binary())])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(hashes(shingles((text or "").encode(), words)))


def probed_values(hashes: np.ndarray, probes: int) -> list[int]:
    """The values of a set's probed classes, at its own number of classes and at twice as many, so that sets of like size share one."""
    out = []
    spread = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    level = max(0, (len(hashes) // CLASS).bit_length() - 1)
    # Few shingles make few classes; a third number of them leaves small sets enough.
    for k in range(level, level + 2 + (len(hashes) < 8 * CLASS)):
        of = spread & np.uint64((1 << k) - 1)
        mine = np.flatnonzero(of < probes)
        if not len(mine):
            continue
        mine = mine[np.argsort(of[mine], kind="stable")]
        first = np.flatnonzero(np.r_[True, of[mine][1:] != of[mine][:-1]])
        size = np.diff(np.r_[first, len(mine)])
        bits = np.unpackbits(hashes[mine].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype="i4")
        prints = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").tobytes()
        out += [xxh3_64_intdigest(prints[8 * i : 8 * i + 8], k << 8 | c) - (1 << 63) for i, c in enumerate(of[mine][first].tolist())]
    return out


def digests(docs: DataFrame, words: int, probes: int, text: str, key: str) -> DataFrame:
    """(key, digest of the set of shingles, fingerprint of the text, values of the set's probed classes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            d1, d2, fp, probed = [], [], [], []
            for t in batch.column(1):
                every = hashes(shingles((t.as_py() or "").encode(), words))
                fp.append(majority(every))
                own = np.unique(every)
                raw = own.tobytes()
                d1.append(xxh3_64_intdigest(raw, 1) - (1 << 63))
                d2.append(xxh3_64_intdigest(raw, 2) - (1 << 63))
                probed.append(probed_values(own, probes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(np.array(fp, "u8").view("i8")), pa.array(probed, pa.list_(pa.int64()))], ["id", "d1", "d2", "fp", "probed"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(run, "id long, d1 long, d2 long, fp long, probed array<bigint>")


def few_bits(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives of the links that join all fingerprints of sets (rep, fp) at two differing bits or fewer."""
    heads = materialize(sets.groupBy("fp").agg(F.min("rep").alias("head")), "heads")
    same = sets.join(heads, "fp").select("rep", "head")
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}"))
    near = pigeonhole(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select("head_a", "head_b")
    both = same.union(near).toDF("x", "y").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def met(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, of the members of values that few share, and (id, value) of values that more share; keys: id, value."""
    counts = materialize(keys.groupBy("value").count().where("count > 1"), "values")
    # Grouped by another expression of the value, so that Spark may split the join on values that very many share.
    few = keys.join(counts.where(F.col("count") <= PAIRED), "value").groupBy(F.xxhash64("value")).agg(F.collect_set("id").alias("g"))
    pairs = few.select("g", F.explode("g").alias("a")).select("a", F.explode(F.filter("g", lambda x: x > F.col("a"))).alias("b"))
    many = keys.join(counts.where(F.col("count") > PAIRED), "value").select("id", "value")
    return pairs, materialize(many, "many")


def led(many: DataFrame) -> DataFrame:
    """(a, b): each member of crowded values with the smallest that it meets there. A start, which leaves less to the tiles."""
    leaders = materialize(many.groupBy("value").agg(F.min("id").alias("leader")), "leaders")
    return many.join(leaders, "value").groupBy("id").agg(F.min("leader").alias("leader")).where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))


def links(x: tuple[np.ndarray, list[np.ndarray]], y: tuple[np.ndarray, list[np.ndarray]] | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels, as few as join all that similar sets join; x, y: labels and sets of two blocks, or of one and None.

    Every two sets of different labels are compared: a set keeps only shingles that another one can share, and goes
    when it keeps too few to reach `similarity` with any. The rest is a product of matrices of zeros and ones.
    """
    sides = [x] if y is None else [x, y]
    labels = [np.asarray(s[0], "i8") for s in sides]
    total = [np.fromiter(map(len, s[1]), "i8", len(s[1])) for s in sides]
    owner = [np.repeat(np.arange(len(n)), n) for n in total]
    _, code = np.unique(np.concatenate([h for s in sides for h in s[1]] or [np.empty(0, "<u8")]), return_inverse=True)
    codes = np.split(code, [len(owner[0])])[: len(sides)]
    size = int(code.max(initial=-1)) + 1
    live = [np.ones(len(n), bool) for n in total]
    while True:
        df = [np.bincount(c, minlength=size) for c in codes]
        useful = df[0] > 1 if y is None else (df[0] > 0) & (df[1] > 0)
        keep = [useful[c] for c in codes]
        owner, codes = [o[k] for o, k in zip(owner, keep)], [c[k] for c, k in zip(codes, keep)]
        # Sets without shingles are equal, and were one from the start.
        now = [(np.bincount(o, minlength=len(n)) >= similarity * n) & (n > 0) for o, n in zip(owner, total)]
        done = all((a == b).all() for a, b in zip(now, live))
        live = now
        if done:
            break
        keep = [n[o] for o, n in zip(owner, live)]
        owner, codes = [o[k] for o, k in zip(owner, keep)], [c[k] for c, k in zip(codes, keep)]
    mine = [np.flatnonzero(n) for n in live]
    if not all(len(m) for m in mine):
        return []
    row = [np.cumsum(n)[o] - 1 for n, o in zip(live, owner)]
    dense = np.cumsum(useful) - 1
    width = int(useful.sum())
    shared = np.zeros((len(mine[0]), len(mine[-1])), "f4")
    for a in range(0, width, STEP):
        block = []
        for r, c, m in zip(row, codes, mine):
            at = dense[c] - a
            here = (at >= 0) & (at < STEP)
            part = np.zeros((len(m), min(STEP, width - a)), "f4")
            part[r[here], at[here]] = 1
            block.append(part)
        shared += block[0] @ block[-1].T
    first, second = labels[0][mine[0]], labels[-1][mine[-1]]
    sizes = total[0][mine[0]][:, None] + total[-1][mine[-1]][None, :]
    i, j = np.nonzero((shared >= similarity * (sizes - shared.astype("f8"))) & (first[:, None] != second[None, :]))
    met_labels = np.unique(np.sort(np.stack([first[i], second[j]], axis=1), axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while (up := parent.setdefault(n, n)) != n:
            parent[n] = n = parent[up]
        return n

    out = []
    for a, b in met_labels.tolist():
        u, v = root(a), root(b)
        if u != v:
            parent[u] = v
            out.append((a, b))
    return out


def tiled(many: DataFrame, label: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): labels joined by links between members of one crowded value; label: (node, label) so far; known: (id, set).

    The largest label of a value is its main one: its members need no comparison with each other. The others
    meet each other and it.
    """
    own = many.join(label.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = known.groupBy("id").agg(F.sum(F.length("set") / 8).alias("n"))
    own = materialize(own.join(sizes, "id"), "labelled")
    of = own.groupBy("value", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    # The sides' blocks; a value with one label is done.
    count = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    top = F.max(F.struct("rows", "n", "label"))
    of = of.groupBy("value").agg(top.alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    open_ = materialize(of.select("value", F.col("top.label").alias("main"), count(F.col("top.rows"), F.col("top.n")).alias("mains"), F.greatest(F.lit(1), count(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n"))).alias("others")), "open")
    # Blocks of the others come first.
    dealt = own.join(open_, "value").withColumn("block", F.when(F.col("label") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("id"), "mains")).otherwise(F.pmod(F.xxhash64("id"), "others")).cast("int"))
    dealt = materialize(dealt.select("id", "value", "label", "block", "mains", "others"), "dealt")
    full = dealt.join(known, "id")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        sets = t["set"].to_pylist()
        ends = np.cumsum([len(s) // 8 for s in sets], dtype="<i8")
        return pa.table({"value": [key[0].as_py()], "block": [key[1].as_py()], "mains": t["mains"][:1], "others": t["others"][:1], "labels": [t["label"].to_numpy().astype("<i8").tobytes()], "ends": [ends.tobytes()], "sets": [b"".join(sets)]}).cast(BLOCKS)

    packed = full.groupBy("value", "block").applyInArrow(pack, "value long, block int, mains int, others int, labels binary, ends binary, sets binary")
    last = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    sent = materialize(packed, "blocks").withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    sent = sent.select("value", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "labels", "ends", "sets")

    def compare(t: pa.Table) -> pa.Table:
        blocks = [(np.frombuffer(l, "<i8"), np.split(np.frombuffer(s, "<u8"), np.frombuffer(e, "<i8")[:-1])) for l, e, s in zip(*(t[c].to_pylist() for c in ("labels", "ends", "sets")))]
        # A block may be empty, and a tile then has one row though it is of two blocks.
        alone = t["i"][0].as_py() == t["j"][0].as_py()
        found = links(blocks[0], None if alone else blocks[1], similarity) if alone or len(blocks) == 2 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return sent.groupBy("value", "i", "j").applyInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, probes: int = PROBES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, group): the smallest key that each reaches over links of at least `similarity`, the Jaccard similarity of sets of `words`-word shingles.

    Documents without words, null texts among them, are copies of each other. Null keys take no part.
    Rows that repeat a key count with each of their texts, and come back once.
    """
    rows = materialize(digests(bounded_batches(docs), words, probes, text, key), "digests")
    # Probed values follow from the set of shingles; the fingerprint counts repeats, and of several the smallest stands.
    sets = materialize(rows.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.any_value("probed").alias("probed")), "sets")
    # One key may stand for several sets, if rows repeat it.
    keys = materialize(sets.select(F.col("rep").alias("id"), F.explode("probed").alias("value")).distinct(), "probed")
    few, many = met(keys)
    pairs = materialize(few.union(led(many)).union(few_bits(sets.select("rep", "fp"))).distinct(), "pairs")
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct(), "involved")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], ["id", "set"])

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text)).join(involved, "id")
    known = materialize(texts.mapInArrow(hashed, "id long, set binary").dropDuplicates(), "shingles")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = materialize(pairs.join(known.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("b", "a", "x"), "halves")
    checked = first.join(known.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(close, "a long, b long")
    # Copies hang on their representative, and all sets of one key on each other.
    copies = rows.join(sets.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    label = components(checked.union(copies))
    # What the tiles join are labels, and the least of them is the least of all their members.
    above = components(tiled(many, label, known, similarity))
    every = rows.select("id").distinct()
    group = every.join(label, every["id"] == label["node"], "left").select("id", F.coalesce("label", "id").alias("group"))
    return group.join(above.select(F.col("node").alias("group"), "label"), "group", "left").select(F.col("id").alias(key), F.coalesce("label", "group").alias("group"))


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, all columns, without those whose key is not the smallest of its group. Rows with a null key stay."""
    with scratch_scope(docs.sparkSession) as keep:
        groups = similar_groups(docs, words, similarity, text=text, key=key)
        gone = keep(materialize(groups.where(F.col(key) != F.col("group")).select(F.col(key).alias("_gone")), "gone"))
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
