"""Removal of repeated passages, counted exactly over super-k-mer buckets.

A window is `size` consecutive words. Its minimiser is the smallest hash of any GRAM consecutive words in it.
Consecutive windows with one minimiser travel as one packed string, a super-k-mer, to the bucket of their
minimiser, so equal windows always meet. A map task combines equal super-k-mers before they are sent: with few
occurrences it lists them; with more than LISTED it sends only the smallest document id, and these occurrences
find their windows' results later, by a join on the super-k-mer. So what reaches a bucket does not grow with
the copies of a passage. Within a bucket sorting brings equal windows together, and each learns the smallest
document that it starts in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import bounded_batches, materialize
from .words import forget

SIZE, GRAM = 13, 3
#: Occurrences of a super-k-mer that a map task lists; more go by the join.
LISTED = 8
#: Bytes of super-k-mers that a map task combines at a time, and that a bucket should hold; the fewest buckets.
FLUSH, BUCKET, BUCKETS = 12 << 20, 8 << 20, 512
#: Occurrences in one packed row of those that go by the join.
PACKED = 4096

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def super_kmers(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end window and minimiser of each run of windows that share a minimiser."""
    h, gram = np.fromiter(map(xxh64_intdigest, words), "u8", len(words)), min(GRAM, size)
    n = len(h)
    grams = np.zeros(n - gram + 1, "u8")
    for k in range(gram):
        grams = mixed(grams + h[k : n - gram + 1 + k])
    windows, least = n - size + 1, grams[: n - size + 1].copy()
    for k in range(1, size - gram + 1):
        np.minimum(least, grams[k : k + windows], out=least)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return first, np.r_[first[1:], windows], least[first]


class Combiner:
    """Super-k-mers of a map task, equal ones together, until a flush."""

    def __init__(self, size: int, buckets: int):
        self.size, self.buckets, self.held = size, np.uint64(buckets), 0
        self.found: dict[bytes, list] = {}

    def add(self, doc: int, words: list[bytes]) -> None:
        first, end, least = super_kmers(words, self.size)
        # Where each word starts in the joined text.
        at = np.r_[0, np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)]
        joined = b" ".join(words)
        found, size = self.found, self.size
        for i, a, b, bucket in zip(first.tolist(), at[first].tolist(), at[end + size - 1].tolist(), (least % self.buckets).tolist()):
            own = joined[a : b - 1]
            entry = found.get(own)
            if entry is None:
                found[own] = [bucket, doc, i]
                self.held += b - a
            else:
                entry += (doc, i)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """Packed rows (bucket, blob): listed and summed super-k-mers by bucket, and the occurrences that go by the join, dealt evenly."""
        by: dict[int, list[list]] = {}
        many: list[tuple[bytes, list[int]]] = []
        for own, entry in self.found.items():
            strings, counts, docs, starts = by.setdefault(entry[0], [[], [], [], []])
            ids, at = entry[1::2], entry[2::2]
            strings.append(own)
            if len(ids) > LISTED:
                counts.append(0)
                docs.append(min(ids))
                starts.append(0)
                many.append((xxh3_128_digest(own), entry))
            else:
                counts.append(len(ids))
                docs += ids
                starts += at
        pack = ZstdCompressor(level=3).compress
        for bucket, (strings, counts, docs, starts) in by.items():
            parts = [np.array([0, len(strings), len(docs)], "<i8").tobytes(), np.array(counts, "<i4").tobytes(), np.array(docs, "<i8").tobytes(), np.array(starts, "<i4").tobytes(), b"\n".join(strings)]
            yield bucket, pack(b"".join(parts))
        flat = [(key, doc, start) for key, entry in many for doc, start in zip(entry[1::2], entry[2::2])]
        for i in range(0, len(flat), PACKED):
            keys, docs, starts = zip(*flat[i : i + PACKED])
            blob = np.array([1, len(docs), 0], "<i8").tobytes() + np.array(docs, "<i8").tobytes() + np.array(starts, "<i4").tobytes() + b"".join(keys)
            yield xxh64_intdigest(blob) % int(self.buckets), pack(blob)
        self.found, self.held = {}, 0


def window_minima(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """The smallest document of each window's equals, windows in order; ids: words of all strings, docs: one for each string."""
    windows = lengths - size + 1
    begins = np.cumsum(lengths) - lengths
    at = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    spread = mixed(ids.astype("u8") + np.uint64(1))
    h = np.zeros(len(at), "u8")
    for k in range(size):
        h = mixed(h + spread[at + k])
    order = np.argsort(h, kind="stable")
    there, new = at[order], np.r_[True, h[order][1:] != h[order][:-1]]
    equal = np.flatnonzero(~new)
    for k in range(size):
        if (ids[there[equal] + k] != ids[there[equal - 1] + k]).any():  # two windows with one hash: sort the words themselves
            rows = np.ascontiguousarray(np.stack([ids[at + k] for k in range(size)], axis=1))
            order = np.lexsort(rows.T)
            new = np.r_[True, (rows[order][1:] != rows[order][:-1]).any(axis=1)]
            break
    own = np.repeat(docs, windows)
    least = np.minimum.reduceat(own[order], np.flatnonzero(new))
    out = np.empty(len(own), "i8")
    out[order] = np.repeat(least, np.diff(np.r_[np.flatnonzero(new), len(order)]))
    return out


def runs(flags: np.ndarray, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Words covered by flagged windows, as half-open ranges; start: the first window's word."""
    if flags.all():
        yield start, start + len(flags) + size - 1
    elif flags.any():
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield start + a, start + b + size - 1


FOUND = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("super", pa.binary()), ("least", pa.binary())])
RANGE, RESULT, OCCURRENCE = 0, 1, 2


def bucket_of(blobs: list[bytes], size: int) -> pa.Table:
    """What one bucket finds: ranges of listed occurrences, results for summed super-k-mers, and the occurrences dealt to it."""
    number: dict[bytes, int] = {}
    ids, lengths, least, listed = [], [], [], []
    out: dict[str, list] = {f: [] for f in FOUND.names}

    def put(*row) -> None:
        for column, x in zip(out.values(), row):
            column.append(x)

    unpack = ZstdDecompressor().decompress
    for blob in blobs:
        raw = unpack(blob)
        kind, n, flat = np.frombuffer(raw, "<i8", 3).tolist()
        if kind == 1:
            docs, starts, keys = np.frombuffer(raw, "<i8", n, 24).tolist(), np.frombuffer(raw, "<i4", n, 24 + 8 * n).tolist(), raw[24 + 12 * n :]
            for i in range(n):
                put(OCCURRENCE, docs[i], starts[i], None, keys[16 * i : 16 * i + 16], None)
            continue
        counts = np.frombuffer(raw, "<i4", n, 24)
        docs, starts = np.frombuffer(raw, "<i8", flat, 24 + 4 * n), np.frombuffer(raw, "<i4", flat, 24 + 4 * n + 8 * flat)
        strings = raw[24 + 4 * n + 12 * flat :].split(b"\n")
        words = raw[24 + 4 * n + 12 * flat :].replace(b"\n", b" ").split(b" ")
        new = set(words).difference(number)
        number.update(zip(new, range(len(number), len(number) + len(new))))
        ids.append(np.fromiter(map(number.__getitem__, words), "i4", len(words)))
        lengths.append(np.fromiter((s.count(b" ") for s in strings), "i8", n) + 1)
        begins = np.cumsum(np.maximum(counts, 1)) - np.maximum(counts, 1)
        least.append(np.minimum.reduceat(docs, begins))
        most = np.maximum.reduceat(docs, begins)
        listed.append((strings, counts, begins, docs, starts, most))
    if ids:
        lengths = np.concatenate(lengths)
        minima = window_minima(np.concatenate(ids), lengths, np.concatenate(least), size)
        windows = lengths - size + 1
        firsts = np.cumsum(windows) - windows
        lowest = np.minimum.reduceat(minima, firsts)
        seen, i = set(), 0
        for strings, counts, begins, docs, starts, most in listed:
            here = slice(i, i + len(strings))
            for j in np.flatnonzero((counts == 0) | (lowest[here] < most)).tolist():
                own = minima[firsts[i + j] : firsts[i + j] + windows[i + j]]
                if counts[j] == 0:
                    if strings[j] not in seen:
                        seen.add(strings[j])
                        put(RESULT, None, None, None, xxh3_128_digest(strings[j]), own.astype("<i8").tobytes())
                    continue
                for k in range(begins[j], begins[j] + counts[j]):
                    for a, b in runs(own < docs[k], int(starts[k]), size):
                        put(RANGE, int(docs[k]), a, b, None, None)
            i += len(strings)
    return pa.table([pa.array(out[f.name], f.type) for f in FOUND], schema=FOUND)


def repeated_ranges(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ranges): word ranges (a, b) covered by windows that also start in a document with a smaller key."""
    total = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    buckets = max(BUCKETS, 3 * (total[0] or 0) // BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        combiner = Combiner(size, buckets)

        def out():
            rows = list(combiner.flush())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (body.as_py() or "").encode().split()
                if len(words) >= size:
                    combiner.add(doc, words)
                    if combiner.held > FLUSH:
                        yield out()
        if combiner.found:
            yield out()

    sent = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text)).mapInArrow(send, "bucket long, blob binary")
    found = materialize(sent.groupBy("bucket").applyInArrow(lambda t: bucket_of(t["blob"].to_pylist(), size), "kind byte, doc long, a int, b int, super binary, least binary"), "passages")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, a, b) for doc, start, least in zip(*(c.to_pylist() for c in batch.columns)) for a, b in runs(np.frombuffer(least, "<i8") < doc, start, size)]
            docs, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc", "a", "b"])

    late = found.where(F.col("kind") == OCCURRENCE).select("super", "doc", "a").join(found.where(F.col("kind") == RESULT).select("super", "least"), "super")
    ranges = found.where(F.col("kind") == RANGE).select("doc", "a", "b").union(late.select("doc", "a", "least").mapInArrow(resolve, "doc long, a int, b int"))
    return ranges.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def kept_runs(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of n words, as ranges in order."""
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, n)] * (at < n)


def with_ranges(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """_row, a struct of all columns, so that none can clash, and _ranges."""
    found = repeated_ranges(bounded_batches(docs), size, text, key).select(F.col(key).alias("_key"), F.col("ranges").alias("_ranges"))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(found, "_key", "left").select("_row", "_ranges")


def pairs(ranges: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(r["a"], r["b"]) for r in x] if x else [] for x in ranges.to_pylist()]


def removal_report(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A null text has no words. Windows are judged on the input. Rows with a null key keep all words and remove
    none elsewhere. Rows that repeat a key count as one document and have to repeat its text; neither removes
    words of the other. Texts of any length are read whole; an empty table gives no rows.
    """
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, digests = [], [], []
            keys, bodies = batch.column(0).flatten()
            for body, ranges in zip(bodies, pairs(batch.column(1))):
                words = (body.as_py() or "").encode().split()
                kept = [w for a, b in kept_runs(len(words), ranges) for w in words[a:b]] if ranges else words
                count.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    rows = with_ranges(docs.select(key, text), size, text, key)
    return rows.mapInArrow(report, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same rows and columns; texts lose their repeated words, the rest keeps its white space, and one space joins what was apart.

    Rows and keys are treated as in removal_report; texts without repeats, nulls among them, stay as they are.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = [], batch.column(0).flatten()
            for body, ranges in zip(columns[names.index(text)], pairs(batch.column(1))):
                body = body.as_py()
                if ranges:
                    spans = [m.span() for m in SPACE.finditer(body)]
                    body = " ".join(body[spans[a][0] : spans[b - 1][1]] for a, b in kept_runs(len(spans), ranges))
                texts.append(body)
            columns[names.index(text)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_ranges(docs, size, text, key).mapInArrow(cut, docs.schema)
