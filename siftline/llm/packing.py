"""Best-fit packing with large-item matching, over the histogram of lengths.

Pieces of one length are interchangeable, so packing needs only how many there are of each length: at most
`capacity` counts, however many documents. The driver packs these counts: lengths above a third of the
capacity pair at most twice per sequence by greedy matching (the longest with the longest that fits, which
gives the most pairs), then shorter lengths, longest first, go to the fullest sequences that take them.
Many equal sequences are handled as one run, so this costs by runs, not by documents. A piece then finds
its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gapless_rank, materialize
from .words import WordCache, slices, sole

CAPACITY, END_ID = 4096, 1
#: Characters of text whose ids are put together at a time; parts that are tokenised in one call.
CHUNK, CALL = 1 << 20, 4096

#: Texts of printable ASCII, Latin letters and ASCII white space, and the parts into which the vocabulary splits them in lower case (fixed values).
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \t-\r]*")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
#: What of a vocabulary has to agree with PARTS: normalisation, splitting, and tokens that say where a part ends.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
END = "</w>"


class IdCache(WordCache):
    """Parts of plain texts, as str, and words of others, as UTF-8 without ASCII white space, to their ids as little-endian unsigned 32-bit.

    The vocabulary drops white space and no token spans it, so the ids of a text are those of its words; nor does one
    span two parts. Parts recur more often than words, which differ by capitals and punctuation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        state = lambda x: json.loads(x.__getstate__()) if x else {}
        split = state(tokenizer.pre_tokenizer).get("pretokenizers", [{}])[0]
        self.path, self.whole, self.known = path, tokenizer, state(tokenizer.normalizer) == NORMALIZER and split.get("pattern") == SPLIT and tokenizer.model.end_of_word_suffix == END
        if self.known:
            # What these two do is done to a part already.
            tokenizer.normalizer = None
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.whole, self.ends = None, np.array([tokenizer.id_to_token(i).endswith(END) for i in range(tokenizer.get_vocab_size())])
        self.parts = tokenizer
        super().__init__(self.compute_ids)

    def split(self, text: str) -> list:
        """The keys whose ids, one after the other, are those of the text."""
        return PARTS.findall(text.lower()) if self.known and "<|" not in text and PLAIN.fullmatch(text) else text.encode().split()

    def compute_ids(self, keys: list) -> list[bytes]:
        out: list[bytes] = [b""] * len(keys)
        own: list[tuple[int, list[str]]] = []
        rest: list[int] = []
        for i, k in enumerate(keys):
            parts = [k] if isinstance(k, str) else self.split(k.decode("utf-8", "replace"))
            if isinstance(parts[0], str):
                own.append((i, parts))
            else:
                rest.append(i)
        for a in range(0, len(own), CALL):
            some = own[a : a + CALL]
            # All in one call: as each part ends in a token that says so, they can be told apart.
            ids = np.array(self.parts.encode_batch_fast([" ".join(" ".join(p) for _, p in some)], add_special_tokens=False)[0].ids, "<u4")
            last, ends = np.cumsum([len(p) for _, p in some]), 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != last[-1]:
                rest += [i for i, _ in some]
                continue
            raw, begin = ids.tobytes(), 0
            for (i, _), end in zip(some, ends[last - 1].tolist()):
                out[i], begin = raw[begin:end], end
        for a in range(0, len(rest), CALL):
            some = rest[a : a + CALL]
            texts = [k if isinstance(k, str) else k.decode("utf-8", "replace") for k in map(keys.__getitem__, some)]
            for i, e in zip(some, self.tokenizer().encode_batch_fast(texts, add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def tokenizer(self):
        """The vocabulary as it is, loaded where a word needs it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole


_caches: dict[str, IdCache] = {}


def id_bytes(path: str) -> IdCache:
    if path not in _caches:
        _caches[path] = IdCache(path)
    return sole(_caches[path])


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool, text: str, key: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = id_bytes(path)
        for batch in batches:
            bodies = batch.column(1)
            sizes = [len(t or "") for t in bodies.to_pylist()]
            for a, b in slices(batch.num_rows, sizes, CHUNK):
                out: list[tuple] = []
                texts = [cache.split(t or "") for t in bodies.slice(a, b - a).to_pylist()]
                words = [w for t in texts for w in t]
                ids, at = cache.all(words), 0
                for doc, n in zip(batch.column(0).slice(a, b - a).to_pylist(), map(len, texts)):
                    own, at = b"".join(ids[at : at + n]) + end, at + n
                    for piece, start in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[start : start + 4 * capacity]
                        out.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*out))
                arrays = [pa.array(c, t) for c, t in zip(columns, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["_key", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    schema = f"_key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("_key"), F.col(text)).mapInArrow(cut, schema)


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack counts[length] pieces of each length.

    Returns runs (length, first rank, pieces per sequence, first sequence, offset), by length and rank, and
    the number of sequences. A run's k-th piece goes to sequence first + k // per, at offset + k % per * length.
    There are at most as many runs as pieces, and, as each closes a length or a class of equal gaps, fewer
    than lengths x gaps; in practice thousands.
    """
    left, used, runs = {k: n for k, n in counts.items() if n}, {}, []
    gaps: list[int] = []
    bins: dict[int, list[list[int]]] = {}
    total = 0

    def place(length: int, n: int, per: int, first: int, gap: int) -> None:
        runs.append((length, used.get(length, 0), per, first, capacity - gap))
        used[length] = used.get(length, 0) + n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in bins:
                insort(gaps, gap)
                bins[gap] = []
            bins[gap].append([first, n])

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, min(a, capacity - a) + 1) - 1
        b = large[i] if i >= 0 else None
        if b == a and left[a] < 2:
            b = large[i - 1] if i > 0 else None
        if b is None:
            n = left.pop(a)
            place(a, n, 1, total, capacity)
            leave(capacity - a, total, n)
        elif b == a:
            n = left[a] // 2
            place(a, 2 * n, 2, total, capacity)
            leave(capacity - 2 * a, total, n)
            left[a] -= 2 * n
        else:
            n = min(left[a], left[b])
            place(a, n, 1, total, capacity)
            place(b, n, 1, total, capacity - a)
            leave(capacity - a - b, total, n)
            left[a] -= n
            left[b] -= n
        total += n
        large = [k for k in large if left.get(k)]
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                per = capacity // s
                leave(capacity, total, -(-n // per))
                total += -(-n // per)
                continue
            gap = gaps[i]
            stretch, per = bins[gap][-1], gap // s
            first, there = stretch
            if n < per:
                take, per = 1, n
            else:
                take = min(there, n // per)
            place(s, take * per, per, first, gap)
            n -= take * per
            if take == there:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[i]
            else:
                stretch[0], stretch[1] = first + take, there - take
            leave(gap - per * s, first, take)
    return sorted(runs), total


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack all rows: key, piece, start, length, ids_crc32, sequence_id, offset (and ids as bytes if asked).

    A document is its ids and end_id; a null or empty text is end_id alone. Only documents over the capacity
    are cut. Repeated rows and null keys are packed as rows of their own. Every row of a table counts; an
    empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(pieces_of(bounded_batches(docs), path, capacity, end_id, with_ids, text, key), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs, _ = pack_counts(counts, capacity)
    # One sorted number finds a run: the length above, the rank below.
    table = np.array([(length << 44 | rank, per, first, offset) for length, rank, per, first, offset in runs], "int64").reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = gapless_rank(pieces, sum(counts.values()), "length", "length", ["_key", "piece", "start", "ids_crc32"])
    columns = ["_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, per, first, offset = shared.value.T
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(heads, length << 44 | rank, "right") - 1
            k = rank - (heads[at] & (1 << 44) - 1)
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + k // per[at]), pa.array(offset[at] + k % per[at] * length)], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in pieces.select(columns).dtypes)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long").withColumnRenamed("_key", key)
