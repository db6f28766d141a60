"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts split into words, each a run of U+2581 and what follows, as no piece has that mark after another
character. The batch's distinct words are joined and indexed by a suffix array; every piece of the vocabulary is
looked up in it by binary search, which gives its range of occurrences; the occurrences, as edges from start to
end, are sorted by position and relaxed from the left. A prefix is reached by the one edge whose piece may follow
the piece that reaches its start: in byte-pair encoding two neighbours are right just when no merge across them
would have come before the merges that made them, so relaxing finds the very ids that merging does. Characters
without a piece become byte pieces, and nothing merges across them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import WordCache, slices, sole

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of text that are encoded at a time.
CHUNK = 2 << 20
#: Characters of words that are indexed at a time, and pairs of pieces whose compatibility is kept.
INDEXED, PAIRS = 400_000, 200_000
FREE, NOTHING = -1, -2
#: Words of one generation of the cache.
ENTRIES = 200_000


def packed(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each position as many characters as a number holds, first ones highest; the number of each character; bits and characters."""
    present = np.zeros(max(int(codes.max(initial=0)) + 1, 2), bool)
    present[codes] = True
    present[0] = True
    number = np.cumsum(present) - 1
    dense = number[codes]
    bits = max(int(dense.max(initial=1)).bit_length(), 1)
    width = min(max(1, 62 // bits), longest)
    padded = np.concatenate([dense, np.zeros(width, dense.dtype)])
    key = np.zeros(len(codes), "i8")
    for k in range(width):
        key = key << bits | padded[k : k + len(codes)]
    return key, np.where(present, number, -1), bits, width


def suffix_array(key: np.ndarray, width: int, longest: int) -> np.ndarray:
    """Positions in the order of at least the `longest` characters from each, by prefix doubling; key orders the first `width`."""
    while width < longest:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), "i8")
        rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        after = np.zeros(len(rank), "i8")
        after[:-width] = rank[width:] + 1
        key = rank * (len(rank) + 2) + after
        width *= 2
    return np.argsort(key, kind="stable")


class Pieces:
    """A byte-pair vocabulary with byte pieces, and what its merges allow."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        model = SentencePieceProcessor(model_file=path)
        spec.ParseFromString(model.serialized_model_proto())
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.normalizer_spec.name != "identity" or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model has to be byte-pair encoding with byte fallback and without normalisation")
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i, p in enumerate(spec.pieces):
            if p.type == p.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == p.NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece has the space mark after another character")
                self.ids[p.piece] = i
                self.raw.append(p.piece.replace(MARK, " ").encode())
            else:
                self.raw.append(b"")
        # Earlier merges have higher scores.
        order = sorted(self.ids.values(), key=lambda i: (-spec.pieces[i].score, i))
        self.rank = dict(zip(order, range(len(order))))
        self.split: dict[int, tuple[int, int] | None] = {}
        self.text = {i: t for t, i in self.ids.items()}
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(t) == 1:
                self.split[i] = None
                self.rank[i] = -1
            elif last := self.last_merge(t):
                self.split[i] = last
        self.follows: dict[tuple[int, int], bool] = {}
        self.known, self.good = np.array([], "i8"), np.array([], bool)
        # Pieces that merging can make, in code points, padded.
        made = sorted((t, i) for t, i in self.ids.items() if i in self.split)
        self.longest = max(len(t) for t, _ in made)
        self.made = np.array([i for _, i in made], "i4")
        self.lengths = np.array([len(t) for t, _ in made], "i4")
        self.codes = np.zeros((len(made), self.longest), "i4")
        for row, (t, _) in zip(self.codes, made):
            row[: len(t)] = [ord(c) + 1 for c in t]
        self.cache = WordCache(self.encode_words, ENTRIES)

    def last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes `text`, or None if merging its characters never makes it whole."""
        parts = list(text)
        while len(parts) > 1:
            options = [(self.rank[i], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (i := self.ids.get(a + b)) is not None]
            if not options:
                return None
            _, k = min(options)
            if len(parts) == 2:
                return (self.ids[parts[0]], self.ids[parts[1]]) if parts[0] in self.ids and parts[1] in self.ids else None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the characters of both leaves just these two pieces.

        Undoes, latest first, the merges at the end of a and at the start of b. What then lies side by side must
        not merge before the merge just undone; of equal merges the one further left comes first.
        """
        pair = (a, b)
        known = self.follows.get(pair)
        if known is not None:
            return known
        bound, ok = 2 * len(self.rank) + 2, True
        while True:
            across = self.ids.get(self.text[a] + self.text[b])
            if across is not None and 2 * self.rank[across] < bound:
                ok = False
                break
            left, right = self.split[a], self.split[b]
            if left is None and right is None:
                break
            if right is None or (left is not None and self.rank[a] > self.rank[b]):
                bound, a = 2 * self.rank[a], left[1]
            else:
                bound, b = 2 * self.rank[b] + 1, right[0]
        self.follows[pair] = ok
        return ok

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece as (start, end, piece)."""
        key, number, bits, width = packed(codes, self.longest)
        order = suffix_array(key, width, self.longest)
        # Pieces that fit a number are looked up among the numbers, longer ones from there on by their characters.
        known = np.where(self.codes < len(number), number[np.minimum(self.codes, len(number) - 1)], -1)
        within = np.arange(self.longest) < self.lengths[:, None]
        there = (known >= 0) | ~within
        possible = there.all(axis=1)
        low = np.zeros(len(self.made), "i8")
        high = np.zeros(len(self.made), "i8")
        for k in range(width):
            inner = within[:, k]
            low = low << bits | np.where(inner, known[:, k], 0)
            high = high << bits | np.where(inner, known[:, k], (1 << bits) - 1)
        sorted_keys = key[order]
        first = np.searchsorted(sorted_keys, low, "left")
        end = np.searchsorted(sorted_keys, high, "right")
        end[~possible] = first[~possible]
        long = np.flatnonzero(possible & (self.lengths > width) & (end > first))
        if len(long):
            padded = np.concatenate([codes, np.zeros(self.longest, codes.dtype)])
            first[long], end[long] = self.search(padded, order, long, first[long], end[long], False), self.search(padded, order, long, first[long], end[long], True)
        n = end - first
        which = np.repeat(np.arange(len(n)), n)
        start = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return start, start + self.lengths[which], self.made[which]

    def search(self, padded: np.ndarray, order: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, beyond: bool) -> np.ndarray:
        """By binary search between low and high, the first suffix not below each piece, or the first above all that begin with it."""
        codes, lengths = self.codes[which], self.lengths[which]
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            below, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
            for k in range(self.longest):
                text, own = padded[at + k], codes[:, k]
                live = equal & (k < lengths)
                below |= live & (text < own)
                equal &= ~live | (text == own)
            below |= equal & beyond
            low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low

    def decoded(self, ids: bytes | None) -> str:
        whole = b"".join(map(self.raw.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        return whole[whole.startswith(b" ") :].decode("utf-8", "replace")

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow of many pairs, most of them known."""
        keys = a.astype("i8") << 32 | b
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        there = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[there] = self.good[at[there]]
        if not there.all():
            new, of = np.unique(keys[~there], return_inverse=True)
            out[~there] = np.array([self.may_follow(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)[of]
        return out

    def remember(self) -> None:
        """Put what was found out about pairs into the sorted table."""
        if len(self.follows) > PAIRS:
            self.follows.clear()
        keys = np.array([a << 32 | b for a, b in self.follows], "i8")
        order = np.argsort(keys)
        self.known, self.good = keys[order], np.array(list(self.follows.values()), bool)[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of the mark and each word after it, as little-endian unsigned 32-bit."""
        out: list[bytes] = []
        words = [MARK + w for w in words]
        for a, b in slices(len(words), [len(w) for w in words], INDEXED):
            out += self.encode_indexed(words[a:b])
        if len(self.follows) > 1.2 * len(self.known):
            self.remember()
        return out

    def encode_indexed(self, words: list[str]) -> list[bytes]:
        # Words apart by 0, which no piece has.
        codes = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), "<i4") + 1
        lengths = np.fromiter(map(len, words), "i8", len(words))
        begins = np.cumsum(lengths + 1) - lengths - 1
        codes[(begins + lengths)[:-1]] = 0
        start, end, piece = self.edges(codes)
        # What reaches each position: a piece, FREE at starts of words and after characters without a piece, or nothing.
        last, back = np.full(len(codes) + 1, NOTHING, "i8"), np.zeros(len(codes) + 1, "i8")
        last[begins] = FREE
        bare = np.flatnonzero(~np.isin(codes, self.codes[self.lengths == 1, 0]) & (codes != 0)) + 1
        last[bare] = FREE
        # All words at once, by distance from their start: the edges in order of position within their words.
        place = np.arange(len(codes)) - np.repeat(begins, lengths + 1)[: len(codes)]
        steps = place[start]
        order = np.argsort(steps.astype("u2") if lengths.max() < 1 << 16 else steps, kind="stable")
        start, end, piece, steps = start[order], end[order], piece[order], steps[order]
        edges_at = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1]]) if len(steps) else []
        for x, y in zip(edges_at, [*edges_at[1:], len(steps)]):
            before = last[start[x:y]]
            live = np.flatnonzero((before != NOTHING) & (last[end[x:y]] == NOTHING))
            before, s, e, p = before[live], start[x:y][live], end[x:y][live], piece[x:y][live]
            ok = before == FREE
            ok[~ok] = self.allowed(before[~ok], p[~ok])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        # From the ends back, all words at once; the others one by one.
        special = np.unique(np.searchsorted(begins, bare - 1, "right") - 1)
        plain = np.setdiff1d(np.arange(len(words)), special, assume_unique=True)
        at, who = (begins + lengths)[plain], plain
        found: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        while len(at):
            found.append(last[at])
            owner.append(who)
            at = back[at]
            more = at > begins[who]
            at, who = at[more], who[more]
        ids = np.concatenate([*found, np.array([], "i8")])
        own = np.concatenate([*owner, np.array([], "i8")])
        order = np.lexsort((-np.arange(len(own)), own))
        raw = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(own, minlength=len(words)))
        out = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in special.tolist():
            ids, at = [], int(begins[i] + lengths[i])
            while at > begins[i]:
                if last[at] >= 0:
                    ids.append(int(last[at]))
                    at = int(back[at])
                else:
                    at -= 1
                    ids += [self.bytes[x] for x in reversed(chr(int(codes[at]) - 1).encode("utf-8", "replace"))]
            out[i] = np.array(ids[::-1], "<u4").tobytes()
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def words_of(text: str) -> list[str]:
    """The words of a text, each without the mark that it begins with."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and MARK not in text:
        return text.split(" ")
    return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids", back: str | None = None) -> DataFrame:
    """Add the ids of each text, as bytes of little-endian unsigned 32-bit ids; path: a SentencePiece model file.

    back: also add, under this name, the text that the ids decode to, as decode() does, in the same pass.

    A null or empty text has no ids. Rows are independent, texts of any length are encoded whole, all columns
    stay; an existing column of that name is replaced.
    """
    bounded_batches(docs)
    kept = [c for c in docs.columns if c not in (name, back)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pieces(path)
        cache = sole(loaded.cache)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(batch.num_rows, pc.binary_length(texts).fill_null(0).to_pylist(), CHUNK):
                own = [words_of(t or "") for t in texts.slice(a, b - a).to_pylist()]
                ids, at, out = cache.all([w for t in own for w in t]), 0, []
                for n in map(len, own):
                    out.append(b"".join(ids[at : at + n]))
                    at += n
                decoded = [pa.array(map(loaded.decoded, out), pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(out, pa.binary()), *decoded], [*kept, name, *[back] * bool(back)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"`{name}` binary"] + [f"`{back}` string"] * bool(back))
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of each row's ids: marks become spaces, the first of them goes, byte pieces join into characters.

    Null or no ids give an empty text; bytes that are no UTF-8 become U+FFFD. All columns stay; an existing
    column of that name is replaced.
    """
    bounded_batches(docs)
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = pieces(path).decoded
        for batch in batches:
            texts = [decoded(own.as_py()) for own in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"`{name}` string"])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
