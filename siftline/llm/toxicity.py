"""Toxicity by maximum-scoring segments of token log-odds.

Learning reads a bounded sample of labelled documents (SAMPLE rows, smallest hash of the id first; scores,
thresholds and everything else cover all documents). Words and their character n-grams are counted once a
document, in each class, in hashed tables of a fixed size; documents that share their least or greatest shingle
with others, as near copies do, share one vote. A word's log-odds have an informative Dirichlet prior: its mean
is what the word's most reliable n-grams say, its strength a few documents, and the word's own counts move it.
So forms that no labelled document has, inflected or misspelt, score by their parts. Spelt-out, stretched and
digit-for-letter forms are folded before.

A document's words score their log-odds less a penalty, a word's repetitions the penalty alone, and one linear
scan finds every maximal segment. The best segment's score follows an extreme-value law in clean documents,
fitted by maximum likelihood, so a segment of score s is expected K n exp(-lambda s) times among n distinct clean words; the
document's evidence sums log(1 + 1 / expected) over all its segments, without a cut. The law and the decision
are fitted on scores that models without the document's own fold gave (cross-fitting): 0.5 is the evidence that
best parts the classes while at most FALSE_ALARMS of the clean documents reach it. Other documents score by the
mean of these models, so that what was fitted holds for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, scratch_scope
from .words import WordCache, forget, slices, sole

SAMPLE = 20_000
#: Words of one generation of the cache; characters of new words that are scored at a time.
ENTRIES, CHARACTERS = 120_000, 1 << 18
#: Lengths of n-grams, with one mark before and one after the word; bits of the tables of n-grams and of words.
GRAMS, GRAM_BITS, WORD_BITS = (3, 4, 5, 6), 21, 20
#: Strength of the priors, in documents; standard errors by which n-grams and a word's own counts are held back; penalty of each word.
WORD_PRIOR, GRAM_PRIOR, GRAM_DOUBT, WORD_DOUBT, PENALTY = 8.0, 100.0, 3.5, 1.0, 0.8
#: Folds of the cross-fitting; share of clean documents that may reach 0.5; expected counts below which a segment is shown.
FOLDS, FALSE_ALARMS, SIGNIFICANT = 3, 0.03, 0.05

#: A word, with marks that stand for letters inside, or single letters with one separator between each two.
WORD = re.compile(r"(?<!\w)[^\W\d_](?:[ ._-][^\W\d_]){2,}(?!\w)|[^\W_]+(?:[@$!*][^\W_]+)*")
#: Digits and marks written for letters; separators go.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", **dict.fromkeys("*._- ")})
STRETCHED = re.compile(r"(.)\1{2,}")
ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(token: str) -> str:
    """The word that a token in lower case spells; empty if it has no letter."""
    if not token.isalpha():
        if not any(c.isalpha() for c in token):
            return ""
        token = token.translate(LETTERS)
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token).lower()
    return STRETCHED.sub(r"\1", token)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of non-empty words, set side by side with their marks: where each begins, its slot, and for each length of n-grams which places begin one, with their slots."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(begins, sizes)
    left = np.repeat(sizes, sizes) - place
    powers = np.cumprod(np.full(int(sizes.max()), ODD, np.uint64))
    whole = mixed(np.add.reduceat(mixed(codes) * powers[place], begins)) >> np.uint64(64 - WORD_BITS)
    grams, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        reach = max(len(codes) - n + 1, 0)
        h[:reach] = h[:reach] * ODD + mixed(codes[n - 1 :] + np.uint64(1))
        if n in GRAMS:
            grams.append((left >= n, (mixed(h + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)))
    return begins, whole.astype(np.int64), grams


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Each candidate keeps the running total before it and at its end, and a link to the nearest candidate before
    it that starts lower, so a search passes each candidate once.
    """
    found: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((before, total, start, i + 1, j))
                break
            before, _, start, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, high - low) for low, high, a, b, _ in found]


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The segments of scores; neighbours of one sign, which no segment parts, are one step."""
    up = scores > 0
    if not up.any():
        return []
    first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    ends = np.r_[first[1:], len(scores)]
    return [(int(first[a]), int(ends[b - 1]), s) for a, b, s in segments(np.add.reduceat(scores, first).tolist())]


@dataclass(frozen=True)
class Odds:
    """Log-odds of words: what n-grams say, held back by their doubt, and documents of each class that have a word."""

    base: float
    grams: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, words: np.ndarray, docs: np.ndarray) -> Odds:
        """From counts by class (0, 1) and slot, and documents by class."""
        base, share = float(np.log(docs[1] / docs[0])), docs[1] / docs.sum()
        a, b = grams[1] + np.float32(GRAM_PRIOR * share), grams[0] + np.float32(GRAM_PRIOR * (1 - share))
        odds = np.log(a / b) - base
        held = np.sign(odds) * np.maximum(np.abs(odds) - GRAM_DOUBT * np.sqrt(1 / a + 1 / b), 0)
        return Odds(base, held.astype(np.float16), words[1], words[0])

    def some(self, begins: np.ndarray, slots: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-odds of hashed words."""
        high = np.zeros(len(begins), np.float32)
        low = high.copy()
        for valid, at in grams:
            said = np.where(valid, self.grams[at], 0).astype(np.float32)
            np.maximum(high, np.maximum.reduceat(said, begins), out=high)
            np.minimum(low, np.minimum.reduceat(said, begins), out=low)
        mean = (high + low).astype(float)
        share = 1 / (1 + np.exp(-(mean + self.base)))
        a, b = self.toxic[slots] + WORD_PRIOR * share, self.clean[slots] + WORD_PRIOR * (1 - share)
        moved = np.log(a / b) - self.base - mean
        return mean + np.sign(moved) * np.maximum(np.abs(moved) - WORD_DOUBT * np.sqrt(1 / a + 1 / b), 0)


class Lexicon:
    """Scores of tokens by the mean log-odds of some models; new words are scored once."""

    def __init__(self, models: list[Odds], entries: int):
        self.models, self.cache = models, WordCache(self.odds, entries)

    def odds(self, tokens: list[str]) -> list[float]:
        """Log-odds of tokens; a token without a letter has none."""
        plain = [folded(t) for t in tokens]
        real = [w for w in plain if w]
        odds: list[float] = []
        for a, b in slices(len(real), [len(w) for w in real], CHARACTERS):
            found = hashed(real[a:b])
            odds += np.mean([m.some(*found) for m in self.models], axis=0).tolist()
        each = iter(odds)
        return [next(each) if w else 0.0 for w in plain]

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, int]:
        """The score of each token, the penalty and where it stands first its log-odds; and how many stand first."""
        n = len(tokens)
        first = dict(zip(reversed(tokens), range(n - 1, -1, -1)))
        scores = np.full(n, -PENALTY)
        scores[np.fromiter(first.values(), np.int64, len(first))] += self.cache.all(list(first))
        return scores, len(first)


@dataclass(frozen=True)
class Model:
    odds: list[Odds]
    decay: float
    rate: float
    half: float  # evidence that scores 0.5
    slope: float
    constant: float | None = None  # the score of every text, where nothing could be learnt

    def expected(self, best: np.ndarray, n: int) -> np.ndarray:
        return self.rate * n * np.exp(-self.decay * best)

    def evidence(self, best: np.ndarray, n: int) -> float:
        return float(np.log1p(np.logaddexp(0, self.decay * best - np.log(self.rate * max(n, 1))).sum()))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.half), -30, 30))))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """text, toxic and fold, with the least and the greatest hash of the text's five-word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ends = []
            for text in batch.column(0):
                words = (text.as_py() or "").split()
                codes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(len(words) - 4, 1))]
                ends.append((min(codes), max(codes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*ends))] if ends else [*batch.columns, pa.array([], pa.int64()), pa.array([], pa.int64())], ["text", "toxic", "fold", "least", "greatest"])

    return docs.select("text", "toxic", "fold").mapInArrow(run, "text string, toxic int, fold int, least long, greatest long")


def counted(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Votes by fold, class and slot: of n-grams, and of words."""
    size = 1 << GRAM_BITS, 1 << WORD_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        grams, words = (np.zeros((2 * FOLDS, s), np.float32) for s in size)
        for batch in batches:
            for text, toxic, fold, vote in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                cell = 2 * fold + toxic
                own = list({w for t in set(WORD.findall((text.as_py() or "").lower())) if (w := folded(t))})
                for a, b in slices(len(own), [len(w) for w in own], CHARACTERS):
                    _, slots, found = hashed(own[a:b])
                    words[cell][np.unique(slots)] += vote
                    grams[cell][np.unique(np.concatenate([at[valid] for valid, at in found]))] += vote
        for shift, table in ((0, grams.ravel()), (2 * FOLDS * size[0], words.ravel())):
            at = np.flatnonzero(table)
            for i in range(0, len(at), 1 << 17):
                part = at[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(part + shift), pa.array(table[part].astype(float))], ["slot", "votes"])

    rows = train.select("text", "toxic", "fold", "vote").mapInArrow(count, "slot long, votes double").groupBy("slot").agg(F.sum("votes").alias("votes")).toArrow()
    every = np.zeros(2 * FOLDS * sum(size), np.float32)
    every[rows.column("slot").to_numpy()] = rows.column("votes").to_numpy()
    return every[: 2 * FOLDS * size[0]].reshape(FOLDS, 2, -1), every[2 * FOLDS * size[0] :].reshape(FOLDS, 2, -1)


def extreme_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K, by maximum likelihood, of P(best <= s) = exp(-K n exp(-lambda s)); where all are alike, one segment in all at lambda 1."""
    if not len(n) or best.max() - best.min() < 1e-9:
        return 1.0, 1 / max(float(n.sum()), 1.0)
    low, high = 1e-3, 100.0
    for _ in range(60):
        middle = (low * high) ** 0.5
        w = n * np.exp(-middle * (best - best.min()))
        low, high = (middle, high) if best.mean() - (best * w).sum() / w.sum() < 1 / middle else (low, middle)
    return low, float(1 / np.mean(n * np.exp(-low * best)))


def slope_of(x: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve, by Newton steps with a slight ridge; positive."""
    m, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2), m.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[1]), 0.1)


def halfway(x: np.ndarray, y: np.ndarray) -> float:
    """The evidence that parts the classes best, by the share of toxic documents above less that of clean ones, with at most FALSE_ALARMS of these above."""
    values = np.unique(x)
    toxic, clean = np.sort(x[y == 1]), np.sort(x[y == 0])
    hit = 1 - np.searchsorted(toxic, values) / len(toxic)
    alarm = 1 - np.searchsorted(clean, values) / len(clean)
    gain = np.where(alarm <= FALSE_ALARMS, hit - alarm, -1.0)
    at = int(np.argmax(gain))
    if gain[at] <= 0:
        return float(values[-1]) + 1.0
    return float((values[at - 1] + values[at]) / 2) if at else float(values[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents; docs: doc_id, text; labels: doc_id, toxic (0 or 1).

    Only rows whose crc32(doc_id as text) mod 5 is not 0 teach. Null ids, null labels and labels other than 0
    and 1 are left out; of several labels of one id the largest counts. Where a class is missing in the sample, or
    in what any fold leaves, every text scores the share of label 1, or 0 where there is none.
    """
    with scratch_scope(docs.sparkSession):
        return learn(docs, labels, sample)


def learn(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids and labels are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    bounded_batches(docs)
    # Copies are of one fold, by their least shingle, so that no document is scored by its own copies.
    rows = materialize(fingerprinted(rows.select("text", "toxic", F.lit(0).alias("fold"))), "labelled")
    # At most `sample` counts of each kind are broadcast.
    for end in ("least", "greatest"):
        rows = rows.join(F.broadcast(rows.groupBy(end).agg(F.count("*").alias(f"n_{end}"))), end)
    alike = F.greatest("n_least", "n_greatest")
    train = materialize(rows.select("text", "toxic", F.pmod(F.xxhash64("least"), F.lit(FOLDS)).cast("int").alias("fold"), (1 / alike).alias("vote")), "votes")
    docs_by = np.zeros((FOLDS, 2))
    for r in train.groupBy("fold", "toxic").agg(F.sum("vote").alias("n")).collect():
        docs_by[r["fold"], r["toxic"]] = r["n"]
    total = docs_by.sum(axis=0)
    if not (total - docs_by > 0).all():
        return Model([], 1.0, 1.0, 0.0, 1.0, float(total[1] / max(total.sum(), 1)))
    grams, words = counted(train)
    every = grams.sum(axis=0), words.sum(axis=0)
    without = [Odds.of(every[0] - grams[f], every[1] - words[f], total - docs_by[f]) for f in range(FOLDS)]
    del grams, words, every
    # The scores of all segments of a labelled document; at most one for each two words.
    seen = crossed(train, without).collect()
    law = np.array([(r["n"], max(r["best"], default=0.0)) for r in seen if r["toxic"] == 0 and r["n"]]).reshape(-1, 2)
    bare = Model(without, *extreme_law(law[:, 0], law[:, 1]), 0.0, 1.0)
    x, y = np.array([bare.evidence(np.array(r["best"]), r["n"]) for r in seen]), np.array([r["toxic"] for r in seen])
    return Model(without, bare.decay, bare.rate, halfway(x, y), slope_of(x, y))


def crossed(train: DataFrame, models: list[Odds]) -> DataFrame:
    """toxic, n (distinct words) and best (scores of all segments) by the model that has not seen the document's fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lexicons = [Lexicon([m], ENTRIES // FOLDS) for m in models]
        for batch in batches:
            out = []
            for text, fold in zip(batch.column(0), batch.column(2).to_pylist()):
                tokens = WORD.findall((text.as_py() or "").lower())
                scores, distinct = lexicons[fold].scores(tokens)
                out.append((distinct, [s for *_, s in passages(scores)]))
            n, best = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(best, pa.list_(pa.float64()))], ["toxic", "n", "best"])

    return train.select("text", "toxic", "fold").mapInArrow(run, "toxic int, n long, best array<double>")


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns with score and passages (start, end, score, expected), places in code points."""
    bounded_batches(docs)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.odds, ENTRIES)
        sole(lexicon.cache)
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            scores, shown = [], []
            for text in batch.column(0):
                low = (text.as_py() or "").lower() if model.odds else ""
                tokens = WORD.findall(low)
                values, distinct = lexicon.scores(tokens) if tokens else (np.array([]), 0)
                found = passages(values)
                best = np.array([s for *_, s in found])
                expected = model.expected(best, distinct)
                at = [m.span() for m in WORD.finditer(low)] if (expected < SIGNIFICANT).any() else []
                shown.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": e} for (a, b, s), e in zip(found, expected.tolist()) if e < SIGNIFICANT])
                scores.append(model.score(model.evidence(best, distinct)) if model.constant is None else model.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(shown, passage)], [*keep, "score", "passages"])
        # Of no use to the next task, which has models of its own.
        forget()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double, passages array<struct<start:int,end:int,score:double,expected:double>>"])
    return docs.select("text", *keep).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, passages.

    A null or empty text has no segment and scores what the curve gives no evidence. Every row is scored by its
    whole text alone, so repeated rows score alike. A null id is not held out. Places are those in the text put
    to lower case. Other columns are ignored; an empty table gives no rows.
    """
    rows = scored(docs, fit(docs, labels, sample), "doc_id")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows, all columns, whose score is below 0.5."""
    names = docs.columns
    rows = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return scored(rows, fit(docs, labels, sample), "_row").where("score < 0.5").select("_row.*")
