import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftline.llm import substrings
from siftline.llm.substrings import remove_repeats, removal_report, window_minima

SCHEMA = "doc_id long, text string, a int, ranges string"


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(rows, size):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = split(t)
            for p in range(len(w) - size + 1):
                k = tuple(w[p : p + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        out.append((i, len(w), len(gone), [x for p, x in enumerate(w) if p not in gone]))
    return out


def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["Ünï", "x\x1cy", "."]
    passage, line = [" ".join(rng.choices(words, k=n)) for n in (40, 14)]
    out = [(i, t, 1, "r") for i, t in enumerate([None, "", " \n\t ", "one two", " ".join(["a"] * 3000), " ".join(["a"] * 20)])]
    for i in range(6, 160):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(2)]
        extra = rng.choice([passage, line, passage[:90], "", line + "\n" + line])
        out.append((i * 7 % 160 + 10, parts[0] + " \n" + extra + "  " + parts[1], 1, "r"))
    out += [(500 + i, passage + " end", 1, "r") for i in range(60)]  # more copies than are listed
    return out + [(None, passage, 1, "r"), (None, passage, 1, "r"), (700, line + " " + passage, 1, "r"), (700, line + " " + passage, 1, "r")]


@pytest.mark.parametrize("size", [13, 5, 2])
def test_report(spark, size):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in removal_report(frame, size).collect())
    assert got == Counter((i, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, gone, kept in brute(rows(), size))


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 2000)
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = remove_repeats(frame).collect()
    assert frame.columns == remove_repeats(frame).columns
    assert Counter((r.doc_id, *split(r.text)) for r in got) == Counter((i, *kept) for i, _, _, kept in brute(rows(), 13))
    same = {i: t for i, t, *_ in rows()}
    assert all(r.text == same[r.doc_id] for r in got if len(split(r.text)) == len(split(same[r.doc_id])))


def test_equal_hashes_are_told_apart(monkeypatch):
    ids, lengths, docs = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2], "i4"), np.array([3, 3, 3]), np.array([5, 4, 9])
    assert window_minima(ids, lengths, docs, 3).tolist() == [5, 4, 5]
    monkeypatch.setattr(substrings, "mixed", lambda h: h * np.uint64(0))
    assert window_minima(ids, lengths, docs, 3).tolist() == [5, 4, 5]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert removal_report(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_clashing_columns(spark):
    names = ["_ranges", "_key", "_row", "doc", "a", "b", "ranges"]
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, body, *names), (2, body, *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = remove_repeats(frame).orderBy("doc_id").collect()
    assert [r.text for r in got] == [body, ""] and all(r[n] == n for r in got for n in names)
