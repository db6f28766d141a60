import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from siftline.llm import similar
from siftline.llm.fingerprints import shingles
from siftline.llm.similar import drop_similar, similar_groups

SCHEMA = "doc_id long, text string, id int"


def brute(rows):
    parent = {i: i for i, *_ in rows if i is not None}
    sets = [(i, set(shingles((t or "").encode(), 5))) for i, t, *_ in rows if i is not None]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b) and root(i) != root(j):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}


def corpus(rng, groups, size):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 9, 25, 60, 150, 500]))
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 60, len(base) // 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_groups(spark):
    texts = [None, "", " \n", "A b", "a B", "one", "w " * 30_000, *corpus(random.Random(3), 60, 8)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, "one", 0), (None, "one", 0), (None, None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = {r.doc_id: r.group for r in similar_groups(frame).collect()}
    assert got == want
    kept = drop_similar(frame)
    assert kept.schema == frame.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([i for i, *_ in rows if i is None or want[i] == i], key=str)


@pytest.mark.parametrize("paired", [1, 3])
def test_crowded_values(spark, monkeypatch, paired):
    monkeypatch.setattr(similar, "PAIRED", paired)
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(60))
    near = [f"{shared} {' '.join(f't{i}' for i in range(200))} end{k}" for k in range(120)]
    apart = [f"{shared} {' '.join(rng.choices([f'u{i}' for i in range(900)], k=90))}" for _ in range(60)]
    rows = [(i, t, 0) for i, t in enumerate(near + apart)]
    got = {r.doc_id: r.group for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def hub(rng, copies, at):
    """An original at one place among copies that are near it, most of them not near each other."""
    base = [f"b{i}" for i in range(300)]
    out = []
    for k in range(copies):
        own = list(base)
        for p in rng.sample(range(2, 298), 6):
            own[p] = f"e{k}-{p}"
        out.append(" ".join(own))
    out.insert(at, " ".join(base))
    return out


@pytest.mark.parametrize("at", [75, 150])
def test_original_is_not_the_smallest(spark, at):
    rows = [(i, t, 0) for i, t in enumerate(hub(random.Random(5), 150, at))]
    got = {r.doc_id: r.group for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(set(got.values())) < 5


def test_shared_template(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(7)
    template = " ".join(f"t{i}" for i in range(120))
    texts = []
    for k in range(40):
        own = [f"own{k}-{i}" for i in range(40)]
        texts += [f"{template} {' '.join(own)}", f"{template} {' '.join(own[:-2])} x{k} y{k}", f"{template} {' '.join(own[:-4])}"]
    rng.shuffle(texts)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.group for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(set(got.values())) == 40


@pytest.mark.parametrize("two", [True, False])
def test_links_of_a_tile(monkeypatch, two):
    monkeypatch.setattr(similar, "STEP", 7)
    rng = random.Random(11)
    sets = []
    for _ in range(12):
        base = rng.sample(range(100), rng.choice([4, 20, 40]))
        sets += [sorted(set(base) - set(rng.sample(base, k)) | set(rng.sample(range(100), k))) for k in (0, 1, 2, 4)]
    labels = [100 + i // 2 if i % 5 == 0 else i for i in range(len(sets))]
    whole = (np.array(labels), [np.array(s, "<u8") for s in sets])
    parts = [(whole[0][::2], whole[1][::2]), (whole[0][1::2], whole[1][1::2])] if two else [whole, None]
    got = similar.links(*parts, 0.8)
    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if not two or i % 2 != j % 2]
    want = [(labels[i], labels[j]) for i, j in pairs if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) and labels[i] != labels[j]]

    def parted(edges):
        of = {n: {n} for n in labels}
        for a, b in edges:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for n in of[b]:
                    of[n] = of[a]
        return {frozenset(x) for x in of.values()}

    assert want and parted(got) == parted(want) and len(got) == len(set(labels)) - len(parted(want))


def test_empty(spark):
    assert drop_similar(spark.createDataFrame([], SCHEMA)).count() == 0
