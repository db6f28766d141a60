import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from siftline.llm import simhash
from siftline.llm.fingerprints import shingles
from siftline.llm.simhash import add_fingerprint, allocate, links, near_duplicates, partition_bits, plan


def brute_fingerprint(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    found = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    """key -> smallest linked key, over all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def check(rows, got):
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    of = classes(sorted(set(fp.values())), 2)
    least = defaultdict(list)
    for i, f in fp.items():
        least[of[f]].append(i)
    want = Counter((i, fp[i], min((x for x in least[of[fp[i]]] if x is not None), default=None)) for i, *_ in rows)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_documents(spark):
    rng = random.Random(1)
    words = ["Alpha", "beta", "ÉÀ", "delta", "x", "yy", "zzz", "\x1c", "mü"]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "one two three", "w " * 50_000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(150)]
    base = [rng.choice(words) + str(rng.randint(0, 500)) for _ in range(400)]
    for _ in range(150):
        own = list(base)
        own[rng.randrange(400)] = "changed"
        texts.append(" ".join(own) + "\n")
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no key at all", 1), (5, texts[5], 2), (5, texts[5], 2)]
    check(rows, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect())


def chains(rng):
    """Groups of close fingerprints: long chains, dense balls, and strangers."""
    out = {rng.getrandbits(64) for _ in range(300)}
    at = rng.getrandbits(64)
    for _ in range(120):
        out.add(at)
        for b in rng.sample(range(64), 2):
            at ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(500):
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


def test_links_connect_all(spark, monkeypatch):
    fps = chains(random.Random(2))
    frame = spark.createDataFrame([(int(np.uint64(f).view("int64")),) for f in fps], "fp long")
    for radius in (0, 1, 2):
        want = classes(fps, radius)
        for paired in (2, 64):
            monkeypatch.setattr(simhash, "PAIRED", paired)
            got = [(r.a % 2**64, r.b % 2**64) for r in links(frame, radius).collect()]
            assert all(0 < (a ^ b).bit_count() <= radius for a, b in got)
            parent = {f: f for f in fps}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in got:
                parent[root(a)] = root(b)
            group, expect = defaultdict(set), defaultdict(set)
            for f in fps:
                group[root(f)].add(f)
                expect[want[f]].add(f)
            assert sorted(map(sorted, group.values())) == sorted(map(sorted, expect.values()))


def test_thresholds():
    cost, chosen = allocate([[0, 5, 50], [0, 1, 3], [0, 2, 90]], 0)
    assert sum(chosen) == 0 and (cost, chosen) == (5.0, [-1, 1, 0])
    rng = np.random.default_rng(0)
    correlation = np.abs(rng.normal(size=(64, 64)))
    parts = partition_bits(correlation + correlation.T, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    # The more there are, the wider the partitions.
    few, many = (min(len(part) for part, _ in plan(n, np.full(64, 0.5), correlation, 2)) for n in (1000, 10**11))
    assert few < many


def test_shingles_keep_words_whole():
    assert shingles("A b c\x1cd E".encode(), 2) == ["a b c\x1cd".encode(), "b c\x1cd e".encode()]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and add_fingerprint(empty, 3).count() == 0
