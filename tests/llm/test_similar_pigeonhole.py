"""The step of near-duplicate detection that is method 1: 64-bit fingerprints through the generalised pigeonhole."""

import random

from siftline.llm.similar import similar_groups


def test_few_bits_link_without_wide_fingerprints(spark):
    """With no class probed only equal sets of shingles were linked."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)] + [(200, ""), (201, None), (202, "a b")]
    got = dict(map(tuple, similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), probes=0).collect()))
    assert len(got) == len(rows) and got[201] == 200 and got[202] == 202
    assert all(got[i] == i and got[100 + i] in (i, 100 + i) for i in range(20))
    assert sum(got[100 + i] == i for i in range(20)) >= 15


def test_links_are_verified(spark):
    """Fingerprints of few shingles may agree in all but two bits by chance; only similar sets are linked."""
    rows = [(i, " ".join(f"{w}{i}" for w in "abcdefg")) for i in range(200)]
    got = dict(map(tuple, similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: i for i in range(200)}
