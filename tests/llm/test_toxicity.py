import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftline.llm.toxicity import drop_toxic, fit, score_documents, segments


def brute(scores):
    """Ruzzo and Tompa's definition: take the best segment, then the best of what lies left and right of it."""
    def best(a, b):
        options = [(-sum(scores[i:j]), j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        if not options or min(options)[0] >= 0:
            return []
        _, _, i, j = min(options)
        return best(a, i) + [(i, j, sum(scores[i:j]))] + best(j, b)

    return best(0, len(scores))


@given(st.lists(st.integers(-4, 4).map(lambda x: x + 0.0), max_size=14))
def test_segments_cover_the_best(scores):
    got = segments(scores)
    assert got == sorted(got) and all(a[1] <= b[0] for a, b in zip(got, got[1:])) and all(s > 0 for *_, s in got)
    want = brute(scores)
    assert max((s for *_, s in got), default=0) == max((s for *_, s in want), default=0)
    assert sum(s for *_, s in got) == sum(s for *_, s in want)


def test_segments_are_linear():
    assert len(segments([1.0, -2.0] * 100_000)) == 100_000
    assert segments([1.0, -0.5] * 100_000) == [(0, 199_999, 50_000.5)]


def corpus():
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["vile", "rotten", "abominable"]
    rows, labels = [], []
    for i in range(900):
        own = rng.choices(words, k=rng.randint(5, 200))
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 4) * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own), 0.0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


ROWS = "doc_id long, text string, score double"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    rows += [(1000, None, 0.0), (1001, "", 0.0), (1002, "wa " * 60_000 + "vile rotten vile abominable", 0.0), (None, "calm words", 0.0), (3, rows[3][1], 0.0)]
    labels += [(None, 1, 1), (1000, None, None), (5, 0, 7), (4, 1, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(tables):
    got = score_documents(*tables).collect()
    assert len(got) == tables[0].count()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    held = [r for r in known if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in known)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == by[None].predicted == 0 and by[1002].predicted == 1
    text = corpus()[0][0][1]
    assert any(text[p.start : p.end].split()[0] in ("vile", "rotten", "abominable") for p in by[0].passages)


def test_filter_keeps_columns(tables):
    kept = drop_toxic(*tables)
    assert kept.schema == tables[0].schema
    ids = [r.doc_id for r in kept.collect()]
    assert 1000 in ids and None in ids and 1002 not in ids and len(ids) < tables[0].count()


def test_nothing_to_learn(spark, tables):
    none = spark.createDataFrame([], LABELS)
    assert fit(tables[0], none).constant == 0
    assert {r.score for r in score_documents(tables[0], none).collect()} == {0.0}
    assert score_documents(spark.createDataFrame([], ROWS), tables[1]).count() == 0
