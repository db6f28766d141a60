import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from siftline.llm.sharding import fits, minimax_cuts, shard_documents


def best(sizes, shards):
    """Smallest largest part over all contiguous partitions, by dynamic programming."""
    inf = float("inf")
    row = [0] + [inf] * len(sizes)
    for _ in range(shards):
        row = [min(max(row[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return row[-1]


@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 5))
def test_minimax_is_optimal(sizes, shards):
    capacity, cuts = minimax_cuts(sizes, shards)
    assert capacity == (best(sizes, shards) if sizes else 0)
    edges = [0, *cuts, len(sizes)]
    assert edges == sorted(edges) and len(cuts) == shards - 1
    assert all(sum(sizes[a:b]) <= capacity for a, b in zip(edges, edges[1:]))


def test_shards(spark):
    texts = [None, "", "a", "ä" * 50, "same", "x" * 100_000, *(f"text {i}" * (i % 40) for i in range(300)), *["same"] * 200]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "none", 2), (7, "text 1", 3), (7, "text 1", 3)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()
    assert len(got) == len(rows)
    slots, of_text = defaultdict(list), defaultdict(set)
    text_of = {i: t or "" for i, t, _ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
        assert r.size == len(text_of[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text_of[r.doc_id].encode())
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fits():
    assert fits([3, 5, 9], 2, 5) and not fits([3, 5, 9], 1, 8)
