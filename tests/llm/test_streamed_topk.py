"""The streamed search: what a task holds and what is sent."""

import numpy as np
import pytest

from siftline.llm.exact_topk import Best, decode, encode, exact_topk


def test_components_travel_as_short_integers():
    """They were sent as doubles, and once for each block of candidates."""
    m = np.array([[0.5, -0.25, 0.0001], [1.0, -1.0, 31.9]])
    ids = np.arange(2, dtype="<i8").tobytes()
    assert len(encode(m)) == 12 and decode(ids, encode(m), 3)[1].tolist() == np.floor(1024 * m).tolist()
    m[0, 0] = 32.0
    assert len(encode(m)) == 48 and decode(ids, encode(m), 3)[1].tolist() == np.floor(1024 * m).tolist()
    with pytest.raises(OverflowError):
        encode(np.array([[1e308]]))


@pytest.mark.parametrize("scale", [1, 40, 3000])
def test_blocks_pass_by(scale):
    """Ties, copies and queries among the candidates, in blocks of single, of double and of both precisions."""
    rng = np.random.default_rng(scale)
    m = np.floor(1024 * np.r_[rng.normal(size=(300, 8)) * 0.2, np.tile(rng.normal(size=(1, 8)), (400, 1)), rng.integers(-1, 2, (300, 8)), scale * rng.normal(size=(200, 8))])
    ids = rng.permutation(len(m)).astype("i8")
    best, at = Best(10), np.flatnonzero(ids % 3 == 0)
    short = lambda x: x.astype("f4") if np.abs(x).max() < 2**15 else x
    best.ask(0, ids[at], short(m[at]))
    best.begin()
    for a in range(0, len(m), 150):
        order = a + np.argsort(ids[a : a + 150])
        best.meet(ids[order], short(m[order]))
    got = {}
    for _, query, found, score in best.rows():
        for q, f, s in zip(query.tolist(), found.tolist(), score.tolist()):
            got.setdefault(q, []).append((-s, f))
    exact = m.astype("i8")
    for i in at:
        want = sorted((-int(s), int(j)) for s, j in zip(exact @ exact[i], ids) if j != ids[i])[:10]
        assert got[int(ids[i])] == want


def test_groups_and_parts(spark, monkeypatch):
    """Several groups of queries, several parts of candidates, and more than one level of the tree."""
    from siftline.llm import exact_topk as module

    monkeypatch.setattr(module, "GROUP", 2)
    monkeypatch.setattr(module, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(400)]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, queries=module.F.col("id") % 20 == 0, query_rows=5, rows=20).collect()
    v = {i: 1024 * np.array(x, "i8") for i, x in rows}
    want = {(q, n, j, -s) for q in v if q % 20 == 0 for n, (s, j) in enumerate(sorted((-int(v[q] @ x), j) for j, x in v.items() if j != q)[:5], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
