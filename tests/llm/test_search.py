import math

import numpy as np
import pytest

from siftline.llm.exact_topk import exact_topk, products
from siftline.llm.nearest import dot, nearest

SCHEMA = "vec_id long, embedding array<float>, score int"


def rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in rng.normal(size=12).astype("float32")], 0) for i in range(420)]
    out += [(500 + i, out[7][1], 0) for i in range(120)]  # copies tie
    out += [(900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (903, [math.nan] * 12, 0), (904, [None] + [1.0] * 11, 0), (905, [math.inf] + [0.0] * 11, 0), (None, [1.0] * 12, 0)]
    return out + [out[20], out[21], (1000, [1.0, 2.0], 0), (1001, [2.0, -1.0], 0)]


def good(zero):
    found = {}
    for i, v, _ in rows():
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            found[i] = np.array(v, "float64")
    return found


def brute(found, every, k, score):
    out = set()
    for q in (q for q in found if q % every == 0):
        ranked = sorted((-score(found[q], v), i) for i, v in found.items() if i != q and len(v) == len(found[q]))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked[:k], 1)}
    return out


@pytest.mark.parametrize("size", [64, 8192])
def test_nearest(spark, size):
    got = nearest(spark.createDataFrame(rows(), SCHEMA), query_rows=16, rows=size).collect()
    want = brute(good(False), 20, 20, lambda a, b: float(dot(a[None], b[None])[0]))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("size", [9, 8192])
def test_exact(spark, size):
    got = exact_topk(spark.createDataFrame(rows(), SCHEMA), query_rows=2, rows=size).collect()
    want = brute(good(True), 100, 10, lambda a, b: int(np.floor(1024 * a) @ np.floor(1024 * b)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("search", [nearest, exact_topk])
def test_empty(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overflow_is_defined(spark):
    big = [(i, [1e200 if i % 3 else -1e200, 1e200 * (i % 2), 1.0 * i]) for i in range(40)]
    got = nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=5).collect()
    assert len(got) == 10 and all(r.score == math.inf for r in got)
    best = sorted(i for i, v in big if i and sum(int(a) * int(b) for a, b in zip(v, big[0][1])) > 2**1024)[:5]
    assert [r.vec_id for r in sorted(got) if r.query_id == 0] == best
    a = np.array([[2.0**40, -(2.0**31)]])
    assert products(a, np.array([[2.0**22, 2.0**31], [1.0, 2.0]])).tolist() == [[0, 2**40 - 2**32]]
    with pytest.raises(OverflowError):
        products(a, np.array([[2.0**40, 0.0]]))
