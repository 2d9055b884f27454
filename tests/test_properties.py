"""Property tests: the three nearest-centre implementations agree, ties included."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import sparkclust.functions.vector as V
from sparkclust.operators.update import Chunk, nearest

small_ints = st.integers(min_value=-3, max_value=3)


def brute(points, centers):
    out = []
    for p in points:
        best, arg = None, 0
        for k, c in enumerate(centers):
            d = sum((a - b) * (a - b) for a, b in zip(p, c))
            if best is None or d < best:
                best, arg = d, k
        out.append(arg)
    return out


@settings(max_examples=12, deadline=None)
@given(
    d=st.integers(min_value=1, max_value=3),
    k=st.integers(min_value=1, max_value=4),
    data=st.data(),
)
def test_nearest_paths_agree(spark, d, k, data):
    n = 12
    pts = [[float(data.draw(small_ints)) for _ in range(d)] for _ in range(n)]
    cen = [[float(data.draw(small_ints)) for _ in range(d)] for _ in range(k)]
    want = brute(pts, cen)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id long, features array<double>")
    unrolled = [r["cluster_id"] for r in V.with_nearest(df, cen).orderBy("id").collect()]
    old = V.MAX_UNROLLED_VALUES
    V.MAX_UNROLLED_VALUES = 0
    try:
        lam = [r["cluster_id"] for r in V.with_nearest(df, cen).orderBy("id").collect()]
    finally:
        V.MAX_UNROLLED_VALUES = old
    assert unrolled == want
    assert lam == want
    assert list(nearest(Chunk(n, 0, dense=np.array(pts)), np.array(cen))) == want
    where, idx = np.nonzero(np.array(pts))
    sparse = Chunk(n, 0, where=where, idx=idx, val=np.array(pts)[where, idx])
    assert list(nearest(sparse, np.array(cen))) == want
