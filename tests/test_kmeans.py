import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from sparkclust import distances, fit, points_from_array, points_from_columns, predict, seed_first_k
from sparkclust.operators.update import step_stats


def pts(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def lloyd_numpy(X, k, iters, threshold=None):
    """Plain transcription of the training contract."""
    n, d = X.shape
    C = np.zeros((k, d))
    C[: min(n, k)] = X[:k]
    m_prev = np.full(n, -1)
    hist = []
    for t in range(iters):
        D = ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1)
        m = D.argmin(1)
        delta = (m != m_prev).mean()
        newC = C.copy()
        for j in range(k):
            if (m == j).any():
                newC[j] = X[m == j].mean(0)
        hist.append(delta)
        C_prev, C, m_prev = C, newC, m
        if threshold is not None and not (delta > threshold):
            break
    return C, m, hist


def test_two_ties_lowest_index(spark):
    p = pts(spark, [[0], [2], [1]])
    assert {r["id"]: r["cluster_id"] for r in predict(p, [[0.0], [2.0]]).collect()} == {0: 0, 1: 1, 2: 0}


def test_dup_seeds_keep_empty_centre(spark):
    p = pts(spark, [[5], [5], [9]])
    run = fit(p, 2, max_iter=1)
    assert run.centers == [[19.0 / 3.0], [5.0]]


def test_short_input_zero_padding(spark):
    p = pts(spark, [[4, 4], [6, 6]])
    assert seed_first_k(p, 4) == [[4.0, 4.0], [6.0, 6.0], [0.0, 0.0], [0.0, 0.0]]
    run = fit(p, 4, max_iter=2)
    assert run.centers[2:] == [[0.0, 0.0], [0.0, 0.0]]


def test_lagged_membership(spark):
    p = pts(spark, [[0], [1], [10]])
    run = fit(p, 2, max_iter=1)
    assert {r["id"]: r["cluster_id"] for r in run.membership.collect()} == {0: 0, 1: 1, 2: 1}
    assert run.centers == [[0.0], [5.5]]
    final = fit(p, 2, max_iter=1, membership="final")
    assert {r["id"]: r["cluster_id"] for r in final.membership.collect()} == {0: 0, 1: 0, 2: 1}


def test_empty_input_and_bad_args(spark):
    with pytest.raises(ValueError):
        fit(pts(spark, []).where("id < 0"), 2)
    with pytest.raises(ValueError):
        fit(pts(spark, [[1]]), 1, max_iter=0)
    # the width check runs inside the pass and fails the job
    with pytest.raises(Exception, match="different widths"):
        predict(pts(spark, [[1, 2]]), [[1.0]]).collect()
    with pytest.raises(Exception, match="different widths"):
        predict(pts(spark, [[1, 2]]), [[1.0] * 20], path="arrow").collect()


@pytest.mark.parametrize("path", ["expr", "arrow"])
def test_matches_numpy_contract(spark, path):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet").orderBy("c_custkey")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    X = np.array([r["features"] for r in p.orderBy("id").collect()])
    C, m, hist = lloyd_numpy(X, 5, 4)
    run = fit(p, 5, max_iter=4, path=path, track_delta="all")
    assert np.allclose(np.array(run.centers), C, rtol=1e-9, atol=1e-6)
    got = dict((r["id"], r["cluster_id"]) for r in run.membership.collect())
    ids = [r["id"] for r in p.orderBy("id").collect()]
    assert [got[i] for i in ids] == list(m)
    assert [h["delta"] for h in run.history] == pytest.approx(hist)


def test_threshold_stop(spark):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    X = np.array([r["features"] for r in p.orderBy("id").collect()])
    for thr in (1.0, 0.1, 0.01):
        C, _, hist = lloyd_numpy(X, 5, 20, threshold=thr)
        run = fit(p, 5, max_iter=20, threshold=thr, stop="threshold")
        assert run.n_iter == len(hist)
        assert np.allclose(np.array(run.centers), C, rtol=1e-9, atol=1e-6)
        assert run.history[-1]["delta"] <= thr or run.n_iter == 20


def test_expr_and_arrow_paths_agree_wide(spark):
    e = points_from_array(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "vec_id", "embedding")
    a = fit(e, 7, max_iter=3, path="expr", track_delta="all")
    b = fit(e, 7, max_iter=3, path="arrow", track_delta="all")
    assert np.allclose(np.array(a.centers), np.array(b.centers), atol=1e-9)
    assert [h["changed"] for h in a.history] == [h["changed"] for h in b.history]
    ma = {r["id"]: r["cluster_id"] for r in a.membership.collect()}
    mb = {r["id"]: r["cluster_id"] for r in predict(e, b.previous, path="arrow").collect()}
    assert ma == mb


def test_properties_inertia_sizes_and_lag(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = points_from_columns(o, "o_orderkey", ["o_totalprice", F.month("o_orderdate")])
    inertia = []
    centers = seed_first_k(p, 4)
    for _ in range(4):
        st = step_stats(p, centers)
        assert sum(st.n) == 1500
        # inertia against the current centres
        C = np.array(centers)
        X = {r["id"]: r["features"] for r in p.collect()}
        M = {r["id"]: r["cluster_id"] for r in predict(p, centers).collect()}
        inertia.append(sum(((np.array(X[i]) - C[M[i]]) ** 2).sum() for i in X))
        centers = [[s / n for s in st.sums[k]] if n else centers[k] for k, n in enumerate(st.n)]
    assert all(b <= a + 1e-6 * a for a, b in zip(inertia, inertia[1:]))
    run = fit(p, 4, max_iter=3)
    lagged = {r["id"]: r["cluster_id"] for r in run.membership.collect()}
    again = {r["id"]: r["cluster_id"] for r in predict(p, run.previous).collect()}
    assert lagged == again


def test_partition_count_independent_on_integers(spark):
    pt = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    p = points_from_columns(pt, "p_partkey", ["p_size", F.length("p_type")])
    a = fit(p.repartition(1), 5, max_iter=4)
    b = fit(p.repartition(7), 5, max_iter=4)
    assert a.centers == b.centers
    assert sorted(map(tuple, a.membership.collect())) == sorted(map(tuple, b.membership.collect()))


def test_checkpoint_cache_same_result(spark):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    a = fit(p, 4, max_iter=3)
    b = fit(p, 4, max_iter=3, cache="checkpoint")
    assert a.centers == b.centers
    assert sorted(map(tuple, a.membership.collect())) == sorted(map(tuple, b.membership.collect()))


def test_bad_rows_are_reported(spark):
    nulls = spark.createDataFrame([(0, [1.0, 2.0]), (2, [1.0, None])], "id long, features array<double>")
    with pytest.raises(ValueError, match="missing coordinate"):
        fit(nulls, 1, max_iter=1)
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "id long, features array<double>")
    with pytest.raises(Exception):
        fit(short, 1, max_iter=1)


def test_track_delta_modes(spark):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    full = fit(p, 4, max_iter=4)
    last = fit(p, 4, max_iter=4, track_delta="last")
    none = fit(p, 4, max_iter=4, track_delta="none")
    assert full.centers == last.centers == none.centers
    assert [h["changed"] for h in last.history] == [full.history[0]["changed"], None, None, full.history[-1]["changed"]]
    assert [h["changed"] for h in none.history][1:] == [None, None, None]
    with pytest.raises(ValueError):
        fit(p, 4, max_iter=4, stop="threshold", threshold=0.1, track_delta="last")


def test_seed_order_column(spark):
    df = spark.createDataFrame([(0, 3, [0.0]), (1, 1, [10.0]), (2, 2, [20.0])], "id long, pos int, features array<double>")
    run = fit(df, 2, max_iter=1, order_by="pos")
    assert run.previous == [[10.0], [20.0]]


def lloyd_numpy_float(X, k, iters):
    """The contract with 32-bit coordinates and distances (multiply, then add, left to right)."""
    X32 = X.astype(np.float32)
    C = np.zeros((k, X.shape[1]), dtype=np.float32)
    C[: min(len(X), k)] = X32[:k]
    for _ in range(iters):
        D = np.zeros((len(X32), k), dtype=np.float32)
        for j in range(X.shape[1]):
            diff = X32[:, j : j + 1] - C[None, :, j]
            D = D + diff * diff
        m = D.argmin(1)
        newC = C.copy()
        for c in range(k):
            if (m == c).any():
                newC[c] = np.float32(X32[m == c].astype(np.float64).sum(0) / (m == c).sum())
        C = newC
    return C.astype(np.float64), m


def test_float_precision_matches_single_precision_contract(spark):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    X = np.array([r["features"] for r in p.orderBy("id").collect()])
    C, m = lloyd_numpy_float(X, 5, 4)
    a = fit(p, 5, max_iter=4, precision="float", path="expr", track_delta="all")
    b = fit(p, 5, max_iter=4, precision="float", path="arrow", track_delta="all")
    assert a.centers == b.centers
    assert [h["changed"] for h in a.history] == [h["changed"] for h in b.history]
    assert np.allclose(np.array(a.centers), C, rtol=1e-6)
    assert all(float(np.float32(v)) == v for row in a.centers for v in row)
    ids = [r["id"] for r in p.orderBy("id").collect()]
    got = {r["id"]: r["cluster_id"] for r in a.membership.collect()}
    lagged_prev = a.previous
    # lagged membership = assignment against C_(T-1), checked against the float formula
    Xf, Cp = X.astype(np.float32), np.array(lagged_prev, dtype=np.float32)
    D = np.zeros((len(Xf), 5), dtype=np.float32)
    for j in range(X.shape[1]):
        diff = Xf[:, j : j + 1] - Cp[None, :, j]
        D = D + diff * diff
    assert [got[i] for i in ids] == list(D.argmin(1))


@pytest.mark.parametrize("d", [2, 64])
def test_training_is_the_same_for_1_and_400_partitions(spark, d):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, d).alias("embedding"))
    e = points_from_array(e, "vec_id", "embedding")
    one, many = (fit(e.repartition(n), 5, max_iter=3) for n in (1, 400))
    assert np.allclose(np.array(one.centers), np.array(many.centers), atol=1e-12)
    assert [h["changed"] for h in one.history] == [h["changed"] for h in many.history]


@pytest.mark.parametrize("d", [2, 16, 64])
@pytest.mark.parametrize("odd", ["short and long", "null", "nan", "inf", "-inf", "null row"])
def test_bad_rows_raise_everywhere(spark, d, odd):
    rows = [(i, [float(i + j) for j in range(d)]) for i in range(6)]
    if odd == "short and long":  # their total is right, no single one is
        rows += [(10, [0.0] * (d - 1)), (11, [0.0] * (d + 1))]
    elif odd == "null row":
        rows += [(10, None)]
    else:
        value = {"null": None, "nan": float("nan"), "inf": float("inf"), "-inf": float("-inf")}[odd]
        rows += [(10, [value] + [0.0] * (d - 1))]
    p = spark.createDataFrame(rows, "id long, features array<double>").coalesce(1)
    centers = [[0.0] * d, [5.0] * d]
    for path in ("arrow", "expr"):
        with pytest.raises(ValueError, match="wrong width"):
            fit(p, 2, max_iter=1, path=path, init=centers)
        with pytest.raises(Exception, match="different widths"):
            predict(p, centers, path=path).collect()
    assert predict(p.where("id < 10"), centers).count() == 6


def test_bad_sparse_rows_raise(spark):
    good = (0, (4, [1, 3], [1.0, 2.0]))
    schema = "id long, features struct<size:int,idx:array<int>,val:array<double>>"
    for bad in ((4, [1, 4], [1.0, 2.0]), (4, [-1], [1.0]), (5, [1], [1.0]), (4, [1, 2], [1.0]), (4, [1], [float("nan")]), (4, [1], [None]), None):
        p = spark.createDataFrame([good, (1, bad)], schema)
        with pytest.raises(Exception, match="different widths"):
            predict(p, [[0.0] * 4, [1.0] * 4]).collect()
        with pytest.raises(ValueError, match="wrong width"):
            fit(p, 1, max_iter=1, init=[[0.0] * 4])


def test_models_beyond_a_plan_literal(spark, monkeypatch):
    import sparkclust.operators.assign as A

    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    centers = seed_first_k(p, 4)
    small = [sorted(map(tuple, df.collect())) for df in (predict(p, centers), distances(p, centers))]
    monkeypatch.setattr(A, "MAX_LITERAL_VALUES", 4)
    assert small == [sorted(map(tuple, df.collect())) for df in (predict(p, centers), distances(p, centers))]
