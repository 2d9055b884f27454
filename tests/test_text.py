import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from sparkclust.functions.text import bucket_counts_numpy, chars_to_bigrams, row_string, row_text, text_chars, units_to_buckets, utf16_units
from sparkclust.plans.featurize import featurize_text, hashed_tf_dense, hashed_tf_long


def java_hash_bucket(term: str, n: int = 1000) -> int:
    h = 0
    for unit in np.frombuffer(term.encode("utf-16-le", "surrogatepass"), dtype="<u2"):
        h = (31 * h + int(unit)) & 0xFFFFFFFF
    if h >= 2**31:
        h -= 2**32
    return h % n


def reference_buckets(text: str) -> list[int]:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    s = text.encode("utf-16-le", "surrogatepass")
    terms = [s[2 * i : 2 * i + 4].decode("utf-16-le", "surrogatepass") for i in range(len(units) - 1)]
    if len(units) == 1:
        terms = [text]
    return [java_hash_bucket(t) for t in terms]


def test_texts_fixture(spark):
    df = spark.createDataFrame([(0, "hello world"), (1, ""), (2, None), (3, "a\U0001F600b")], "id long, t string")
    rows = df.select("id", row_text(F.col("t")).alias("r"), units_to_buckets(utf16_units(row_text(F.col("t")))).alias("b")).orderBy("id").collect()
    assert [r["r"] for r in rows] == ["[hello world]", "[]", "[null]", "[a\U0001F600b]"]
    for r in rows:
        assert r["b"] == reference_buckets(r["r"])
    # surrogate pair: 6 units -> 5 bigrams
    assert len(rows[3]["b"]) == 5
    # "he" hashes to 31*104+101 = 3325 -> 325
    assert java_hash_bucket("he") == 325


def test_unbracketed_edge_cases(spark):
    df = spark.createDataFrame([(0, "h"), (1, ""), (2, "ab")], "id long, t string")
    got = {r["id"]: r["b"] for r in df.select("id", units_to_buckets(utf16_units(F.col("t"))).alias("b")).collect()}
    assert got == {0: [104], 1: [], 2: [(31 * 97 + 98) % 1000]}
    units = df.select(utf16_units(F.lit("a\U0001F600")).alias("u")).first()["u"]
    assert units == [97, 0xD83D, 0xDE00]


def test_char_bigrams_and_row_string(spark):
    df = spark.createDataFrame([(1, "abc", None)], "id long, t string, l string")
    r = df.select(chars_to_bigrams(text_chars(F.col("t"))).alias("g"), row_string(F.lit(0), F.col("id"), F.col("l"), F.col("t"), F.lit(0)).alias("s")).first()
    assert r["g"] == ["ab", "bc"]
    assert r["s"] == "[0,1,null,abc,0]"


def test_sql_and_arrow_featurizers_agree(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = {r["id"]: r["features"] for r in hashed_tf_dense(d, "doc_id", "text", impl="arrow").collect()}
    b = {r["id"]: r["features"] for r in hashed_tf_dense(d, "doc_id", "text", impl="sql").collect()}
    assert a.keys() == b.keys() and all(a[k] == b[k] for k in a)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    k0 = min(texts)
    assert np.array_equal(np.array(a[k0]), bucket_counts_numpy("[" + texts[k0] + "]"))
    assert sum(a[k0]) == len("[" + texts[k0] + "]") - 1


def test_long_form_sql_and_arrow_agree(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = sorted(map(tuple, hashed_tf_long(d, "doc_id", "text", impl="sql").collect()))
    b = sorted(map(tuple, hashed_tf_long(d, "doc_id", "text", impl="arrow").collect()))
    assert a == b


def test_long_form_matches_dense(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    long_rows = hashed_tf_long(d, "doc_id", "text").collect()
    dense = {r["id"]: r["features"] for r in hashed_tf_dense(d, "doc_id", "text").collect()}
    for r in long_rows:
        assert dense[r["id"]][r["bucket"]] == r["tf"]
    assert sum(r["tf"] for r in long_rows) == sum(sum(v) for v in dense.values())


def test_featurize_index(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    f = featurize_text(d, "doc_id", "text", index_by="doc_id").collect()
    assert sorted(r["id"] for r in f) == list(range(d.count()))


def test_sparse_and_dense_training_agree(spark):
    from sparkclust import fit, predict
    from sparkclust.plans.featurize import hashed_tf_sparse

    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    dense = hashed_tf_dense(d, "doc_id", "text")
    sparse = hashed_tf_sparse(d, "doc_id", "text")
    row = sparse.orderBy("id").first()["features"]
    full = dense.orderBy("id").first()["features"]
    assert row["size"] == 1000 and [full[i] for i in row["idx"]] == row["val"]
    assert sum(full) == sum(row["val"])
    a = fit(dense, 5, max_iter=3, track_delta="all")
    b = fit(sparse, 5, max_iter=3, track_delta="all")
    assert a.centers == b.centers
    assert [h["changed"] for h in a.history] == [h["changed"] for h in b.history]
    assert sorted(map(tuple, a.membership.collect())) == sorted(map(tuple, b.membership.collect()))
    pa = sorted(map(tuple, predict(dense, b.centers).collect()))
    pb = sorted(map(tuple, predict(sparse, b.centers).collect()))
    assert pa == pb


def test_chunked_batches_same_result(spark, monkeypatch):
    import sparkclust.operators.update as U
    from sparkclust import fit
    from sparkclust.plans.featurize import hashed_tf_sparse

    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").coalesce(1)
    dense = hashed_tf_dense(d, "doc_id", "text")
    sparse = hashed_tf_sparse(d, "doc_id", "text")
    base = fit(dense, 4, max_iter=2, persist=False, track_delta="all")
    monkeypatch.setattr(U, "_CHUNK_ROWS", 7)
    a = fit(dense, 4, max_iter=2, persist=False, track_delta="all")
    b = fit(sparse, 4, max_iter=2, persist=False, track_delta="all")
    assert np.allclose(np.array(a.centers), np.array(base.centers), atol=1e-9)
    assert np.allclose(np.array(b.centers), np.array(base.centers), atol=1e-9)
    assert [h["changed"] for h in a.history] == [h["changed"] for h in b.history] == [h["changed"] for h in base.history]


def _peak_mb(work) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _reference_counts(text: str | None) -> dict[int, float]:
    from collections import Counter

    return {b: float(n) for b, n in Counter(reference_buckets(text or "")).items()}


ODD_TEXTS = ["", None, "h", "ab", "a\U0001F600b" * 30, "", "x" * 11, "hello world", "\U0001F600", None]


def test_bigrams_of_long_texts_and_batches_take_bounded_memory(monkeypatch):
    import sparkclust.functions.text as T

    texts = [f"{i} lorem ipsum dolor " * 1000 for i in range(400)]  # 9 million units
    assert _peak_mb(lambda: T.bucket_entries(texts)) < 100
    assert _peak_mb(lambda: T.bucket_entries(["".join(texts)])) < 100  # one text
    for size in (3, 4, 7, 1 << 18):
        monkeypatch.setattr(T, "SLICE_UNITS", size)
        row, bucket, count = T.bucket_entries(ODD_TEXTS)
        assert (np.diff(row * 1000 + bucket) > 0).all()
        for i, t in enumerate(ODD_TEXTS):
            assert dict(zip(bucket[row == i].tolist(), count[row == i].tolist())) == _reference_counts(t)


def test_sparse_histograms_leave_in_slices(spark):
    import pyarrow as pa

    from sparkclust.plans.featurize import _sparse_udf

    texts = [*ODD_TEXTS, *[f"{i} lorem ipsum" * 2000 for i in range(300)], "z\U0001F600" * 200_000, *ODD_TEXTS]
    parts = list(_sparse_udf(1000).func(iter([pa.array(texts[:200]), pa.array([], pa.string()), pa.array(texts[200:])])))
    assert len(parts) > 20
    got = [v for p in parts for v in p.to_pylist()]
    assert len(got) == len(texts)
    for i in (*range(12), 199, 200, *range(len(texts) - 11, len(texts))):
        assert got[i]["size"] == 1000 and dict(zip(got[i]["idx"], got[i]["val"])) == _reference_counts(texts[i])


def test_wide_sparse_rows_are_read_in_small_chunks():
    import pyarrow as pa

    from sparkclust.operators.update import read_chunk, vector_chunks

    n = 2000
    idx = pa.array([list(range(1000)) if i % 5 else [i % 1000] for i in range(n)], pa.list_(pa.int32()))
    val = pa.array([[float(i)] * (1000 if i % 5 else 1) for i in range(n)], pa.list_(pa.float64()))
    col = pa.StructArray.from_arrays([pa.array([1000] * n, pa.int32()), idx, val], ["size", "idx", "val"]).slice(3)
    chunks = list(vector_chunks([pa.RecordBatch.from_arrays([col], ["features"])], 1000))
    whole, _ = read_chunk(col, 1000)
    assert max(len(c.val) for c in chunks) <= 1 << 19
    assert sum(c.rows for c in chunks) == whole.rows == n - 3 and not sum(c.bad for c in chunks)
    assert np.array_equal(np.concatenate([c.val for c in chunks]), whole.val)
    assert np.array_equal(np.concatenate([c.idx for c in chunks]), whole.idx)
    first = np.cumsum([0, *[c.rows for c in chunks[:-1]]])
    assert np.array_equal(np.concatenate([c.where + f for c, f in zip(chunks, first)]), whole.where)


def test_dense_histograms_leave_in_slices(spark):
    import pyarrow as pa

    from sparkclust.plans.featurize import _dense_udf

    texts = pa.array([*ODD_TEXTS, *[f"{i} lorem ipsum" for i in range(10_000)], *ODD_TEXTS])
    lengths = []

    def work():
        for part in _dense_udf(1000).func(iter([texts])):  # 80 MB of histograms, few of them at a time
            lengths.append(len(part))

    assert _peak_mb(work) < 40
    assert sum(lengths) == len(texts) and max(lengths) <= 262
    got = [v for part in _dense_udf(1000).func(iter([texts])) for v in part.slice(0, 12).to_pylist()]
    assert all(len(v) == 1000 for v in got)
    for v, t in zip(got, texts[:12].to_pylist()):
        assert np.array_equal(v, bucket_counts_numpy(t))
        assert {b: n for b, n in enumerate(v) if n} == _reference_counts(t)
