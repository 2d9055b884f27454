import json
import os

from conftest import SF_SMALL, write_text
from pyspark.sql import functions as F

from sparkclust import fit, points_from_columns, predict
from sparkclust.operators.seed import centers_frame
from sparkclust.plans.report import document_projection, document_sample, label_documents, language_counts
from sparkclust.sinks.text import center_lines, feature_lines, membership_lines, read_centers, write_centers, write_lines
from sparkclust.sources.documents import documents_from_table, read_documents, write_documents_json
from sparkclust.streaming.predict import start_predict_stream, stream_predict


def test_center_and_membership_lines(spark):
    c = centers_frame(spark, [[1.0, 2.5], [0.00025, 3.0]])
    assert [r["line"] for r in center_lines(c).orderBy("cluster_id").collect()] == ["0 1.0 2.5 ", "1 2.5E-4 3.0 "]
    m = spark.createDataFrame([(0, 3), (1, 0)], "id long, cluster_id int")
    assert [r["line"] for r in membership_lines(m).orderBy("id").collect()] == ["0 3", "1 0"]
    f = spark.createDataFrame([(0, [0.0, 2.0])], "id long, features array<double>")
    assert feature_lines(f).first()["line"] == "0 0.0 2.0"


def test_centre_round_trip_text_and_parquet(spark, tmpdir_path):
    C = [[0.1, 1e-7, 123456789.125], [-3.5, 2.0, 0.0]]
    for fmt in ("text", "parquet"):
        path = os.path.join(tmpdir_path, f"model.{fmt}")
        write_centers(centers_frame(spark, C), path, fmt=fmt)
        assert read_centers(spark, path, fmt=fmt) == C


def test_predict_from_file_written_by_training(spark, tmpdir_path):
    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    p = points_from_columns(o, "c_custkey", ["c_acctbal", "c_nationkey"])
    run = fit(p, 3, max_iter=2)
    path = os.path.join(tmpdir_path, "m.model")
    write_centers(run.centers_df(spark), path)
    C = read_centers(spark, path)
    assert C == run.centers
    a = {r["id"]: r["cluster_id"] for r in predict(p, C).collect()}
    b = {r["id"]: r["cluster_id"] for r in predict(p, run.centers).collect()}
    assert a == b


def test_json_documents_round_trip_and_corrupt(spark, tmpdir_path):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path = os.path.join(tmpdir_path, "docs")
    write_documents_json(documents_from_table(d), path)
    write_text(os.path.join(path, "zz-bad.json"), ['{"id": 1, "lang": "en"', json.dumps({"id": 99999, "lang": "en", "user": {"lang": "de", "name": "x"}, "text": "a, b"})])
    docs = read_documents(spark, path)
    proj = document_projection(docs)
    got = {r["id"]: (r["lang"], r["user_lang"], r["text"]) for r in proj.collect() if r["id"] is not None}
    assert got[99999] == ("en", "de", "a, b")
    src = {r["doc_id"]: (r["lang"], r["source"], r["text"]) for r in d.collect()}
    assert all(got[k] == v for k, v in src.items())
    bad = docs.where(F.col("_corrupt_record").isNotNull()).select("id", "_corrupt_record").collect()
    assert len(bad) == 1


def test_language_counts_and_sample(spark):
    docs = documents_from_table(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    top = language_counts(docs, 3).collect()
    assert len(top) == 3 and top[0]["cnt"] >= top[1]["cnt"] >= top[2]["cnt"]
    sample = document_sample(docs, 5).collect()
    assert [r["id"] for r in sample] == sorted(r["id"] for r in docs.select("id").collect())[:5]


def test_label_documents_paths_agree(spark):
    docs = documents_from_table(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    from sparkclust.plans.featurize import hashed_tf_dense

    feats = hashed_tf_dense(docs, "id", "text", bracketed=True)
    run = fit(feats, 4, max_iter=2)
    a = {tuple(r) for r in label_documents(docs, run.centers, impl="arrow").collect()}
    b = {tuple(r) for r in label_documents(docs, run.centers, impl="sql").collect()}
    assert a == b and len(a) == docs.count()


def test_stream_predict_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "stream-in")
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.parquet(src)
    batch = points_from_columns(spark.read.parquet(src), "c_custkey", ["c_acctbal", "c_nationkey"])
    C = fit(batch, 4, max_iter=2).centers
    schema = spark.read.parquet(src).schema
    stream = points_from_columns(spark.readStream.schema(schema).parquet(src), "c_custkey", ["c_acctbal", "c_nationkey"])
    assert stream.isStreaming
    out = os.path.join(tmpdir_path, "stream-out")
    q = start_predict_stream(spark, stream, C, out, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    got = {r["id"]: r["cluster_id"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["cluster_id"] for r in stream_predict(batch, C).collect()}
    assert got == want and len(got) == 150


def test_write_lines_keeps_order(spark, tmpdir_path):
    df = spark.range(2000).select(F.col("id"), F.col("id").cast("string").alias("line")).repartition(4)
    path = os.path.join(tmpdir_path, "lines")
    write_lines(df, path, order_by="id")
    from sparkclust.sources.points import read_lines

    rows = read_lines(spark, path).collect()
    assert all(r["line"] == str(r["line_no"]) for r in rows)


def test_label_stream_equals_batch(spark, tmpdir_path):
    from sparkclust.plans.featurize import hashed_tf_dense
    from sparkclust.sources.documents import DOC_SCHEMA
    from sparkclust.streaming.predict import start_label_stream

    src = os.path.join(tmpdir_path, "docs-in")
    write_documents_json(documents_from_table(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), src)
    batch_docs = read_documents(spark, src)
    run = fit(hashed_tf_dense(batch_docs, "id", "text"), 3, max_iter=2)
    stream_docs = spark.readStream.schema(DOC_SCHEMA).json(src)
    out = os.path.join(tmpdir_path, "labels-out")
    q = start_label_stream(spark, stream_docs, run.centers, out, checkpoint=os.path.join(tmpdir_path, "ck2"))
    q.awaitTermination(180)
    got = {tuple(r) for r in spark.read.parquet(out).select("id", "lang", "user_lang", "cluster_id").collect()}
    want = {tuple(r) for r in label_documents(batch_docs, run.centers).select("id", "lang", "user_lang", "cluster_id").collect()}
    assert got == want and len(got) == 200


def test_read_single_centre_file_in_line_format(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "out.cluster_centres"), ["0 1.5 2.0 ", "1 3.0 4.0 ", "2 0.0 0.0 "])
    assert read_centers(spark, path) == [[1.5, 2.0], [3.0, 4.0], [0.0, 0.0]]
