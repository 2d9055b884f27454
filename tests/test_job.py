import os

import pytest
from conftest import SF_SMALL

from sparkclust.job import read_options, run, write_options
from sparkclust.sinks.text import read_centers
from sparkclust.sources.points import read_lines


def _points_file(spark, tmpdir_path):
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    lines = o.select("c_custkey", F.concat_ws(" ", "c_custkey", "c_acctbal", "c_nationkey").alias("line"))
    path = os.path.join(tmpdir_path, "points")
    lines.orderBy("c_custkey").select("line").coalesce(1).write.text(path)
    return path


def test_train_predict_cycle(spark, tmpdir_path):
    pts = _points_file(spark, tmpdir_path)
    out = os.path.join(tmpdir_path, "out")
    rep = run(spark, ["par_train", pts, out, "4", "0.0001", "3"])
    assert rep["iterations"] == 3 and rep["n"] == 150 and rep["dim"] == 2
    assert len(read_centers(spark, out + ".model")) == 4
    rep2 = run(spark, ["train", pts, out + "2", "4", "0.5", "20"])
    assert rep2["iterations"] < 20
    assert len(read_centers(spark, out + "2.cluster_centres")) == 4
    run(spark, ["predict", pts, out + ".model", out + "-pred", "--sorted"])
    run(spark, ["predict", pts, out + ".model", out + "-scan"])
    assert sorted(r["value"] for r in spark.read.text(out + "-scan.membership").collect()) == sorted(
        r["value"] for r in spark.read.text(out + "-pred.membership").collect()
    )
    rep3 = run(spark, ["par_train", pts, out + "3", "4", "0.0001", "2", "--precision=float"])
    assert rep3["iterations"] == 2
    lines = read_lines(spark, out + "-pred.membership").collect()
    assert len(lines) == 150
    assert all(r["line"].split(" ")[0] == str(r["line_no"]) for r in lines)


def test_featurize_and_label(spark, tmpdir_path, capsys):
    from sparkclust.sources.documents import documents_from_table, write_documents_json

    docs = os.path.join(tmpdir_path, "docs")
    write_documents_json(documents_from_table(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), docs)
    feats = os.path.join(tmpdir_path, "feats")
    run(spark, ["featurize", docs, feats])
    lines = read_lines(spark, feats).collect()
    assert len(lines) == 200 and all(len(r["line"].split(" ")) == 1001 for r in lines)
    # centres taken from the first 3 feature lines
    model = os.path.join(tmpdir_path, "model")
    spark.read.text(feats).orderBy("value").limit(0)
    from sparkclust.sources.points import read_points

    first = read_points(spark, feats).points.orderBy("id").limit(3).collect()
    from sparkclust.operators.seed import centers_frame
    from sparkclust.sinks.text import write_centers

    write_centers(centers_frame(spark, [r["features"] for r in first]), model)
    out = os.path.join(tmpdir_path, "labels")
    run(spark, ["label", docs, model, out])
    got = read_lines(spark, out).collect()
    # without an output folder every document is printed
    run(spark, ["label", docs, model])
    assert sorted(capsys.readouterr().out.split("\n")[:200]) == sorted(r["line"] for r in got)
    # the setting stored beside a model is used
    write_options(spark, model, {"bracketed": True})
    run(spark, ["label", docs, model, out + "2"])
    run(spark, ["label", docs, model, out + "3", "--bracketed=false"])
    stored, bare = (sorted(r["line"] for r in read_lines(spark, out + k).collect()) for k in "23")
    assert bare == sorted(r["line"] for r in got) and len(stored) == 200
    assert read_options(spark, feats) == {"bracketed": True} and read_options(spark, out) == {}
    assert len(got) == 200 and all(len(r["line"].split(" ")) == 3 for r in got)


def test_unknown_mode(spark):
    with pytest.raises(SystemExit):
        run(spark, ["bogus"])
