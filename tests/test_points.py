import os

import pytest
from conftest import SF_SMALL, write_text
from pyspark.sql import functions as F

from sparkclust import group_offsets, points_from_columns, read_points, split_rejects, with_row_index
from sparkclust.operators.rowindex import partition_sizes
from sparkclust.sources.points import read_lines


def test_text_points_keep_file_order_across_files(spark, tmpdir_path):
    # several files, several partitions: positions follow path then line order
    d = os.path.join(tmpdir_path, "pts")
    write_text(f"{d}/b.txt", [f"{i} {i}.5 {i * 2}" for i in range(50, 100)])
    write_text(f"{d}/a.txt", [f"{i} {i}.5 {i * 2}" for i in range(0, 50)])
    parsed = read_points(spark, d)
    rows = parsed.points.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(100))
    assert [r["src_id"] for r in rows] == [str(i) for i in range(100)]
    assert rows[7]["features"] == [7.5, 14.0]
    assert parsed.rejects.count() == 0


def test_bad_lines_go_to_rejects(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "bad.txt"), ["0 1 2", "1  3 4", "", "2 x 1", "3 1", "4 nan 1", "5 5 6"])
    parsed = read_points(spark, path, dim=2)
    good = {r["id"]: r["features"] for r in parsed.points.collect()}
    assert good == {0: [1.0, 2.0], 6: [5.0, 6.0]}
    reasons = {r["id"]: r["reason"] for r in parsed.rejects.collect()}
    assert reasons == {1: "width", 2: "width", 3: "parse", 4: "width", 5: "nonfinite"}


def test_tab_and_control_trim(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "tab.txt"), ["\t0 1.5 2.0 \t"])
    parsed = read_points(spark, path)
    assert [r["features"] for r in parsed.points.collect()] == [[1.5, 2.0]]


def test_width_from_first_line(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "w.txt"), ["0 1 2 3", "1 1 2", "2 4 5 6"])
    parsed = read_points(spark, path)
    assert sorted(r["id"] for r in parsed.points.collect()) == [0, 2]
    assert [r["id"] for r in parsed.rejects.collect()] == [1]


def test_read_lines_positions_dense(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "l.txt"), [f"line{i}" for i in range(1000)])
    rows = read_lines(spark, path).collect()
    assert sorted(r["line_no"] for r in rows) == list(range(1000))
    assert all(r["line"] == f"line{r['line_no']}" for r in rows)


def test_points_from_columns_and_rejects(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0)], "k long, a double, b double")
    good, bad = split_rejects(points_from_columns(df, "k", ["a", "b"]), dim=2)
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_row_index_dense_and_ordered(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey").repartition(5)
    idx = with_row_index(o, "o_orderkey", num_partitions=4).collect()
    by_key = sorted((r["o_orderkey"], r["row_idx"]) for r in idx)
    assert [i for _, i in by_key] == list(range(len(by_key)))


def test_group_offsets_prefix(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("a",)], "g string")
    got = {r["g"]: (r["n"], r["offset"]) for r in group_offsets(df, "g").collect()}
    assert got == {"a": (3, 0), "b": (2, 3), "c": (1, 5)}


def test_partition_sizes_sum(spark):
    df = spark.range(100).repartition(3)
    assert sum(r["n"] for r in partition_sizes(df).collect()) == 100


def test_file_position_of_json_rows(spark, tmpdir_path):
    import json

    from sparkclust.operators.rowindex import with_file_position
    from sparkclust.sources.documents import read_documents

    d = os.path.join(tmpdir_path, "docs")
    # ids deliberately out of order: positions follow the files, not the ids
    write_text(f"{d}/part-1.json", [json.dumps({"id": 100 - i, "text": f"t{i}"}) for i in range(30)])
    write_text(f"{d}/part-0.json", [json.dumps({"id": 500 + i, "text": f"u{i}"}) for i in range(20)])
    rows = with_file_position(read_documents(spark, d), "pos").select("id", "pos").collect()
    got = {r["pos"]: r["id"] for r in rows}
    assert got == {**{i: 500 + i for i in range(20)}, **{20 + i: 100 - i for i in range(30)}}


def test_running_offsets_many_groups(spark):
    from sparkclust.operators.rowindex import running_offsets

    sizes = spark.range(5000).select(F.col("id").alias("g"), (F.col("id") % 7 + 1).alias("n")).repartition(6)
    got = sorted((r["g"], r["n"], r["offset"]) for r in running_offsets(sizes, "g", num_partitions=5).collect())
    acc = 0
    for g, n, off in got:
        assert off == acc
        acc += n


@pytest.mark.parametrize("n", [2, 4, 200])
def test_row_index_with_payload(spark, n):
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    got = with_row_index(o, "o_orderkey", num_partitions=n).select("o_orderkey", "o_totalprice", "row_idx").toPandas()
    got = got.sort_values("o_orderkey")
    assert (got["row_idx"].to_numpy() == range(len(got))).all()


@pytest.mark.parametrize("n", [2, 4, 200])
def test_running_offsets_with_payload(spark, n):
    from sparkclust.operators.rowindex import running_offsets

    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").withColumn("n", F.col("o_custkey") % 7)
    got = running_offsets(o, "o_orderkey", "n", num_partitions=n).toPandas().sort_values("o_orderkey")
    assert (got["offset"].to_numpy() == (got["n"].cumsum() - got["n"]).to_numpy()).all()


def test_row_index_hot_key_spreads(spark):
    # one key holds most rows: positions stay dense and the key spans several partitions
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id")).alias("k"))
    out = with_row_index(df, "k", num_partitions=6)
    rows = out.select("k", "row_idx", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["row_idx"] for r in rows) == list(range(3000))
    assert len({r["p"] for r in rows if r["k"] == 1}) > 1
    first_other = min(r["row_idx"] for r in rows if r["k"] != 1)
    assert first_other == 2000


def test_first_rows_matches_order_limit(spark):
    from sparkclust.operators.limit import first_rows

    df = spark.createDataFrame([(i % 13 if i % 5 else None, f"r{i}") for i in range(200)], "k int, v string").repartition(4)
    got = [r["k"] for r in first_rows(df, 30, "k").collect()]
    want = [r["k"] for r in df.orderBy("k").limit(30).collect()]
    assert got == want
    assert first_rows(df.where("k > 100"), 3, "k").count() == 0


@pytest.mark.parametrize("bound", [0, 200_000])
def test_file_position_many_files(spark, tmpdir_path, monkeypatch, bound):
    import sparkclust.operators.rowindex as R

    monkeypatch.setattr(R, "MAX_BROADCAST_SPLITS", bound)
    d = os.path.join(tmpdir_path, "many")
    for f in range(6):
        write_text(f"{d}/f{f}.txt", [f"{f * 10 + i} {i}" for i in range(10)])
    rows = read_lines(spark, d).collect()
    assert sorted((r["line_no"], r["line"].split(" ")[0]) for r in rows) == [(i, str(i)) for i in range(60)]


def test_take_first_with_hot_key(spark):
    from sparkclust.operators.limit import take_first

    df = spark.createDataFrame([(0 if i < 5 else (1 if i < 900 else i), i) for i in range(1000)], "k int, v int").repartition(5)
    rows = take_first(df, 10, "k")
    assert len(rows) == 10
    assert sorted(r["k"] for r in rows) == [0] * 5 + [1] * 5
    assert [r["k"] for r in take_first(df, 3, "k")] == [0, 0, 0]


def test_parse_counts_observed(spark, tmpdir_path):
    path = write_text(os.path.join(tmpdir_path, "obs.txt"), ["0 1 2", "1 x 2", "2 3 4", "3 5"])
    parsed = read_points(spark, path, dim=2)
    assert parsed.points.count() == 2
    assert parsed.counts() == {"lines": 4, "rejected": 2}
