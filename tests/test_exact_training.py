"""Exact sums, pruned search, blocks, pass log, stored training and models larger than a task."""

import os
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from sparkclust import fit, predict
from sparkclust.operators.blocks import assign_blocks, first_of_blocks, to_blocks
from sparkclust.operators.exact import ExactSums, digits, rounded
from sparkclust.operators.large_model import fit_large, lloyd_pass_large, predict_large, seed_table
from sparkclust.operators.pruned import CenterGroups, Scan
from sparkclust.operators.seed import seed_first_k
from sparkclust.operators.update import step_stats, update_centers
from sparkclust.plans.stored import StoredTraining, store_training
from sparkclust.workloads import customer_points, embedding_points, order_points


def no_exchange(df):
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_digits_give_the_number_back_and_sums_are_exact():
    rng = np.random.default_rng(0)
    for k in range(40):
        x = rng.normal(0, 1, (60, 3)) * 10.0 ** (rng.integers(-320, 300, (60, 3)) if k % 2 else rng.integers(-4, 6, (60, 3)))
        x[0] = [0.0, -0.0, 5e-324]
        back = {}
        for place, q in digits(x):
            assert (np.abs(q) < 2**26).all() and (q == np.trunc(q)).all()
            for at in np.ndindex(x.shape):
                back[at] = back.get(at, Fraction(0)) + Fraction(int(q[at])) * Fraction(2) ** (26 * place)
        assert all(back[at] == Fraction(float(x[at])) for at in back)
        sums, row = ExactSums(2, 4), rng.integers(0, 2, 60)
        sums.add_dense(x, row)
        settled = sums.settle()
        assert all(np.abs(v).max() <= 2**25 for v in settled.values())
        for r in range(2):
            for j in range(3):
                want = sum((Fraction(float(v)) for v in x[row == r, j]), Fraction(0))
                assert rounded({p: int(v[r, j]) for p, v in settled.items()}) == float(want)


@pytest.mark.parametrize("dtype", [np.float64, np.float32])
def test_pruned_search_is_the_scan(dtype):
    rng = np.random.default_rng(1)
    spots = rng.normal(0, 1, (500, 16))
    sets = [rng.integers(0, 5, (3000, 3)).astype(float), spots[rng.integers(0, 500, 4000)] + rng.normal(0, 0.02, (4000, 16)), rng.normal(0, 1, (800, 32)), np.repeat(rng.normal(0, 1, (40, 4)), 30, 0)]
    for X in sets:
        for k in (1, 7, 60, 500):
            C = spots[:k] if X.shape[1] == 16 else X[:k]
            groups = CenterGroups(C, dtype)
            assert (groups.nearest(X) == Scan(C, dtype).nearest(X)).all()
            if k == 500 and X.shape[1] in (3, 16):
                assert groups.evaluated < 0.5 * len(X) * k
    far = np.array([[1e-300, 1e300], [3.0, 4.0], [0.0, 0.0], [-1e154, 1e-154]])
    assert (CenterGroups(far[1:3]).nearest(far[1:3]) == Scan(far[1:3]).nearest(far[1:3])).all()


def test_pruned_predict_is_the_scan_on_embeddings(spark):
    pts = embedding_points(spark, SF_SMALL)
    rows = sorted(pts.collect())
    X = np.array([r["features"] for r in rows])
    for k in (100, 200):
        C = seed_first_k(pts, k)
        got = dict(predict(pts, C, path="arrow").collect())
        assert [got[r["id"]] for r in rows] == Scan(np.array(C)).nearest(X).tolist()


def test_centres_have_the_same_bits_for_any_partitioning(spark):
    pts = order_points(spark, SF_SMALL).withColumn("features", F.concat("features", F.array(F.col("features")[0] / 3, F.rand(1) * 1e-9 + F.col("features")[0] * 1e6))).cache()
    runs = {}
    for n in (1, 4, 7, 16):
        for cache in ("blocks", "persist"):
            run = fit(pts.repartition(n).select("*"), 5, max_iter=4, cache=cache)
            runs[n, cache] = (run.centers, [h["changed"] for h in run.history])
            run.release()
    assert len({repr(r) for r in runs.values()}) == 1
    rows = {r["id"]: r["features"] for r in pts.collect()}
    stats = step_stats(pts, seed_first_k(pts, 5))
    whole = dict(predict(pts, seed_first_k(pts, 5)).collect())
    for c in range(5):
        for j in range(4):
            assert stats.sums[c][j] == float(sum((Fraction(rows[i][j]) for i, m in whole.items() if m == c), Fraction(0)))


def test_blocks_keep_points_ids_and_bad_rows(spark):
    rows = [(i, [float(i % 7), 1 / (1 + i)]) for i in range(300)] + [(None, [9.0, 9.0]), (1000, None), (1001, [1.0]), (1002, [1.0, None]), (1003, [float("nan"), 1.0])]
    pts = spark.createDataFrame(rows, "id long, features array<double>").repartition(5)
    blocks = to_blocks(pts, 2)
    assert blocks.agg(F.sum("n"), F.sum("bad")).first() == (301, 4)
    assert first_of_blocks(blocks, 3, 2) == [[9.0, 9.0], [0.0, 1.0], [1.0, 0.5]]
    good = spark.createDataFrame(rows[:301], "id long, features array<double>")
    C = [[0.0, 0.0], [3.0, 0.0], [9.0, 9.0]]
    assert sorted(assign_blocks(blocks, C).collect(), key=str) == sorted(predict(good, C, path="arrow").collect(), key=str)
    with pytest.raises(ValueError, match="4 points"):
        fit(pts, 2, cache="blocks")
    with pytest.raises(ValueError, match="empty"):
        fit(pts.where("false"), 2, cache="blocks")
    equal = spark.createDataFrame([(5, [float(i), 0.0]) for i in range(50)], "id long, features array<double>")
    assert len(first_of_blocks(to_blocks(equal, 2), 4, 2)) == 4
    short = spark.createDataFrame([(1, [4.0, 4.0]), (2, [6.0, 6.0])], "id long, features array<double>")
    assert fit(short, 4, max_iter=1, cache="blocks").centers == fit(short, 4, max_iter=1, cache="persist").centers


def test_a_stopped_run_goes_on_where_it_was(spark, tmpdir_path):
    pts = customer_points(spark, SF_SMALL)
    log = os.path.join(tmpdir_path, "log")
    whole = fit(pts, 5, max_iter=6)
    fit(pts, 5, max_iter=2, log=log)
    os.makedirs(f"{log}/pass-000009")  # a pass that never finished
    more = fit(pts.repartition(3), 5, max_iter=6, log=log, resume=True)
    assert more.centers == whole.centers and more.previous == whole.previous
    assert [(h["iteration"], h["changed"], h["delta"]) for h in more.history] == [(h["iteration"], h["changed"], h["delta"]) for h in whole.history]
    assert sorted(more.membership.collect()) == sorted(whole.membership.collect())
    assert fit(pts, 5, max_iter=6, log=log, resume=True).centers == whole.centers  # nothing left to do
    with pytest.raises(ValueError, match="other hash, rows"):
        fit(pts.where("id > 3"), 5, max_iter=6, log=log, resume=True)
    with pytest.raises(ValueError, match="other k"):
        fit(pts, 4, max_iter=6, log=log, resume=True)


def test_task_metrics(spark):
    pts = customer_points(spark, SF_SMALL).withColumn("_p", (F.col("id") % 3).cast("int")).repartitionById(3, F.col("_p")).drop("_p").cache()
    run = fit(pts, 4, max_iter=3, task_report=True)
    want = {r["p"]: r["count"] for r in pts.groupBy((F.col("id") % 3).alias("p")).count().collect()}
    got = run.tasks.collect()
    assert {(r["iteration"], r["task"], r["rows"]) for r in got} == {(t, p, n) for t in (1, 2, 3) for p, n in want.items()}
    assert all(r["distances"] >= 4 * r["rows"] and r["distance_ns"] > 0 and r["sum_ns"] > 0 for r in got)
    assert [r["tasks"] for r in run.metrics_df(spark).collect()] == [3, 3, 3]
    # a change count needs a second look at few rows only
    wide = fit(embedding_points(spark, SF_SMALL), 7, max_iter=4)
    assert wide.history[-1]["metrics"]["distances"] < 2 * 7 * wide.n_points


@pytest.mark.parametrize("precision", ["double", "float"])
def test_stored_training_equals_fit_and_continues(spark, tmpdir_path, precision):
    pts = embedding_points(spark, SF_SMALL)
    whole = fit(pts, 7, max_iter=5, precision=precision)
    path = os.path.join(tmpdir_path, "store")
    first = store_training(pts, path, 7, precision=precision, buckets=3).train(2)
    assert first.centers == fit(pts, 7, max_iter=2, precision=precision).centers
    again = StoredTraining(spark, path)  # another session would do the same
    assert no_exchange(again.next_labels())
    again.train(5)
    assert again.centers == whole.centers and [h["changed"] for h in again.history] == [h["changed"] for h in whole.history]
    assert sorted(again.membership().collect()) == sorted(whole.membership.collect())
    assert no_exchange(again.membership())
    assert store_training(pts, path, 7, precision=precision, buckets=3).centers == whole.centers
    with pytest.raises(ValueError, match="other points"):
        store_training(pts, path, 6, precision=precision)


def test_stored_leads_spare_distances(spark, tmpdir_path):
    rng = np.random.default_rng(5)
    spots = rng.normal(0, 1, (30, 24))
    rows = [(i, (spots[i % 30] + rng.normal(0, 0.25, 24)).tolist()) for i in range(1500)]
    clustered = spark.createDataFrame(rows, "id long, features array<double>")
    for name, pts, k in (("clustered", clustered, 40), ("orders", order_points(spark, SF_SMALL), 200)):
        run = store_training(pts, os.path.join(tmpdir_path, name), k, buckets=2).train(8, threshold=0.0)
        want = fit(pts, k, max_iter=8, stop="threshold", threshold=0.0)
        assert run.centers == want.centers and len(run.history) == want.n_iter
        done = [h["metrics"]["distances"] for h in run.history]
        assert sum(done) < 0.5 * len(done) * k * want.n_points


def test_a_model_larger_than_a_task(spark):
    pts = customer_points(spark, SF_SMALL)
    k, d = 11, 2
    seeds = seed_table(pts, k, d)
    C = seed_first_k(pts, k)
    assert [r["center"] for r in seeds.orderBy("cluster_id").collect()] == C
    small = {"center_rows": 3, "part_bytes": 40 * d * 8}
    assert sorted(predict_large(pts, seeds, d, **small).collect()) == sorted(predict(pts, C).collect())
    centers = seeds
    for t in (1, 2, 3):
        centers = lloyd_pass_large(pts, centers.select("cluster_id", "center"), d, **small)
        run = fit(pts, k, max_iter=t)
        got = centers.orderBy("cluster_id").collect()
        assert [r["center"] for r in got] == run.centers
    assert [r["n"] for r in got] == [n for n in step_stats(pts, run.previous).n]
    last, membership = fit_large(pts, k, d, 3, **small)
    assert last.orderBy("cluster_id").collect() == got and sorted(membership.collect()) == sorted(run.membership.collect())
    # ties, an empty cluster, zero sums, a width of more than one block, and single precision
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1))] * 33 + [rng.random()] * 7 if i % 5 else [0.0] * 40) for i in range(200)]
    wide = spark.createDataFrame(rows, "id long, features array<double>")
    C = [r[1] for r in rows[:6]] + [rows[0][1], [1e9] * 40]
    table = spark.createDataFrame(list(enumerate(C)), "cluster_id int, center array<double>")
    for precision in ("double", "float"):
        after = lloyd_pass_large(wide, table, 40, center_rows=3, part_bytes=40 * 8 * 30, precision=precision).orderBy("cluster_id").collect()
        stats = step_stats(wide, C, precision=precision)
        assert [r["center"] for r in after] == update_centers(C, stats, precision) and [r["n"] for r in after] == stats.n




CLASH = ("row", "file", "at", "_file", "off", "range", "_range", "place", "tie", "k0", "n", "size", "before", "_pid", "_off", "_rn", "_tie", "first", "block")


def test_positions_leave_the_payload_where_it_is(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "sorted")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    df = spark.read.parquet(path).withColumns({c: F.col("o_custkey") % (i + 2) for i, c in enumerate(CLASH)})
    from sparkclust import with_row_index
    from sparkclust.operators.rowindex import with_scan_index

    for out in (with_row_index(df, "o_orderkey"), with_scan_index(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan and "Sort " not in plan
        assert out.columns == [*df.columns, "row_idx"]
        got = sorted(out.drop("row_idx").exceptAll(df).collect())
        assert not got
        keys = [r["o_orderkey"] for r in out.orderBy("row_idx").collect()]
        assert keys == sorted(keys) and [r["row_idx"] for r in out.orderBy("row_idx").collect()] == list(range(df.count()))


@pytest.mark.parametrize("how", ["desc files", "unsorted", "filtered", "memory", "nulls"])
def test_positions_of_other_tables(spark, tmpdir_path, how):
    from sparkclust import with_row_index
    from sparkclust.operators.rowindex import with_scan_index

    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "é", "z"]), rng.choice([None, float("nan"), -1.5, 2.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "v long, s string, x double").withColumns({c: F.col("v") + i for i, c in enumerate(CLASH)})
    if how != "memory":
        path = os.path.join(tmpdir_path, "t")
        order = {"desc files": [F.col("s").desc()], "nulls": ["s", "x"]}.get(how, ["v"])
        df.orderBy(*order).coalesce(3 if how != "nulls" else 1).write.parquet(path)
        df = spark.read.parquet(path)
        if how == "filtered":
            df = df.where("v % 3 <> 0")
    out = with_row_index(df, ["s", "x"], num_partitions=4)
    got = out.orderBy("row_idx").collect()
    n = df.count()
    assert [r["row_idx"] for r in got] == list(range(n)) and out.columns == [*df.columns, "row_idx"]
    key = lambda r: (r["s"] is not None, (r["s"] or "").encode(), r["x"] is not None, r["x"] is not None and np.isnan(r["x"]), 0.0 if r["x"] is None or np.isnan(r["x"]) else r["x"])
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    assert sorted(r["v"] for r in got) == sorted(r["v"] for r in df.collect())
    if how != "memory":
        positions = with_scan_index(df).collect()
        assert sorted(r["row_idx"] for r in positions) == list(range(n))
    if how == "nulls":  # this one is in order of its key: nothing moves
        assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert with_row_index(df.where("false"), "s").count() == 0


def test_rows_that_python_made_have_no_place_in_a_file(spark):
    from sparkclust import with_row_index

    pts = embedding_points(spark, SF_SMALL)
    member = predict(pts, seed_first_k(pts, 3), path="arrow")
    for df in (member, member.join(pts, "id"), pts.groupBy("id").count(), pts.union(pts)):
        got = with_row_index(df, "id").orderBy("row_idx").collect()
        assert [r["row_idx"] for r in got] == list(range(len(got))) and [r["id"] for r in got] == sorted(r["id"] for r in got)


def test_running_offsets_with_clashing_names(spark):
    from sparkclust.operators.rowindex import running_offsets

    df = spark.range(300).select("id", (F.col("id") % 5).alias("w"), *[F.lit(1).alias(c) for c in CLASH])
    for n in (1, 7, 200):
        got = running_offsets(df, "id", "w", "sum_before", num_partitions=n).orderBy("id").collect()
        assert [r["sum_before"] for r in got] == [sum(i % 5 for i in range(k)) for k in range(300)]
        assert got[0].asDict().keys() == {*df.columns, "sum_before"}


def test_partitions_are_counted_without_running_a_shuffle(spark):
    from sparkclust.session import ensure_parallelism

    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("count-partitions", "")
    grouped = spark.range(1000).groupBy((F.col("id") % 3).alias("g")).count()
    assert ensure_parallelism(grouped) is grouped
    narrow = ensure_parallelism(spark.range(0, 10, 1, 1), 4)
    assert not jobs.getJobIdsForGroup("count-partitions")
    assert narrow.rdd.getNumPartitions() == 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_single_precision_model_text(spark, tmpdir_path):
    from sparkclust.job import run as run_job

    src = os.path.join(tmpdir_path, "points")
    spark.createDataFrame([(f"{i} {0.1 * (i % 3)} 16777217.0",) for i in range(9)], "value string").coalesce(1).write.text(src)
    report = run_job(spark, ["par_train_cpu", src, os.path.join(tmpdir_path, "out"), "3", "0", "2", "--precision=float", f"--log={tmpdir_path}/log", f"--task-report={tmpdir_path}/tasks"])
    lines = sorted(r["value"] for r in spark.read.text(os.path.join(tmpdir_path, "out.model")).collect())
    assert lines == ["0 0.0 1.6777216E7 ", "1 0.1 1.6777216E7 ", "2 0.2 1.6777216E7 "]
    assert report["tasks"] >= 2 and report["distances"] >= 2 * 27 and report["task_distance_ms"] >= 0
    tasks = spark.read.json(os.path.join(tmpdir_path, "tasks"))
    assert tasks.agg(F.sum("rows")).first()[0] == 18
    again = run_job(spark, ["par_train_cpu", src, os.path.join(tmpdir_path, "out"), "3", "0", "2", "--precision=float", f"--log={tmpdir_path}/log"])
    assert again["iterations"] == 2 and sorted(r["value"] for r in spark.read.text(os.path.join(tmpdir_path, "out.model")).collect()) == lines


def test_text_is_cut_into_splits_without_a_shuffle(spark, tmpdir_path):
    from sparkclust import read_points
    from sparkclust.session import ensure_parallelism, min_input_splits

    path = os.path.join(tmpdir_path, "points")
    lines = spark.range(0, 60_000, 1, 1).select(F.concat_ws(" ", "id", F.col("id") * 2, F.lit("0.123456789012345")).alias("value"))
    lines.write.text(path)
    assert spark.read.text(path).rdd.getNumPartitions() == 1
    with min_input_splits(spark, 20):
        text = spark.read.text(path)
        assert text.rdd.getNumPartitions() >= 20 and ensure_parallelism(text) is text
        points = read_points(spark, path).points
        assert points.where("features[0] <> 2 * id").isEmpty() and points.count() == 60_000
    with pytest.raises(Exception, match="split in another way"):
        points.agg(F.max("id")).collect()


def test_command_line_training_on_stored_tables(spark, tmpdir_path):
    from sparkclust.job import run as run_job

    src, out, store = (os.path.join(tmpdir_path, n) for n in ("points", "out", "store"))
    rng = random.Random(4)
    spark.createDataFrame([(f"{i} {rng.randint(0, 50)} {rng.random()}",) for i in range(300)], "value string").coalesce(2).write.text(src)
    for mode, suffix in (("par_train", ".model"), ("train", ".cluster_centres")):
        run_job(spark, [mode, src, out, "4", "0.01", "6"])
        want = [sorted(r["value"] for r in spark.read.text(out + x).collect()) for x in (suffix, ".membership")]
        run_job(spark, [mode, src, out, "4", "0.01", "2", f"--store={store}-{mode}"])
        report = run_job(spark, [mode, src, out, "4", "0.01", "6", f"--store={store}-{mode}"])
        assert [sorted(r["value"] for r in spark.read.text(out + x).collect()) for x in (suffix, ".membership")] == want
        assert report["iterations"] <= 6 and report["n"] == 300
