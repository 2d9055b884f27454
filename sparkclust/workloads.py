"""The registered queries: each reads the fixture tables of one scale factor and
returns a DataFrame, next to its independent SQL formulation in ``ORACLE``.

Doubles whose SQL form depends on summation order (means, sums) are rounded to 4 decimals on both
sides, but for the queries that compare exact sums; memberships are integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.text import chars_to_bigrams, row_string, row_text, text_chars
from .operators.assign import distances, predict
from .operators.large_model import lloyd_pass_large, predict_large, seed_table
from .operators.rowindex import group_offsets, partition_sizes, running_offsets, with_row_index, with_scan_index
from .operators.seed import centers_frame, seed_first_k
from .operators.update import partials_expr, step_stats, update_centers
from .plans.featurize import featurize_text, hashed_tf_long, hashed_tf_sparse
from .plans.kmeans import fit
from .plans.stored import StoredTraining, store_training
from .plans.report import document_projection, document_sample, label_documents, language_counts
from .session import ensure_parallelism, scratch_path
from .sinks.text import center_lines, feature_lines, membership_lines, read_centers, write_centers, write_lines
from .sources.documents import documents_from_table, read_documents, register_documents, write_documents_json
from .sources.points import points_from_array, points_from_columns, read_points, split_rejects

ROUND = O.ROUND


def _fit(*args, **kwargs):
    """``fit`` for a registered query: the cached points are released at once.

    A query returns a lazy DataFrame; its membership, if any, is recomputed
    from the source scan when collected, so no cache outlives the call.
    """
    run = fit(*args, **kwargs)
    run.release()
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- point sets ------------------------------------------------------------


def order_points(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return points_from_columns(o, "o_orderkey", ["o_totalprice", F.month("o_orderdate")])


ORDER_POINTS_SQL = "SELECT o_orderkey AS id, o_totalprice::DOUBLE AS x0, month(o_orderdate)::DOUBLE AS x1 FROM orders"


def customer_points(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return points_from_columns(c, "c_custkey", ["c_acctbal", "c_nationkey"])


CUSTOMER_POINTS_SQL = "SELECT c_custkey AS id, c_acctbal::DOUBLE AS x0, c_nationkey::DOUBLE AS x1 FROM customer"


def supplier_points(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return points_from_columns(s, "s_suppkey", ["s_acctbal", "s_nationkey"])


SUPPLIER_POINTS_SQL = "SELECT s_suppkey AS id, s_acctbal::DOUBLE AS x0, s_nationkey::DOUBLE AS x1 FROM supplier"


def part_points(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return points_from_columns(p, "p_partkey", ["p_size", F.length("p_type")])


PART_POINTS_SQL = "SELECT p_partkey AS id, p_size::DOUBLE AS x0, length(p_type)::DOUBLE AS x1 FROM part"


def embedding_points(spark, sf_dir) -> DataFrame:
    return points_from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


EMBEDDING_POINTS_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


def _flat(points: DataFrame, d: int) -> DataFrame:
    return points.select("id", *[F.col("features")[j].alias(f"x{j}") for j in range(d)])


def _centers_wide(spark, centers, rounded: bool = True) -> DataFrame:
    d = len(centers[0])
    cols = [F.round(F.col("center")[j], ROUND).alias(f"c{j}") if rounded else F.col("center")[j].alias(f"c{j}") for j in range(d)]
    return centers_frame(spark, centers).select("cluster_id", *cols)


def _centers_long(spark, centers) -> DataFrame:
    return centers_frame(spark, centers).select(
        "cluster_id", F.posexplode("center").alias("j", "value")
    ).select("cluster_id", F.col("j").cast("int").alias("j"), F.round("value", ROUND).alias("value"))


def _centers_wide_sql(cte: str, d: int) -> str:
    cols = ", ".join(f"round(x{j}, {ROUND}) AS c{j}" for j in range(d))
    return f"SELECT cid::INTEGER AS cluster_id, {cols} FROM {cte}"


def _centers_long_sql(cte: str) -> str:
    return (
        f"SELECT cid::INTEGER AS cluster_id, (j - 1)::INTEGER AS j, round(x, {ROUND}) AS value FROM "
        f"(SELECT cid, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM {cte})"
    )


# ---- queries ---------------------------------------------------------------


def q_points_from_orders(spark, sf_dir):
    return _flat(order_points(spark, sf_dir), 2)


def _part_lines(spark, sf_dir, corrupt: bool) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size, price = (F.col(c).cast("string") for c in ("p_partkey", "p_size", "p_retailprice"))
    clean = F.concat_ws(" ", key, size, price)
    if not corrupt:
        line = clean
    else:
        line = (
            F.when(F.col("p_size") < 5, F.concat_ws(" ", key, size, F.lit("x")))
            .when(F.col("p_type") == "SMALL", F.concat_ws(" ", key, size))
            .when(F.col("p_brand") == "Brand#13", F.concat(key, F.lit("  "), size, F.lit(" "), price))
            .otherwise(clean)
        )
    return p.select("p_partkey", line.alias("line"))


def _write_then_read_points(spark, sf_dir, corrupt: bool, dim=None):
    path = scratch_path(spark, "points")
    write_lines(_part_lines(spark, sf_dir, corrupt), path, order_by="p_partkey")
    return read_points(spark, path, dim)


def q_parse_point_lines(spark, sf_dir):
    parsed = _write_then_read_points(spark, sf_dir, corrupt=False)
    return parsed.points.select("id", "src_id", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


def q_reject_bad_lines(spark, sf_dir):
    parsed = _write_then_read_points(spark, sf_dir, corrupt=True, dim=2)
    lines = parsed.rejects.select("id", F.split(F.col("line"), " ").getItem(0).alias("src_id"), "reason")
    return lines


def q_row_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return with_row_index(d, "doc_id")


def q_group_offsets(spark, sf_dir):
    return group_offsets(table(spark, sf_dir, "documents"), "lang")


def q_seed_first_k(spark, sf_dir):
    return _centers_wide(spark, seed_first_k(order_points(spark, sf_dir), 7), rounded=False)


def q_seed_zero_pad(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    pts = points_from_columns(r, "r_regionkey", ["r_regionkey", F.length("r_name")])
    return _centers_wide(spark, seed_first_k(pts, 7), rounded=False)


def q_center_distances(spark, sf_dir):
    pts = supplier_points(spark, sf_dir)
    return distances(pts, seed_first_k(pts, 3))


def q_assign_nearest(spark, sf_dir):
    pts = customer_points(spark, sf_dir)
    return predict(pts, seed_first_k(pts, 5))


def q_assign_ties(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pts = points_from_columns(p, "p_partkey", ["p_size"])
    return predict(pts, seed_first_k(pts, 4))


def q_cluster_partials(spark, sf_dir):
    pts = order_points(spark, sf_dir)
    seeds = seed_first_k(pts, 7)
    agg = partials_expr(pts, seeds).drop("bad")
    return agg.select("cluster_id", "n", F.round("s_0", ROUND).alias("s0"), F.round("s_1", ROUND).alias("s1"))


def q_assign_float(spark, sf_dir):
    pts = customer_points(spark, sf_dir)
    seeds = [[float(v) for v in row] for row in seed_first_k(pts, 5)]
    from .functions.vector import round_centers

    return predict(pts, round_centers(seeds, "float"), precision="float")


def q_lloyd_float_centers(spark, sf_dir):
    run = _fit(order_points(spark, sf_dir), 7, max_iter=3, precision="float")
    return _centers_wide(spark, run.centers)


def _bucket_points(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return points_from_columns(p, "p_partkey", [F.floor(F.col("p_size") / 10)])


def q_update_keep_empty(spark, sf_dir):
    pts = _bucket_points(spark, sf_dir)
    seeds = seed_first_k(pts, 7)
    st = step_stats(pts, seeds, None, path="expr")
    new = update_centers(seeds, st)
    rows = [(k, st.n[k], new[k][0]) for k in range(7)]
    return spark.createDataFrame(rows, "cluster_id int, n long, c0 double").select(
        "cluster_id", "n", F.round("c0", ROUND).alias("c0")
    )


def _orders_run(spark, sf_dir, membership="lagged", track_delta="auto"):
    return _fit(order_points(spark, sf_dir), 7, max_iter=5, stop="fixed", membership=membership, track_delta=track_delta)


def q_lloyd_fixed_centers(spark, sf_dir):
    run = _orders_run(spark, sf_dir)
    return _centers_wide(spark, run.centers)


def q_lloyd_fixed_membership(spark, sf_dir):
    return _orders_run(spark, sf_dir).membership


def q_lloyd_final_membership(spark, sf_dir):
    return _orders_run(spark, sf_dir, membership="final").membership


def q_lloyd_threshold(spark, sf_dir):
    run = _fit(customer_points(spark, sf_dir), 5, max_iter=20, threshold=0.05, stop="threshold")
    return _centers_wide(spark, run.centers).withColumn("n_iter", F.lit(run.n_iter))


def q_threshold_history(spark, sf_dir):
    run = _fit(customer_points(spark, sf_dir), 5, max_iter=20, threshold=0.05, stop="threshold")
    return run.history_df(spark).select("iteration", "n", "changed", "delta")


def q_predict_embeddings(spark, sf_dir):
    pts = embedding_points(spark, sf_dir)
    return predict(pts, seed_first_k(pts, 7), path="arrow")


def q_delta_history(spark, sf_dir):
    run = _orders_run(spark, sf_dir)
    return run.history_df(spark).select("iteration", "n", "changed", "delta")


def q_predict_saved(spark, sf_dir):
    run = _fit(customer_points(spark, sf_dir), 5, max_iter=3)
    path = scratch_path(spark, "model")
    write_centers(run.centers_df(spark), path, fmt="text")
    centers = read_centers(spark, path, fmt="text")
    return predict(supplier_points(spark, sf_dir), centers)


def _part_run(spark, sf_dir):
    return _fit(part_points(spark, sf_dir), 5, max_iter=2)


def q_center_lines(spark, sf_dir):
    run = _part_run(spark, sf_dir)
    rounded = [[round(v, ROUND) for v in c] for c in run.centers]
    return center_lines(centers_frame(spark, rounded))


def q_membership_lines(spark, sf_dir):
    run = _part_run(spark, sf_dir)
    indexed = with_row_index(run.membership, "id", out="pos")
    return membership_lines(indexed.select(F.col("pos").alias("id"), "cluster_id"))


def q_embedding_kmeans(spark, sf_dir):
    run = _fit(embedding_points(spark, sf_dir), 7, max_iter=3)
    return _centers_long(spark, run.centers)


def q_row_strings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        row_text(F.col("text")).alias("text_row"),
        row_string(F.lit(0), F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"), F.lit(0)).alias("label_row"),
    )


def q_char_bigrams(spark, sf_dir):
    d = ensure_parallelism(table(spark, sf_dir, "documents"))
    chars = d.select("doc_id", text_chars(row_text(F.col("text"))).alias("_c"))
    grams = chars.select("doc_id", F.explode(chars_to_bigrams(F.col("_c"))).alias("bigram"))
    return grams.groupBy("doc_id", "bigram").agg(F.count(F.lit(1)).alias("n"))


def q_bigram_tf(spark, sf_dir):
    d = ensure_parallelism(table(spark, sf_dir, "documents"))
    return hashed_tf_long(d, "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", "tf")


def q_feature_lines(spark, sf_dir):
    d = ensure_parallelism(table(spark, sf_dir, "documents"))
    feats = featurize_text(d, "doc_id", "text", index_by="doc_id", form="dense", impl="arrow")
    return feature_lines(feats).select(F.col("id").alias("idx"), "line")


def _json_docs(spark, sf_dir):
    path = scratch_path(spark, "docs-json")
    write_documents_json(documents_from_table(table(spark, sf_dir, "documents")), path)
    return read_documents(spark, path)


def q_json_projection(spark, sf_dir):
    return document_projection(_json_docs(spark, sf_dir))


def q_sql_projection(spark, sf_dir):
    """The labeller's SQL over a registered view, nested field and literals included."""
    register_documents(documents_from_table(table(spark, sf_dir, "documents")), "document_rows")
    return spark.sql("SELECT 0 AS head, id, lang, user.lang AS user_lang, text, 0 AS tail FROM document_rows")


def q_language_topk(spark, sf_dir):
    return language_counts(documents_from_table(table(spark, sf_dir, "documents")), 25)


def q_document_sample(spark, sf_dir):
    return document_sample(documents_from_table(table(spark, sf_dir, "documents")), 10)


def _text_run(spark, sf_dir, iters: int):
    d = ensure_parallelism(table(spark, sf_dir, "documents"))
    return _fit(hashed_tf_sparse(d, "doc_id", "text", bracketed=True), 7, max_iter=iters)


def q_text_kmeans(spark, sf_dir):
    return _centers_long(spark, _text_run(spark, sf_dir, 3).centers)


def q_label_documents(spark, sf_dir):
    run = _text_run(spark, sf_dir, 2)
    docs = documents_from_table(ensure_parallelism(table(spark, sf_dir, "documents")))
    return label_documents(docs, run.centers, bracketed=False)


def q_label_documents_bracketed(spark, sf_dir):
    run = _text_run(spark, sf_dir, 2)
    docs = documents_from_table(ensure_parallelism(table(spark, sf_dir, "documents")))
    return label_documents(docs, run.centers, bracketed=True)


def q_row_index_payload(spark, sf_dir):
    return with_row_index(table(spark, sf_dir, "orders"), "o_orderkey")


def q_running_offsets_payload(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 7).alias("n"))
    return running_offsets(o, "o_orderkey", "n", "offset")


def q_partition_sizes(spark, sf_dir):
    """Rows per physical partition after dealing documents by id."""
    dealt = table(spark, sf_dir, "documents").select("doc_id").repartitionById(7, (F.col("doc_id") % 7).cast("int"))
    return partition_sizes(dealt)


def q_embedding_rejects(spark, sf_dir):
    """Rows set aside by ``split_rejects`` when every 7th vector is short, every 11th holds NaN, every 13th is null."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("vec_id")
    spoilt = (
        F.when(k % 7 == 0, F.slice("v", 1, 63))
        .when(k % 11 == 0, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan")))))
        .when(k % 13 == 0, F.lit(None).cast("array<double>"))
        .otherwise(F.col("v"))
    )
    _, bad = split_rejects(points_from_array(e.select("vec_id", spoilt.alias("v")), "vec_id", "v"), 64)
    return bad.select("id", F.when(F.col("features").isNull(), F.lit(-1)).otherwise(F.size("features")).alias("width"))


def q_trim_point_lines(spark, sf_dir):
    """Point lines with tabs, control characters and blanks at both ends."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("\t\x01 "), F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")), F.lit(" \x1f\t"))
    path = scratch_path(spark, "trim")
    write_lines(p.select("p_partkey", line.alias("line")), path)
    points = read_points(spark, path).points
    return points.select(F.col("src_id").cast("long").alias("src_id"), F.col("features")[0].alias("x0"))


def q_predict_saved_parquet(spark, sf_dir):
    run = _fit(customer_points(spark, sf_dir), 5, max_iter=3)
    path = scratch_path(spark, "model") + ".parquet"
    write_centers(run.centers_df(spark), path, fmt="parquet")
    return predict(supplier_points(spark, sf_dir), read_centers(spark, path, fmt="parquet"))


def _write_part_lines(spark, sf_dir) -> str:
    path = scratch_path(spark, "part-lines")
    write_lines(_part_lines(spark, sf_dir, False), path, order_by="p_partkey")
    return path


def _split_lines(spark, path) -> DataFrame:
    words = F.split("value", " ")
    return spark.read.text(path).select(words[0].cast("long").alias("id"), words[1].cast("int").alias("cluster_id"))


def q_job_train_predict(spark, sf_dir):
    """The command line: train on point lines, then predict the same lines; the prediction's lines."""
    from .job import run as run_job

    src, out = _write_part_lines(spark, sf_dir), scratch_path(spark, "job")
    run_job(spark, ["par_train", src, out, "5", "0.0001", "2"])
    run_job(spark, ["predict", src, out + ".model", out])
    return _split_lines(spark, out + ".membership")


def q_job_membership(spark, sf_dir):
    from .job import run as run_job

    src, out = _write_part_lines(spark, sf_dir), scratch_path(spark, "job")
    run_job(spark, ["par_train", src, out, "5", "0.0001", "2"])
    return _split_lines(spark, out + ".membership")


def q_job_label(spark, sf_dir):
    """The command line: label JSON documents with a saved model; how often each line of the report occurs."""
    from .job import run as run_job

    run = _text_run(spark, sf_dir, 2)
    base = scratch_path(spark, "job-label")
    write_centers(run.centers_df(spark), base + ".parquet", fmt="parquet")
    write_documents_json(documents_from_table(table(spark, sf_dir, "documents")), base + ".json")
    run_job(spark, ["label", base + ".json", base + ".parquet", base + ".lines"])
    return spark.read.text(base + ".lines").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def q_user_sample(spark, sf_dir):
    """The first documents with both nested user fields."""
    d = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws("-", "source", "lang"))
    docs = documents_from_table(d, user_name_col="name")
    flat = docs.select("id", "lang", F.col("user.lang").alias("user_lang"), F.col("user.name").alias("user_name"), "text")
    return document_sample(flat, 10, cols=("id", "lang", "user_lang", "user_name", "text"))


def q_json_corrupt(spark, sf_dir):
    """JSON documents read by a glob; lines that don't parse keep their text."""
    base = scratch_path(spark, "docs-glob")
    d = table(spark, sf_dir, "documents")
    write_documents_json(documents_from_table(d), f"{base}/part-good")
    d.select(F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": ')).alias("line")).select("line").write.text(f"{base}/part-bad")
    docs = read_documents(spark, f"{base}/part-*")
    # the corrupt column needs its neighbours read too
    return docs.select("id", "lang", F.col("user.lang").alias("user_lang"), F.length("text").alias("n"), F.col("_corrupt_record").alias("corrupt"))


def q_assign_many(spark, sf_dir):
    """200 centres: the search by the triangle inequality."""
    pts = embedding_points(spark, sf_dir)
    return predict(pts, seed_first_k(pts, 200), path="arrow")


def q_scan_index(spark, sf_dir):
    return with_scan_index(table(spark, sf_dir, "orders"))


def q_row_index_ties(spark, sf_dir):
    """Numbered by a key that isn't the order of the file, repeated values of it in file order."""
    return with_row_index(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), ["p_size", "p_type"])


def q_exact_centers(spark, sf_dir):
    run = _orders_run(spark, sf_dir)
    return _centers_wide(spark, run.centers, rounded=False)


def q_large_model_predict(spark, sf_dir):
    """Centres as a table, three of them at a time."""
    pts = customer_points(spark, sf_dir)
    return predict_large(pts, seed_table(pts, 40, 2), 2, center_rows=3, part_bytes=200 * 16)


def q_large_model_pass(spark, sf_dir):
    pts = customer_points(spark, sf_dir)
    after = lloyd_pass_large(pts, seed_table(pts, 40, 2), 2, center_rows=3, part_bytes=200 * 16)
    return after.select("cluster_id", "n", F.col("center")[0].alias("c0"), F.col("center")[1].alias("c1"))


def _stored_run(spark, sf_dir):
    """Two passes, then two more from the stored membership, as a job started anew would do."""
    path = scratch_path(spark, "training")
    store_training(customer_points(spark, sf_dir), path, 5).train(2)
    return StoredTraining(spark, path).train(4)


def q_stored_membership(spark, sf_dir):
    return _stored_run(spark, sf_dir).membership()


def q_stored_history(spark, sf_dir):
    rows = [(h["iteration"], h["n"], h["changed"], h["delta"]) for h in _stored_run(spark, sf_dir).history]
    return spark.createDataFrame(rows, "iteration int, n long, changed long, delta double")


def q_resumed_centers(spark, sf_dir):
    """A run that stops after two passes and goes on from its log."""
    log = scratch_path(spark, "log")
    for passes in (2, 5):
        run = _fit(order_points(spark, sf_dir), 7, max_iter=passes, log=log, resume=True)
    return _centers_wide(spark, run.centers, rounded=False)


def q_task_rows(spark, sf_dir):
    """Rows that each task of each pass reports, of orders dealt out by key."""
    dealt = order_points(spark, sf_dir).repartitionById(7, (F.col("id") % 7).cast("int"))
    run = _fit(dealt, 4, max_iter=2, cache="persist", task_report=True)
    return run.tasks.select("iteration", "task", "rows")


def q_float_center_lines(spark, sf_dir):
    """The command line in single precision: the numbers of the model file, and whether they are the text of 32-bit numbers."""
    from .job import run as run_job

    src, out = _write_part_lines(spark, sf_dir), scratch_path(spark, "job")
    run_job(spark, ["par_train_cpu", src, out, "5", "0.0001", "1", "--precision=float"])
    words = F.split("value", " ")
    numbers = [words[j].cast("float") for j in (1, 2)]
    short = (numbers[0].cast("string") == words[1]) & (numbers[1].cast("string") == words[2]) & (F.size(words) == 4) & (words[3] == "")
    return spark.read.text(out + ".model").select(
        words[0].cast("int").alias("cluster_id"), numbers[0].cast("double").alias("c0"), numbers[1].cast("double").alias("c1"), short.alias("short")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "points_from_orders": q_points_from_orders,
    "parse_point_lines": q_parse_point_lines,
    "reject_bad_lines": q_reject_bad_lines,
    "row_index": q_row_index,
    "group_offsets": q_group_offsets,
    "seed_first_k": q_seed_first_k,
    "seed_zero_pad": q_seed_zero_pad,
    "center_distances": q_center_distances,
    "assign_nearest": q_assign_nearest,
    "assign_ties": q_assign_ties,
    "assign_float": q_assign_float,
    "lloyd_float_centers": q_lloyd_float_centers,
    "cluster_partials": q_cluster_partials,
    "update_keep_empty": q_update_keep_empty,
    "lloyd_fixed_centers": q_lloyd_fixed_centers,
    "lloyd_fixed_membership": q_lloyd_fixed_membership,
    "lloyd_final_membership": q_lloyd_final_membership,
    "lloyd_threshold": q_lloyd_threshold,
    "delta_history": q_delta_history,
    "threshold_history": q_threshold_history,
    "predict_embeddings": q_predict_embeddings,
    "predict_saved": q_predict_saved,
    "center_lines": q_center_lines,
    "membership_lines": q_membership_lines,
    "embedding_kmeans": q_embedding_kmeans,
    "row_strings": q_row_strings,
    "char_bigrams": q_char_bigrams,
    "bigram_tf": q_bigram_tf,
    "feature_lines": q_feature_lines,
    "json_projection": q_json_projection,
    "sql_projection": q_sql_projection,
    "language_topk": q_language_topk,
    "document_sample": q_document_sample,
    "text_kmeans": q_text_kmeans,
    "label_documents": q_label_documents,
    "label_documents_bracketed": q_label_documents_bracketed,
    "row_index_payload": q_row_index_payload,
    "running_offsets_payload": q_running_offsets_payload,
    "partition_sizes": q_partition_sizes,
    "embedding_rejects": q_embedding_rejects,
    "trim_point_lines": q_trim_point_lines,
    "predict_saved_parquet": q_predict_saved_parquet,
    "job_train_predict": q_job_train_predict,
    "job_membership": q_job_membership,
    "job_label": q_job_label,
    "user_sample": q_user_sample,
    "json_corrupt": q_json_corrupt,
    "assign_many": q_assign_many,
    "scan_index": q_scan_index,
    "row_index_ties": q_row_index_ties,
    "exact_centers": q_exact_centers,
    "large_model_predict": q_large_model_predict,
    "large_model_pass": q_large_model_pass,
    "stored_membership": q_stored_membership,
    "stored_history": q_stored_history,
    "resumed_centers": q_resumed_centers,
    "task_rows": q_task_rows,
    "float_center_lines": q_float_center_lines,
}


# ---- oracle SQL --------------------------------------------------------------


def _oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["points_from_orders"] = ORDER_POINTS_SQL

    part_line_src = "SELECT p_partkey, p_size, p_retailprice, p_type, p_brand FROM part"
    q["parse_point_lines"] = (
        "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey::VARCHAR AS src_id, "
        "p_size::DOUBLE AS x0, p_retailprice::DOUBLE AS x1 FROM part"
    )
    q["reject_bad_lines"] = (
        "SELECT id, src_id, reason FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, "
        "p_partkey::VARCHAR AS src_id, CASE WHEN p_size < 5 THEN 'parse' WHEN p_type = 'SMALL' THEN 'width' "
        f"WHEN p_brand = 'Brand#13' THEN 'width' ELSE NULL END AS reason FROM ({part_line_src})) WHERE reason IS NOT NULL"
    )
    q["row_index"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents"
    q["group_offsets"] = (
        "SELECT lang, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents GROUP BY lang"
    )
    q["seed_first_k"] = (
        O.with_clause([f"p AS ({ORDER_POINTS_SQL})", f"c AS ({O.seeds_sql(2, 7)})"])
        + "SELECT cid::INTEGER AS cluster_id, x0 AS c0, x1 AS c1 FROM c"
    )
    region_pts = "SELECT r_regionkey AS id, r_regionkey::DOUBLE AS x0, length(r_name)::DOUBLE AS x1 FROM region"
    q["seed_zero_pad"] = (
        O.with_clause([f"p AS ({region_pts})", f"c AS ({O.seeds_sql(2, 7)})"])
        + "SELECT cid::INTEGER AS cluster_id, x0 AS c0, x1 AS c1 FROM c"
    )
    q["center_distances"] = (
        O.with_clause([f"p AS ({SUPPLIER_POINTS_SQL})", f"c AS ({O.seeds_sql(2, 3)})"])
        + f"SELECT p.id, c.cid::INTEGER AS cluster_id, {O._dist_cols(2)} AS dist FROM p CROSS JOIN c"
    )
    q["assign_nearest"] = (
        O.with_clause([f"p AS ({CUSTOMER_POINTS_SQL})", f"c AS ({O.seeds_sql(2, 5)})"])
        + f"SELECT id, cid::INTEGER AS cluster_id FROM ({O.assign_sql(2, 'c')})"
    )
    tie_pts = "SELECT p_partkey AS id, p_size::DOUBLE AS x0 FROM part"
    q["assign_ties"] = (
        O.with_clause([f"p AS ({tie_pts})", f"c AS ({O.seeds_sql(1, 4)})"])
        + f"SELECT id, cid::INTEGER AS cluster_id FROM ({O.assign_sql(1, 'c')})"
    )
    fdist = " + ".join(f"((p.x{j}::FLOAT - c.x{j}::FLOAT) * (p.x{j}::FLOAT - c.x{j}::FLOAT))" for j in range(2))
    q["assign_float"] = (
        O.with_clause([f"p AS ({CUSTOMER_POINTS_SQL})", f"c AS ({O.seeds_sql(2, 5)})"])
        + f"SELECT p.id, (min(row({fdist}, c.cid)))[2]::INTEGER AS cluster_id FROM p CROSS JOIN c GROUP BY p.id"
    )
    fpts = "SELECT o_orderkey AS id, o_totalprice::FLOAT::DOUBLE AS x0, month(o_orderdate)::FLOAT::DOUBLE AS x1 FROM orders"
    fctes = [f"p AS MATERIALIZED ({fpts})", f"c0 AS MATERIALIZED ({O.seeds_sql(2, 7)})"]
    for t in range(1, 4):
        fctes.append(
            f"a{t} AS MATERIALIZED (SELECT p.id, (min(row({fdist}, c.cid)))[2] AS cid FROM p CROSS JOIN c{t - 1} c GROUP BY p.id)"
        )
        upd = O.update_sql(2, f"c{t - 1}", f"a{t}")
        fctes.append(f"c{t} AS MATERIALIZED (SELECT cid, x0::FLOAT::DOUBLE AS x0, x1::FLOAT::DOUBLE AS x1 FROM ({upd}))")
    q["lloyd_float_centers"] = O.with_clause(fctes) + _centers_wide_sql("c3", 2)
    q["cluster_partials"] = (
        O.with_clause([f"p AS ({ORDER_POINTS_SQL})", f"c AS ({O.seeds_sql(2, 7)})", f"a AS ({O.assign_sql(2, 'c')})"])
        + f"SELECT a.cid::INTEGER AS cluster_id, count(*) AS n, round(sum(p.x0), {ROUND}) AS s0, "
        f"round(sum(p.x1), {ROUND}) AS s1 FROM a JOIN p ON p.id = a.id GROUP BY a.cid"
    )
    bucket_pts = "SELECT p_partkey AS id, floor(p_size / 10)::DOUBLE AS x0 FROM part"
    q["update_keep_empty"] = (
        O.with_clause(
            [
                f"p AS ({bucket_pts})",
                f"c0 AS ({O.seeds_sql(1, 7)})",
                f"a1 AS ({O.assign_sql(1, 'c0')})",
                f"c1 AS ({O.update_sql(1, 'c0', 'a1')})",
                "n1 AS (SELECT c0.cid, count(a1.id) AS n FROM c0 LEFT JOIN a1 ON a1.cid = c0.cid GROUP BY c0.cid)",
            ]
        )
        + f"SELECT c1.cid::INTEGER AS cluster_id, n1.n AS n, round(c1.x0, {ROUND}) AS c0 FROM c1 JOIN n1 ON n1.cid = c1.cid"
    )
    orders5 = O.lloyd_ctes(ORDER_POINTS_SQL, 2, 7, 5)
    q["lloyd_fixed_centers"] = O.with_clause(orders5) + _centers_wide_sql("c5", 2)
    q["lloyd_fixed_membership"] = O.with_clause(orders5) + "SELECT id, cid::INTEGER AS cluster_id FROM a5"
    q["lloyd_final_membership"] = (
        O.with_clause(orders5 + [f"a6 AS ({O.assign_sql(2, 'c5')})"]) + "SELECT id, cid::INTEGER AS cluster_id FROM a6"
    )
    thr = O.threshold_ctes(CUSTOMER_POINTS_SQL, 2, 5, 20, 0.05)
    q["lloyd_threshold"] = (
        O.with_clause(thr)
        + f"SELECT cid::INTEGER AS cluster_id, round(x0, {ROUND}) AS c0, round(x1, {ROUND}) AS c1, "
        "(SELECT iters FROM s20)::INTEGER AS n_iter FROM c20"
    )
    q["delta_history"] = (
        O.with_clause(orders5 + O.history_ctes(5))
        + "SELECT iteration::INTEGER AS iteration, n::BIGINT AS n, changed::BIGINT AS changed, "
        "changed::DOUBLE / n AS delta FROM (" + " UNION ALL ".join(f"SELECT * FROM h{t}" for t in range(1, 6)) + ")"
    )
    q["threshold_history"] = (
        O.with_clause(thr + O.history_ctes(20))
        + "SELECT h.iteration::INTEGER AS iteration, h.n::BIGINT AS n, h.changed::BIGINT AS changed, "
        "h.changed::DOUBLE / h.n AS delta FROM ("
        + " UNION ALL ".join(f"SELECT * FROM h{t}" for t in range(1, 21))
        + ") h WHERE h.iteration <= (SELECT iters FROM s20)"
    )
    q["predict_embeddings"] = (
        O.with_clause([f"p AS ({EMBEDDING_POINTS_SQL})", f"c AS ({O.seeds_sql(64, 7, vector=True)})"])
        + f"SELECT id, cid::INTEGER AS cluster_id FROM ({O.assign_sql(64, 'c', vector=True)})"
    )
    cust3 = O.lloyd_ctes(CUSTOMER_POINTS_SQL, 2, 5, 3)
    q["predict_saved"] = (
        O.with_clause(cust3 + [f"s AS ({SUPPLIER_POINTS_SQL})"])
        + f"SELECT p.id, (min(row({O._dist_cols(2)}, c.cid)))[2]::INTEGER AS cluster_id FROM s p CROSS JOIN c3 c GROUP BY p.id"
    )
    part2 = O.lloyd_ctes(PART_POINTS_SQL, 2, 5, 2)
    q["center_lines"] = (
        O.with_clause(part2)
        + f"SELECT cid::INTEGER AS cluster_id, cid::VARCHAR || ' ' || round(x0, {ROUND})::VARCHAR || ' ' || "
        f"round(x1, {ROUND})::VARCHAR || ' ' AS line FROM c2"
    )
    q["membership_lines"] = (
        O.with_clause(part2)
        + "SELECT pos AS id, pos::VARCHAR || ' ' || cid::VARCHAR AS line FROM "
        "(SELECT row_number() OVER (ORDER BY id) - 1 AS pos, cid FROM a2)"
    )
    emb3 = O.lloyd_ctes(EMBEDDING_POINTS_SQL, 64, 7, 3, vector=True)
    q["embedding_kmeans"] = O.with_clause(emb3) + _centers_long_sql("c3")
    q["row_strings"] = (
        "SELECT doc_id, '[' || coalesce(text, 'null') || ']' AS text_row, "
        "'[0,' || coalesce(doc_id::VARCHAR, 'null') || ',' || coalesce(lang, 'null') || ',' || coalesce(source, 'null') "
        "|| ',' || coalesce(text, 'null') || ',0]' AS label_row FROM documents"
    )
    q["char_bigrams"] = (
        "SELECT doc_id, bigram, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN length(s) >= 2 THEN "
        "list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) WHEN length(s) = 1 THEN [s] ELSE []::VARCHAR[] END) "
        "AS bigram FROM (SELECT doc_id, '[' || coalesce(text, 'null') || ']' AS s FROM documents)) GROUP BY doc_id, bigram"
    )
    q["bigram_tf"] = f"SELECT id AS doc_id, bucket::INTEGER AS bucket, tf FROM ({O.tf_long_sql(True)})"
    q["feature_lines"] = (
        "SELECT idx, idx::VARCHAR || ' ' || array_to_string(list_transform(v, lambda x: x::VARCHAR), ' ') AS line FROM "
        f"(SELECT row_number() OVER (ORDER BY id) - 1 AS idx, v FROM ({O.tf_dense_sql(True)}))"
    )
    q["json_projection"] = "SELECT doc_id AS id, lang, source AS user_lang, text FROM documents"
    q["sql_projection"] = "SELECT 0 AS head, doc_id AS id, lang, source AS user_lang, text, 0 AS tail FROM documents"
    q["language_topk"] = (
        "SELECT source AS lang, count(*) AS cnt FROM documents GROUP BY source ORDER BY cnt DESC, lang NULLS FIRST LIMIT 25"
    )
    q["document_sample"] = "SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 10"
    text3 = O.lloyd_ctes(O.tf_dense_sql(True), 1000, 7, 3, vector=True)
    q["text_kmeans"] = O.with_clause(text3) + _centers_long_sql("c3")
    text2 = O.lloyd_ctes(O.tf_dense_sql(True), 1000, 7, 2, vector=True)
    q["label_documents"] = (
        O.with_clause(text2 + [f"u AS MATERIALIZED ({O.tf_dense_sql(False)})"])
        + f"SELECT d.doc_id AS id, d.lang, d.source AS user_lang, a.cluster_id FROM documents d JOIN "
        f"(SELECT p.id, (min(row({O._dist_list(1000)}, c.cid)))[2]::INTEGER AS cluster_id FROM u p CROSS JOIN c2 c GROUP BY p.id) a "
        "ON a.id = d.doc_id"
    )
    label = (
        f"SELECT d.doc_id AS id, d.lang, d.source AS user_lang, a.cluster_id FROM documents d JOIN "
        f"(SELECT p.id, (min(row({O._dist_list(1000)}, c.cid)))[2]::INTEGER AS cluster_id FROM u p CROSS JOIN c2 c GROUP BY p.id) a "
        "ON a.id = d.doc_id"
    )
    q["label_documents_bracketed"] = O.with_clause(text2 + [f"u AS MATERIALIZED ({O.tf_dense_sql(True)})"]) + label
    q["job_label"] = (
        O.with_clause(text2 + [f"u AS MATERIALIZED ({O.tf_dense_sql(False)})"])
        + f"SELECT coalesce(lang, 'null') || ' ' || coalesce(user_lang, 'null') || ' ' || cluster_id AS line, count(*) AS n FROM ({label}) GROUP BY 1"
    )
    q["row_index_payload"] = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders"
    q["running_offsets_payload"] = (
        "SELECT o_orderkey, o_orderpriority, o_custkey % 7 AS n, coalesce(sum(o_custkey % 7) OVER (ORDER BY o_orderkey ROWS "
        'BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM orders'
    )
    q["partition_sizes"] = "SELECT (doc_id % 7)::INTEGER AS pid, count(*) AS n FROM documents GROUP BY 1"
    q["embedding_rejects"] = (
        "SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN 63 WHEN vec_id % 11 = 0 THEN 64 ELSE -1 END)::INTEGER AS width "
        "FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0"
    )
    q["trim_point_lines"] = "SELECT p_partkey AS src_id, p_size::DOUBLE AS x0 FROM part"
    q["predict_saved_parquet"] = q["predict_saved"]
    lines = O.lloyd_ctes(
        "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size::DOUBLE AS x0, p_retailprice::DOUBLE AS x1 FROM part", 2, 5, 2
    )
    q["job_membership"] = O.with_clause(lines) + "SELECT id, cid::INTEGER AS cluster_id FROM a2"
    q["job_train_predict"] = O.with_clause(lines + [f"a3 AS ({O.assign_sql(2, 'c2')})"]) + "SELECT id, cid::INTEGER AS cluster_id FROM a3"
    q["user_sample"] = (
        "SELECT doc_id AS id, lang, source AS user_lang, concat_ws('-', source, lang) AS user_name, text FROM documents ORDER BY doc_id LIMIT 10"
    )
    q["json_corrupt"] = (
        "SELECT doc_id AS id, lang, source AS user_lang, length(text)::INTEGER AS n, NULL::VARCHAR AS corrupt FROM documents UNION ALL "
        "SELECT NULL, NULL, NULL, NULL, '{\"id\": ' || doc_id || ', \"lang\": ' FROM documents"
    )
    q["assign_many"] = (
        O.with_clause([f"p AS ({EMBEDDING_POINTS_SQL})", f"c AS ({O.seeds_sql(64, 200, vector=True)})"])
        + f"SELECT id, cid::INTEGER AS cluster_id FROM ({O.assign_sql(64, 'c', vector=True)})"
    )
    q["scan_index"] = "SELECT *, row_number() OVER () - 1 AS row_idx FROM orders"
    q["row_index_ties"] = (
        "SELECT p_partkey, p_type, p_size, row_number() OVER (ORDER BY p_size, p_type, pos) - 1 AS row_idx "
        "FROM (SELECT *, row_number() OVER () AS pos FROM part)"
    )
    exact5 = O.lloyd_ctes(ORDER_POINTS_SQL, 2, 7, 5, add="fsum")
    q["exact_centers"] = q["resumed_centers"] = O.with_clause(exact5) + "SELECT cid::INTEGER AS cluster_id, x0 AS c0, x1 AS c1 FROM c5"
    many = O.lloyd_ctes(CUSTOMER_POINTS_SQL, 2, 40, 1, add="fsum")
    q["large_model_predict"] = O.with_clause(many) + "SELECT id, cid::INTEGER AS cluster_id FROM a1"
    q["large_model_pass"] = (
        O.with_clause(many)
        + "SELECT c.cid::INTEGER AS cluster_id, count(a.id) AS n, any_value(c.x0) AS c0, any_value(c.x1) AS c1 FROM c1 c LEFT JOIN a1 a ON a.cid = c.cid GROUP BY c.cid"
    )
    cust4 = O.lloyd_ctes(CUSTOMER_POINTS_SQL, 2, 5, 4)
    q["stored_membership"] = O.with_clause(cust4) + "SELECT id, cid::INTEGER AS cluster_id FROM a4"
    q["stored_history"] = (
        O.with_clause(cust4 + O.history_ctes(4))
        + "SELECT iteration::INTEGER AS iteration, n::BIGINT AS n, changed::BIGINT AS changed, changed::DOUBLE / n AS delta FROM ("
        + " UNION ALL ".join(f"SELECT * FROM h{t}" for t in range(1, 5))
        + ")"
    )
    q["task_rows"] = (
        "SELECT t::INTEGER AS iteration, (o_orderkey % 7)::INTEGER AS task, count(*) AS rows FROM orders, (SELECT unnest([1, 2]) AS t) GROUP BY 1, 2"
    )
    fline = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size::FLOAT::DOUBLE AS x0, p_retailprice::FLOAT::DOUBLE AS x1 FROM part"
    q["float_center_lines"] = (
        O.with_clause(
            [
                f"p AS MATERIALIZED ({fline})",
                f"c0 AS MATERIALIZED ({O.seeds_sql(2, 5)})",
                f"a1 AS MATERIALIZED (SELECT p.id, (min(row({fdist}, c.cid)))[2] AS cid FROM p CROSS JOIN c0 c GROUP BY p.id)",
                f"c1 AS MATERIALIZED ({O.update_sql(2, 'c0', 'a1', add='fsum')})",
            ]
        )
        + "SELECT cid::INTEGER AS cluster_id, x0::FLOAT::DOUBLE AS c0, x1::FLOAT::DOUBLE AS c1, TRUE AS short FROM c1"
    )
    return q


ORACLE: dict[str, str] = _oracle()
