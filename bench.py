"""Headline benchmark: prints one JSON line with seconds per query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Run configurations follow the reference's scripts: K = 7, 20 fixed passes
(its active ``par_train`` setting) on 2-, 4-, 64- and 1000-wide points.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sparkclust.job import run as run_job  # noqa: E402
from sparkclust.operators.assign import predict  # noqa: E402
from sparkclust.operators.large_model import lloyd_pass_large, seed_table  # noqa: E402
from sparkclust.operators.rowindex import with_row_index  # noqa: E402
from sparkclust.operators.seed import seed_first_k  # noqa: E402
from sparkclust.plans.featurize import hashed_tf_dense, hashed_tf_long, hashed_tf_sparse  # noqa: E402
from sparkclust.plans.kmeans import fit  # noqa: E402
from sparkclust.plans.report import label_documents  # noqa: E402
from sparkclust.plans.stored import store_training  # noqa: E402
from sparkclust.session import ensure_parallelism, local_session, scratch_path  # noqa: E402
from sparkclust.sinks.text import feature_lines, write_lines  # noqa: E402
from sparkclust.sources.documents import documents_from_table  # noqa: E402
from sparkclust.sources.points import points_from_array, points_from_columns, read_points  # noqa: E402
from sparkclust.workloads import order_points, table  # noqa: E402

K, ITERS = 7, 20


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="sparkclust-bench")
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    shared: dict = {}

    def timed(name, fn):
        t0 = time.time()
        try:
            fn()
        except Exception as e:  # record and go on: one failure must not hide the other numbers
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return
        times[name] = round(time.time() - t0, 3)

    # warm-up: JVM code paths and Python workers (not timed)
    warm = points_from_columns(table(spark, sf_dir, "region"), "r_regionkey", ["r_regionkey"])
    fit(warm, 2, max_iter=1, path="arrow").release()
    fit(warm, 2, max_iter=1, path="expr").release()

    def orders_kmeans():
        run = fit(order_points(spark, sf_dir), K, max_iter=ITERS)
        run.membership.groupBy("cluster_id").count().collect()
        shared["orders_centers"] = run.centers
        run.release()

    def lineitem_kmeans():
        li = table(spark, sf_dir, "lineitem")
        # lineitem has no unique key: number the rows by scan position
        pts = points_from_columns(
            li.withColumn("_rid", F.monotonically_increasing_id()),
            "_rid",
            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        )
        run = fit(pts, K, max_iter=ITERS)
        run.membership.groupBy("cluster_id").count().collect()
        run.release()

    def embeddings_kmeans():
        run = fit(points_from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), K, max_iter=ITERS)
        run.membership.groupBy("cluster_id").count().collect()
        run.release()

    def featurize_dense():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        hashed_tf_dense(d, "doc_id", "text").select(F.sum(F.aggregate("features", F.lit(0.0), lambda a, b: a + b))).collect()

    def featurize_long_sql():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        hashed_tf_long(d, "doc_id", "text", impl="sql").agg(F.count(F.lit(1)), F.sum("tf")).collect()

    def featurize_long_arrow():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        hashed_tf_long(d, "doc_id", "text", impl="arrow").agg(F.count(F.lit(1)), F.sum("tf")).collect()

    def text_kmeans():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        run = fit(hashed_tf_sparse(d, "doc_id", "text"), K, max_iter=ITERS)
        shared["text_centers"] = run.centers
        run.release()

    def text_kmeans_dense():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        fit(hashed_tf_dense(d, "doc_id", "text"), K, max_iter=ITERS).release()

    def row_index():
        with_row_index(table(spark, sf_dir, "orders"), "o_orderkey").agg(F.max("row_idx"), F.sum("o_totalprice")).collect()

    def point_parse():
        path = scratch_path(spark, "bench-points")
        o = table(spark, sf_dir, "orders")
        write_lines(o.select(F.concat_ws(" ", "o_orderkey", "o_totalprice", "o_custkey").alias("line")), path)
        shared["points"] = path
        read_points(spark, path).points.agg(F.max("id"), F.sum(F.col("features")[0])).collect()

    def feature_sink():
        d = ensure_parallelism(table(spark, sf_dir, "documents"))
        write_lines(feature_lines(hashed_tf_dense(d, "doc_id", "text")), scratch_path(spark, "bench-features"))

    def job_train():
        run_job(spark, ["par_train", shared["points"], scratch_path(spark, "bench-job"), str(K), "0.0001", "5"])

    def predict_orders():
        if "orders_centers" not in shared:
            raise RuntimeError("orders model missing")
        predict(order_points(spark, sf_dir), shared["orders_centers"]).groupBy("cluster_id").count().collect()

    def label_docs():
        docs = documents_from_table(ensure_parallelism(table(spark, sf_dir, "documents")))
        label_documents(docs, shared["text_centers"]).groupBy("cluster_id").count().collect()

    def predict_many():
        pts = order_points(spark, sf_dir)
        predict(pts, seed_first_k(pts, 500), path="arrow").groupBy("cluster_id").count().collect()

    def stored_kmeans():
        run = store_training(embedding_pts(), scratch_path(spark, "bench-store"), K).train(10)
        run.membership().groupBy("cluster_id").count().collect()

    def embedding_pts():
        return points_from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")

    def large_model():
        pts = embedding_pts()
        lloyd_pass_large(pts, seed_table(pts, 500, 64), 64, center_rows=100).count()

    timed("orders_kmeans_k7_t20", orders_kmeans)
    timed("lineitem_kmeans_k7_t20", lineitem_kmeans)
    timed("embeddings_kmeans_k7_t20", embeddings_kmeans)
    timed("featurize_dense", featurize_dense)
    timed("featurize_long_sql", featurize_long_sql)
    timed("featurize_long_arrow", featurize_long_arrow)
    timed("text_kmeans_k7_t20", text_kmeans)
    timed("text_kmeans_dense_k7_t20", text_kmeans_dense)
    timed("predict_orders", predict_orders)
    timed("label_documents", label_docs)
    timed("row_index_orders", row_index)
    timed("point_parse_orders", point_parse)
    timed("feature_sink", feature_sink)
    timed("job_par_train_t5", job_train)
    timed("predict_orders_k500", predict_many)
    timed("stored_kmeans_k7_t10", stored_kmeans)
    timed("large_model_pass_k500", large_model)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_seconds",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
