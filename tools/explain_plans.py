"""Print the physical plans of the main operators (for review of pruning, pushdown and shuffles).

    python tools/explain_plans.py [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="simple")
    args = ap.parse_args()
    from pyspark.sql import functions as F

    from sparkclust.operators.assign import predict
    from sparkclust.operators.rowindex import with_row_index
    from sparkclust.operators.seed import seed_first_k
    from sparkclust.operators.update import partials_arrow, partials_expr
    from sparkclust.plans.featurize import hashed_tf_dense, hashed_tf_long
    from sparkclust.plans.report import label_documents, language_counts
    from sparkclust.session import local_session
    from sparkclust.sources.documents import documents_from_table
    from sparkclust.workloads import embedding_points, order_points, table

    spark = local_session(8)
    sf = args.sf
    pts = order_points(spark, sf).where(F.col("features")[0] > 1000.0)
    C = seed_first_k(pts, 7)
    emb = embedding_points(spark, sf)
    E = seed_first_k(emb, 7)
    docs = table(spark, sf, "documents")
    plans = {
        "lloyd pass, expression path (orders, filtered)": partials_expr(pts, C, C),
        "lloyd pass, Arrow path (embeddings)": partials_arrow(emb, E, E),
        "predict (orders)": predict(order_points(spark, sf), C),
        "row index (documents by doc_id)": with_row_index(docs.select("doc_id"), "doc_id"),
        "term frequency long, SQL": hashed_tf_long(docs, "doc_id", "text", impl="sql"),
        "term frequency dense, Arrow": hashed_tf_dense(docs, "doc_id", "text"),
        "label report": label_documents(documents_from_table(docs), [[0.0] * 1000] * 3),
        "language top-k": language_counts(documents_from_table(docs)),
    }
    for name, df in plans.items():
        print(f"\n===== {name} =====")
        df.explain(args.mode)


if __name__ == "__main__":
    main()
