"""Reports over documents: cluster labels beside language attributes, language counts, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_BUCKETS
from ..operators.assign import predict
from .featurize import hashed_tf_dense


def document_projection(docs: DataFrame) -> DataFrame:
    """``(id, lang, user_lang, text)``: the label job's projection with the nested ``user.lang``."""
    return docs.select("id", "lang", F.col("user.lang").alias("user_lang"), "text")


def label_lines(labels: DataFrame) -> DataFrame:
    """``(id, line)``: ``lang user_lang cluster_id`` of every labelled document, ``null`` for a missing language."""
    shown = [F.coalesce(c, F.lit("null")) for c in ("lang", "user_lang")]
    return labels.select("id", F.concat_ws(" ", *shown, F.col("cluster_id").cast("string")).alias("line"))


def label_documents(
    docs: DataFrame,
    centers: list[list[float]],
    n_features: int = DEFAULT_BUCKETS,
    bracketed: bool = False,
    impl: str = "arrow",
) -> DataFrame:
    """``(id, lang, user_lang, cluster_id)`` for every document, all in Spark.

    Features are built from the bare text (``bracketed=False``) unless the model
    was trained on bracketed row strings.
    """
    proj = document_projection(docs)
    if impl == "arrow":
        # a projection: language columns ride along, no join and no shuffle
        feats = proj.select("id", "lang", "user_lang", _features_col(n_features, bracketed))
        return predict(feats, centers, keep=("lang", "user_lang"))
    feats = hashed_tf_dense(proj, "id", "text", n_features, bracketed, impl)
    labels = predict(feats, centers)
    return proj.select("id", "lang", "user_lang").join(labels, "id")


def _features_col(n_features: int, bracketed: bool):
    from ..functions.text import row_text
    from .featurize import _sparse_udf

    # sparse between the two Arrow steps: only non-zero buckets cross the JVM boundary
    return _sparse_udf(n_features)(row_text(F.col("text"), bracketed)).alias("features")


def language_counts(docs: DataFrame, top: int = 25, by: str = "user.lang") -> DataFrame:
    """``(lang, cnt)``: documents per language, largest first, top ``top`` (ties by language)."""
    counts = docs.groupBy(F.col(by).alias("lang")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.asc_nulls_first("lang")).limit(top)


def document_sample(docs: DataFrame, n: int = 10, order_by: str = "id", cols=("id", "text")) -> DataFrame:
    """The first ``n`` documents in ``order_by`` order (a deterministic ``LIMIT``); ``cols`` may be expressions.

    Whole texts move only for the selected rows (``first_rows``).
    """
    from ..operators.limit import first_rows

    return first_rows(docs.select(*cols), n, order_by)
