"""Streaming assignment: the nearest-centre projection on a streaming DataFrame.

Assignment is stateless (centres are a constant of the plan), so the same
expression runs per micro-batch with no state store and no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import predict
from ..session import scratch_path


def stream_predict(points: DataFrame, centers: Sequence[Sequence[float]], id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """``(id, *keep, cluster_id)`` for a streaming (or batch) points DataFrame."""
    return predict(points, centers, id_col=id_col, keep=keep)


def start_predict_stream(
    spark: SparkSession,
    points: DataFrame,
    centers: Sequence[Sequence[float]],
    out_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append assignments of a streaming source to files; restartable from its checkpoint."""
    labelled = stream_predict(points, centers)
    writer = (
        labelled.writeStream.format(fmt)
        .option("path", out_path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_label_stream(
    spark: SparkSession,
    docs: DataFrame,
    centers: Sequence[Sequence[float]],
    out_path: str,
    checkpoint: str | None = None,
    bracketed: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Label a stream of JSON documents (``read_documents`` shape) with saved centres.

    Featurizing and assignment are per-row, so each micro-batch is one
    projection; no state, no watermark.
    """
    from ..plans.report import label_documents

    labelled = label_documents(docs, centers, bracketed=bracketed, impl="arrow")
    writer = (
        labelled.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "label-ckpt"))
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
