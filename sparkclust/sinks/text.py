"""Text sinks and the matching centre reader.

Line formats (all blank separated):

* centres:     ``<cluster_id> <c0> <c1> ... <c(d-1)> `` (trailing blank)
* membership:  ``<position> <cluster_id>``
* features:    ``<idx> <v0> ... <v(n-1)>``

Numbers print as Spark casts doubles to text (``1.0``, ``2.5E-4``); the centres of a
single-precision model as it casts 32-bit numbers (``0.1``, not ``0.10000000149011612``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.points import parse_point_lines, read_lines


def _join_numbers(arr_col: str, precision: str = "double") -> F.Column:
    return F.array_join(F.transform(F.col(arr_col), lambda v: v.cast(precision).cast("string")), " ")


def center_lines(centers: DataFrame, precision: str = "double") -> DataFrame:
    """``(cluster_id, center)`` -> ``(cluster_id, line)``; ``precision="float"`` prints 32-bit numbers."""
    return centers.select(
        "cluster_id",
        F.concat(F.col("cluster_id").cast("string"), F.lit(" "), _join_numbers("center", precision), F.lit(" ")).alias("line"),
    )


def membership_lines(membership: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, cluster_id)`` -> ``(id, line)``."""
    return membership.select(id_col, F.concat_ws(" ", F.col(id_col).cast("string"), F.col("cluster_id").cast("string")).alias("line"))


def feature_lines(features: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, features)`` -> ``(id, line)``."""
    return features.select(id_col, F.concat_ws(" ", F.col(id_col).cast("string"), _join_numbers("features")).alias("line"))


def write_lines(lines: DataFrame, path: str, order_by: str | None = None, single_file: bool = False) -> None:
    """Write the ``line`` column as text, in scan order; ``order_by`` sorts the whole output first."""
    out = lines
    if order_by is not None:
        out = out.orderBy(order_by)
    if single_file:
        # only for K-sized outputs such as the centre file
        out = out.coalesce(1)
    out.select("line").write.mode("overwrite").text(path)


def write_centers(centers: DataFrame, path: str, fmt: str = "text", precision: str = "double") -> None:
    """Save a model: ``text`` (centre lines, one file) or ``parquet`` (cluster_id, center)."""
    if fmt == "text":
        write_lines(center_lines(centers, precision), path, order_by="cluster_id", single_file=True)
    elif fmt == "parquet":
        centers.select("cluster_id", "center").coalesce(1).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_centers(spark: SparkSession, path: str, fmt: str = "text") -> list[list[float]]:
    """Load K centres (a K-sized model) in cluster order.

    For text the first token is dropped and file order defines the cluster id.
    """
    if fmt == "parquet":
        rows = spark.read.parquet(path).orderBy("cluster_id").collect()
        return [[float(v) for v in r["center"]] for r in rows]
    parsed = parse_point_lines(read_lines(spark, path))
    bad = parsed.rejects.limit(1).collect()
    if bad:
        raise ValueError(f"bad centre line: {bad[0]['line']!r} ({bad[0]['reason']})")
    rows = parsed.points.orderBy("id").collect()
    return [[float(v) for v in r["features"]] for r in rows]
