"""Nearest-centre assignment (the points x centres match) and batch/stream predict.

Assignment is one projection: the K centres are a folded constant, so there
is no join, no shuffle, and the same plan runs on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import MAX_LITERAL_VALUES, center_distances, is_finite_vector, with_nearest
from .update import is_sparse


def assign(points: DataFrame, centers: Sequence[Sequence[float]], out: str = "cluster_id", features: str = "features") -> DataFrame:
    """Append the 0-based nearest-centre index (lowest index on ties)."""
    return with_nearest(points, centers, out, features)


def _message(d: int) -> str:
    return f"points and centres have different widths, or a coordinate is missing or not finite (centres: {d})"


def _rows_fn(shipped, d: int, names: list[str], result):
    """Arrow batches -> the carried columns and ``result(chunk, centres)``; a bad row fails the job."""
    import pyarrow as pa

    from .update import chunk_slices, read_chunk

    def fn(batches):
        C = shipped.value if hasattr(shipped, "value") else shipped
        for rb in batches:
            cols = [rb.column(i) for i in range(rb.num_columns - 1)]
            vectors = rb.column(rb.num_columns - 1)
            for lo, n in chunk_slices(vectors):
                chunk, _ = read_chunk(vectors.slice(lo, n), d)
                if chunk.bad:
                    raise ValueError(f"{chunk.bad} rows: {_message(d)}")
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in cols], result(chunk, C)], names=names)

    return fn


def _nearest_fn(precision: str):
    """``(chunk, centres) -> clusters``; the centres are prepared for the search once a task."""
    held: list = []

    def clusters(chunk, C):
        import pyarrow as pa

        from .pruned import searcher
        from .update import nearest

        if not held:
            held.append(searcher(C, np.float32 if precision == "float" else np.float64))
        return pa.array(nearest(chunk, C, precision, held[0]))

    return clusters


def predict(
    points: DataFrame,
    centers: Sequence[Sequence[float]],
    id_col: str = "id",
    features: str = "features",
    path: str = "auto",
    check_width: bool = True,
    keep: Sequence[str] = (),
    precision: str = "double",
) -> DataFrame:
    """``(id, cluster_id)`` for every point; an empty input gives an empty result.

    ``path="arrow"`` (chosen for sparse or wide vectors and for models beyond a plan literal) assigns
    whole Arrow batches with NumPy; the expression path serves small models. Both work on batch and
    streaming input, and both fail the job on a row of the wrong width or with a missing or non-finite
    coordinate (``check_width=False``, expression path only: such rows get a null cluster).
    """
    if len(centers) == 0:
        raise ValueError("no centres")
    d = len(centers[0])
    sparse = is_sparse(points, features)
    huge = len(centers) * d > MAX_LITERAL_VALUES
    if path == "auto":
        path = "arrow" if sparse or huge or d >= 16 else "expr"
    if (sparse or huge) and path != "arrow":
        raise ValueError("sparse vectors and very large models use the Arrow path")
    carried = [id_col, *keep]
    src = points.select(*carried, features)
    if path == "arrow":
        from .update import ship_centers

        schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carried)
        fn = _rows_fn(ship_centers(centers), d, [*carried, "cluster_id"], _nearest_fn(precision))
        return src.mapInArrow(fn, f"{schema}, cluster_id int")
    # checked row by row inside the same pass
    usable = F.coalesce((F.size(features) == F.lit(d)) & is_finite_vector(F.col(features)), F.lit(False))
    out = with_nearest(src.withColumn("_usable", usable), centers, "cluster_id", features, precision)
    otherwise = F.raise_error(F.lit(_message(d))) if check_width else F.lit(None)
    return out.withColumn("cluster_id", F.when(F.col("_usable"), F.col("cluster_id")).otherwise(otherwise.cast("int"))).select(*carried, "cluster_id")


def distances(
    points: DataFrame, centers: Sequence[Sequence[float]], id_col: str = "id", features: str = "features", precision: str = "double"
) -> DataFrame:
    """``(id, cluster_id, dist)``: squared distance of every point to each of the K centres."""
    if len(centers) * len(centers[0]) > MAX_LITERAL_VALUES or is_sparse(points, features):
        import pyarrow as pa

        from .pruned import scan_distances
        from .update import ship_centers

        d = len(centers[0])
        dtype = np.float32 if precision == "float" else np.float64
        src = points.select(id_col, features)

        def rows(chunk, C):
            dist = scan_distances(chunk.matrix(d), C, dtype).astype(np.float64)
            return pa.FixedSizeListArray.from_arrays(pa.array(dist.ravel()), len(C)).cast(pa.list_(pa.float64()))

        fn = _rows_fn(ship_centers(centers), d, [id_col, "_dist"], rows)
        listed = src.mapInArrow(fn, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, _dist array<double>")
        exploded = listed.select(F.col(id_col), F.posexplode("_dist").alias("cluster_id", "dist"))
    else:
        exploded = points.select(F.col(id_col), F.posexplode(center_distances(F.col(features), centers, precision)).alias("cluster_id", "dist"))
    return exploded.withColumn("cluster_id", F.col("cluster_id").cast("int"))
