"""Points stored as binary matrices: checked once, read by every pass without lists or checks.

A block is one row: the ids (and the order key) as lists, the coordinates as one binary matrix
(32-bit numbers if that loses nothing, else 64-bit), the number of rows in it, and the number of
rows that could not be used (wrong width, missing or non-finite coordinate) and were left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .update import Chunk, read_chunk

#: Bytes of coordinates in a block, about.
BLOCK_BYTES = 1 << 21
COLUMNS = ("ids", "x", "n", "bad")


def is_blocks(df: DataFrame) -> bool:
    return set(COLUMNS) <= set(df.columns)


def width_of(points: DataFrame, features: str = "features") -> int | None:
    """Width of some vector of ``points``; None if there is none."""
    row = points.where(F.col(features).isNotNull()).select(F.size(features).alias("d")).first()
    return None if row is None else int(row["d"])


def to_blocks(points: DataFrame, d: int, order_by: str = "id", precision: str = "double") -> DataFrame:
    """``points(id, features)`` -> blocks of vectors of width ``d``; a narrow step."""
    rows = max(1, min(1 << 16, BLOCK_BYTES // (8 * max(1, d))))
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("id", order_by)}
    src = points.select(F.col("id").alias("ids"), F.col(order_by).alias("ord"), "features")

    def fn(batches):
        import pyarrow as pa

        held, size = [], 0

        def block(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            chunk, good = read_chunk(table.column("features").chunk(0), d)
            X = chunk.dense
            short = X.astype(np.float32)
            X = short if precision == "float" or (short.astype(np.float64) == X).all() else X
            at = pa.array(good)
            keys = [pa.ListArray.from_arrays(pa.array([0, len(good)], pa.int32()), table.column(c).chunk(0).take(at)) for c in ("ids", "ord")]
            return pa.RecordBatch.from_arrays([*keys, pa.array([X.tobytes()], pa.binary()), pa.array([chunk.rows], pa.int32()), pa.array([chunk.bad], pa.int64())], ["ids", "ord", "x", "n", "bad"])

        for rb in batches:
            while rb.num_rows:
                part = rb.slice(0, rows - size)
                held.append(part)
                size += part.num_rows
                rb = rb.slice(part.num_rows)
                if size == rows:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return src.mapInArrow(fn, f"ids array<{kinds['id']}>, ord array<{kinds[order_by]}>, x binary, n int, bad long")


def matrix(x: bytes, n: int, d: int) -> np.ndarray:
    """The coordinates of a block, as doubles."""
    X = np.frombuffer(x, np.float32 if len(x) < 8 * n * d else np.float64).reshape(n, d)
    return X.astype(np.float64, copy=False)


def block_chunks(batches, d: int):
    """Chunks of blocks (columns x, n, bad)."""
    for rb in batches:
        for x, n, bad in zip(*(rb.column(c).to_pylist() for c in ("x", "n", "bad"))):
            yield Chunk(n, bad, dense=matrix(x, n, d))


def first_of_blocks(blocks: DataFrame, k: int, d: int) -> list[list[float]]:
    """Coordinates of the first ``k`` points in order of ``ord``: the keys first, then the rows up to the k-th key."""
    kind = blocks.schema["ord"].dataType.elementType.simpleString()
    keys = blocks.select(F.explode(F.slice(F.array_sort("ord"), 1, k)).alias("ord")).orderBy("ord").limit(k).collect()
    # array_sort puts nulls last, orderBy first: nulls are looked for by themselves
    missing = blocks.select(F.explode("ord").alias("ord")).where("ord IS NULL").limit(k).collect()
    keys = [*missing, *[r for r in keys if r["ord"] is not None]][:k]
    if not keys:
        return []
    last = keys[-1]["ord"]

    def rows(keep):
        """(ord, vector) of points whose key passes ``keep`` (a test of the Arrow key column)."""

        def fn(batches):
            import pyarrow as pa

            for rb in batches:
                for i, (x, n) in enumerate(zip(rb.column("x").to_pylist(), rb.column("n").to_pylist())):
                    ord_ = rb.column("ord").slice(i, 1).flatten()
                    at = np.flatnonzero(keep(ord_))[:k]
                    if len(at):
                        X = matrix(x, n, d)[at]
                        yield pa.RecordBatch.from_arrays([ord_.take(pa.array(at)), pa.array(X.tolist(), pa.list_(pa.float64()))], ["ord", "v"])

        return blocks.select("ord", "x", "n").mapInArrow(fn, f"ord {kind}, v array<double>")

    def null(a):
        return a.is_null().to_numpy(zero_copy_only=False)

    def below(a):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pc.less(a, pa.scalar(last, a.type)).fill_null(True).to_numpy(zero_copy_only=False)

    def equal(a):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pc.equal(a, pa.scalar(last, a.type)).fill_null(False).to_numpy(zero_copy_only=False)

    if last is None:
        return [r["v"] for r in rows(null).limit(k).collect()]
    before = rows(below).orderBy("ord").limit(k).collect()
    return [r["v"] for r in [*before, *rows(equal).limit(k - len(before)).collect()]]


def assign_blocks(blocks: DataFrame, centers, precision: str = "double") -> DataFrame:
    """``(id, cluster_id)`` of the points of ``blocks``."""
    from .update import _value, nearest, ship_centers
    from .pruned import searcher

    d, shipped = len(centers[0]), ship_centers(centers)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def fn(batches):
        import pyarrow as pa

        C = _value(shipped)
        search = searcher(C, np.float32 if precision == "float" else np.float64)
        for rb in batches:
            for i, (x, n) in enumerate(zip(rb.column("x").to_pylist(), rb.column("n").to_pylist())):
                m = nearest(Chunk(n, 0, dense=matrix(x, n, d)), C, precision, search) if n else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([rb.column("ids").slice(i, 1).flatten(), pa.array(m)], ["id", "cluster_id"])

    return blocks.select("ids", "x", "n").mapInArrow(fn, f"id {kind}, cluster_id int")
