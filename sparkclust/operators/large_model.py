"""Nearest centres and one Lloyd pass for a model that no driver or task can hold.

The centres are a table ``(cluster_id, center)``. Points are stored as blocks and dealt into
parts of a bounded size; blocks of centres go to every part. A task reads its part of the points,
then streams through the centre blocks in order of cluster id, and keeps a running minimum of
(distance, cluster id) for every point. So it holds one part of the points and one block of
centres at a time. The update adds exact digits by (cluster, coordinate block, place) in Spark and
ends in a table of centres again: nothing is collected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import matrix, to_blocks
from .exact import ExactSums, rounded
from .pruned import scan_distances
from .rowindex import with_row_index
from .update import SUM_BLOCK, Chunk, add_sums

#: Rows of a centre block, and bytes of coordinates (as doubles) in a part of the points.
CENTER_ROWS, PART_BYTES = 2048, 256 << 20


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seed_table(points: DataFrame, k: int, d: int, order_by: str = "id") -> DataFrame:
    """The first ``k`` points by ``order_by`` as centres (zero vectors beyond the last point), without collecting them."""
    first = with_row_index(points.select(order_by, "features"), order_by, "_place").where(F.col("_place") < k)
    slots = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    zero = F.array_repeat(F.lit(0.0), d)
    seeds = slots.join(first, F.col("cluster_id") == F.col("_place"), "left").select("cluster_id", F.coalesce("features", zero).alias("center"))
    return _stored(seeds, "large-seeds")


def _center_blocks(centers: DataFrame, d: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` centres: the ids, ascending, and their coordinates."""
    block = F.expr(f"cluster_id div {rows}")
    grouped = centers.groupBy(block.alias("at")).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "center"))).alias("c"))

    def fn(batches):
        import pyarrow as pa

        for rb in batches:
            for at, c in zip(rb.column("at").to_pylist(), rb.column("c").to_pylist()):
                X = np.array([v["center"] for v in c], np.float64).reshape(len(c), d)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([[v["cluster_id"] for v in c]], pa.list_(pa.int64())), pa.array([X.tobytes()]), pa.array([len(c)], pa.int32())], ["at", "ids", "x", "n"])

    return _stored(grouped.mapInArrow(fn, "at long, ids array<long>, x binary, n int"), "large-centers")


def _parts(points: DataFrame, centers: DataFrame, d: int, center_rows: int, part_bytes: int, precision: str) -> DataFrame:
    """Sorted rows of (part, kind 0: points, 1: centres, block): what each task streams through."""
    blocks = points if "block" in points.columns else _stored(to_blocks(points, d, "id", precision).withColumn("block", F.monotonically_increasing_id()), "large-points")
    n_rows, bad = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if bad:
        raise ValueError(f"{bad} points have a wrong width, a missing coordinate or a non-finite one (expected {d} numbers)")
    parts = max(1, math.ceil(n_rows * d * 8 / part_bytes))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    mine = blocks.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("block").alias("at"), "ids", F.lit(None).cast("array<long>").alias("clusters"), "x", "n")
    theirs = _center_blocks(centers, d, center_rows).select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "at", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.col("ids").alias("clusters"), "x", "n"
    )
    return mine.union(theirs).repartition(parts, "part").sortWithinPartitions("part", "kind", "at")


def _nearest_parts(batches, d: int, dtype):
    """(ids, coordinates, cluster) of the blocks of each part, once all centres have gone by."""
    held: list = []
    part = None

    def done():
        return [(ids, X, m) for ids, X, _, m in held]

    for rb in batches:
        for i, (p, kind, x, n) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("part", "kind", "x", "n")))):
            if p != part:
                if held:
                    yield from done()
                held, part = [], p
            if kind == 0:
                X = matrix(x, n, d)
                held.append((rb.column("ids").slice(i, 1).flatten(), X, np.full(n, np.inf), np.full(n, -1, np.int64)))
                continue
            C = np.frombuffer(x, np.float64).reshape(n, d)
            names = np.array(rb.column("clusters").slice(i, 1).flatten().to_pylist(), np.int64)
            for _, X, best, m in held:
                for a in range(0, len(X), 4096):
                    dist = scan_distances(X[a : a + 4096], C, dtype).astype(np.float64)
                    at = dist.argmin(1)
                    least = dist[np.arange(len(at)), at]
                    nearer = least < best[a : a + 4096]  # centres come in order of id: the lowest wins a tie
                    best[a : a + 4096][nearer] = least[nearer]
                    m[a : a + 4096][nearer] = names[at[nearer]]
    if held:
        yield from done()


def predict_large(points: DataFrame, centers: DataFrame, d: int, center_rows: int = CENTER_ROWS, part_bytes: int = PART_BYTES, precision: str = "double") -> DataFrame:
    """``(id, cluster_id)`` of ``points(id, features)`` for a table of centres; equals ``predict``."""
    rows = _parts(points, centers, d, center_rows, part_bytes, precision)
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    dtype = np.float32 if precision == "float" else np.float64

    def fn(batches):
        import pyarrow as pa

        for ids, _, m in _nearest_parts(batches, d, dtype):
            yield pa.RecordBatch.from_arrays([ids, pa.array(m.astype(np.int32))], ["id", "cluster_id"])

    return rows.mapInArrow(fn, f"id {kind}, cluster_id int")


def lloyd_pass_large(points: DataFrame, centers: DataFrame, d: int, center_rows: int = CENTER_ROWS, part_bytes: int = PART_BYTES, precision: str = "double") -> DataFrame:
    """One pass: ``(cluster_id, center, n)``; an empty cluster keeps its centre. Equals a pass of ``fit``."""
    rows = _parts(points, centers, d, center_rows, part_bytes, precision)
    dtype = np.float32 if precision == "float" else np.float64
    blocks = -(-d // SUM_BLOCK)

    def partials(batches):
        import pyarrow as pa

        for ids, X, m in _nearest_parts(batches, d, dtype):
            if not len(m):
                continue
            names, at = np.unique(m, return_inverse=True)  # only the clusters met in this block
            sums = ExactSums(len(names), blocks * SUM_BLOCK)
            add_sums(Chunk(len(m), 0, dense=X), at, sums)
            size = np.bincount(at, minlength=len(names))
            out = [(int(c), -1, 0, int(k), None) for c, k in zip(names, size)]
            for place, digit in sums.settle().items():
                by_block = digit.reshape(len(names), blocks, SUM_BLOCK)
                out += [(int(names[c]), b, place, 0, by_block[c, b].tolist()) for c, b in np.argwhere(by_block.any(2)).tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["cluster_id", "block", "place", "n", "vals"])

    parts = rows.mapInArrow(partials, "cluster_id int, block int, place int, n long, vals array<long>")
    sums = [F.sum(F.get("vals", F.lit(j))).alias(f"s{j}") for j in range(SUM_BLOCK)]
    merged = _stored(parts.groupBy("cluster_id", "block", "place").agg(F.sum("n").alias("n"), *sums), "large-sums")
    # the places of one block of one centre: a list of at most a few dozen
    digits = merged.where("block >= 0").groupBy("cluster_id", "block").agg(F.collect_list(F.struct("place", F.array(*[f"s{j}" for j in range(SUM_BLOCK)]).alias("v"))).alias("p"))
    sizes = merged.where("block < 0").select(F.col("cluster_id").alias("_c"), "n")
    counted = sizes.join(digits, F.col("cluster_id") == F.col("_c"), "left").select(F.col("_c").alias("cluster_id"), F.coalesce("block", F.lit(0)).alias("block"), "n", "p")

    def means(batches):
        import pyarrow as pa

        for rb in batches:
            out = []
            for n, p in zip(rb.column("n").to_pylist(), rb.column("p").to_pylist()):
                cols = [{x["place"]: x["v"][j] for x in p or ()} for j in range(SUM_BLOCK)]
                mean = [rounded(c) / n for c in cols]
                out.append(np.float32(mean).astype(np.float64).tolist() if precision == "float" else mean)
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in ("cluster_id", "block", "n")], pa.array(out, pa.list_(pa.float64()))], ["cluster_id", "block", "n", "mean"])

    done = counted.mapInArrow(means, "cluster_id int, block int, n long, mean array<double>")
    # a centre is put together from its d / 32 blocks; a block whose sums are all zero has no row
    zero = F.array_repeat(F.lit(0.0), SUM_BLOCK)
    listed = done.groupBy(F.col("cluster_id").alias("_c")).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("block", "mean"))).alias("by"))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.try_element_at("by", b), zero)))
    new = listed.select("_c", "n", F.slice(whole, 1, d).alias("mean"))
    joined = centers.join(new, F.col("cluster_id") == F.col("_c"), "left")
    return _stored(joined.select("cluster_id", F.coalesce("mean", "center").alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "large-pass")


def fit_large(points: DataFrame, k: int, d: int, max_iter: int, order_by: str = "id", precision: str = "double", center_rows: int = CENTER_ROWS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``max_iter`` passes from the first ``k`` points: (centres with sizes, lagged membership). Equals ``fit``; nothing is collected."""
    sizes = {"center_rows": center_rows, "part_bytes": part_bytes, "precision": precision}
    blocks = _stored(to_blocks(points, d, "id", precision).withColumn("block", F.monotonically_increasing_id()), "large-points")
    centers, previous = seed_table(points, k, d, order_by), None
    for _ in range(max_iter):
        previous = centers.select("cluster_id", "center")
        centers = lloyd_pass_large(blocks, previous, d, **sizes)
    return centers, predict_large(blocks, previous, d, **sizes)
