"""One Lloyd step as a partial + final aggregate, and the centre update rule.

``mapInArrow`` computes per-task partials with NumPy, for vectors of any width, dense or sparse,
or for stored blocks of points (``operators.blocks``). The centres are data of the task, so the plan
of every pass is the same and nothing is compiled anew. Sums are kept exact, as digits
(``operators.exact``): partials leave a task as whole numbers in blocks of 32 coordinates, and a
``groupBy(cluster_id, block, place)`` with 32 sums of LONG columns merges them. So the sums don't
depend on how the points are partitioned, whatever the number or skew of points.

Beside its partials every task emits what it did: rows, distances worked out, and the time spent
on waiting for input, on distances and on sums.

``partials_expr`` computes the same statistics as pure Catalyst expressions (``path="expr"``, small
models; plain double sums, whose last digits depend on the partitioning).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import with_nearest
from .exact import ExactSums, rounded
from .pruned import Scan, scan_distances, searcher

_CHUNK_ROWS = 4096
# Coordinates (sparse: entries) that a chunk of several rows may hold.
_CHUNK_VALUES = 1 << 19
# Models above this many numbers travel as a broadcast variable, not inside each task.
BROADCAST_MIN_VALUES = 100_000


def ship_centers(centers):
    """K x d centres for Arrow batch functions: a NumPy array, or a broadcast for big models."""
    C = np.asarray(centers, dtype=np.float64)
    if C.size > BROADCAST_MIN_VALUES:
        from pyspark import SparkContext

        return SparkContext.getOrCreate().broadcast(C)
    return C


SPARSE_TYPE = "struct<size:int,idx:array<int>,val:array<double>>"


def is_sparse(df: DataFrame, features: str = "features") -> bool:
    """True when ``features`` is the sparse ``struct<size, idx, val>`` form."""
    from pyspark.sql.types import StructType

    return isinstance(df.schema[features].dataType, StructType)


@dataclass
class Chunk:
    """Some points in memory: a dense matrix, or the entries of sparse rows; ``bad`` rows are left out."""

    rows: int
    bad: int
    dense: np.ndarray | None = None
    where: np.ndarray | None = None  # row of each sparse entry
    idx: np.ndarray | None = None
    val: np.ndarray | None = None

    def matrix(self, d: int, picked: np.ndarray | None = None) -> np.ndarray:
        """The rows (or some of them) as a dense matrix."""
        if self.dense is not None:
            return self.dense if picked is None else self.dense[picked]
        place = np.arange(self.rows) if picked is None else np.full(self.rows, -1)
        if picked is not None:
            place[picked] = np.arange(len(picked))
        at = place[self.where]
        X = np.zeros((self.rows if picked is None else len(picked), d))
        np.add.at(X, (at[at >= 0], self.idx[at >= 0]), self.val[at >= 0])
        return X


def chunk_slices(col):
    """(first row, rows) of the chunks an Arrow vector column is read in, bounded in rows and in values."""
    import pyarrow as pa

    lists = col.field("idx") if pa.types.is_struct(col.type) else col
    offsets = np.asarray(lists.offsets)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + _CHUNK_VALUES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + _CHUNK_ROWS, len(col))
        yield lo, hi - lo
        lo = hi


def read_chunk(col, d: int) -> tuple[Chunk, np.ndarray]:
    """An Arrow vector column -> its usable rows, and which rows those are.

    A row counts as bad, on its own, when it is null, of another width than ``d``, or holds a null or
    non-finite coordinate (sparse: or an index out of range).
    """
    import pyarrow as pa

    n = len(col)
    ok = np.ones(n, bool) if not col.null_count else ~col.is_null().to_numpy(zero_copy_only=False)

    def parts(lists):
        lens = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(np.asarray(lists.offsets)))
        return lens, lists.flatten()

    def numbers(values):
        missing = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(values), bool)
        x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        return x, missing | ~np.isfinite(x)

    if pa.types.is_struct(col.type):
        size, idx, val = (col.field(k) for k in ("size", "idx", "val"))
        lens, flat_idx = parts(idx)
        val_lens, flat_val = parts(val)
        ok &= (size.fill_null(-1).to_numpy(zero_copy_only=False) == d) & (lens == val_lens)
        where = np.repeat(np.arange(n), lens)
        if (lens != val_lens).any():  # keep the two lists in step
            keep_i, keep_v = np.repeat(lens == val_lens, lens), np.repeat(lens == val_lens, val_lens)
            where, flat_idx, flat_val = where[keep_i], flat_idx.filter(pa.array(keep_i)), flat_val.filter(pa.array(keep_v))
        x, wrong = numbers(flat_val)
        i = flat_idx.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ok[where[wrong | (i < 0) | (i >= d)]] = False
        good = np.flatnonzero(ok)
        place = np.cumsum(ok) - 1
        keep = ok[where]
        return Chunk(len(good), n - len(good), where=place[where[keep]], idx=i[keep], val=x[keep]), good
    lens, flat = parts(col)
    ok &= lens == d
    x, wrong = numbers(flat)
    if wrong.any():
        ok[np.repeat(np.arange(n), lens)[wrong]] = False
    good = np.flatnonzero(ok)
    if len(good) < n:
        x = x[np.repeat(ok, lens)]
    return Chunk(len(good), n - len(good), dense=x.reshape(len(good), d)), good


def dense_row(v) -> list[float]:
    """One collected vector (dense list or sparse Row) -> dense list (driver side, K rows only)."""
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [float(x) for x in v]
    out = [0.0] * int(v["size"])
    for i, x in zip(v["idx"], v["val"]):
        out[int(i)] = float(x)
    return out


#: What the metric row of a task holds, in order.
METRICS = ("tasks", "rows", "distances", "read_ns", "distance_ns", "sum_ns")


@dataclass
class StepStats:
    n: list[int]  # points per cluster
    changed: list[int]  # points whose cluster differs from the previous assignment
    sums: list[list[float]]  # coordinate sums per cluster
    metrics: dict[str, int] = field(default_factory=dict)  # METRICS, summed over the tasks
    tasks: DataFrame | None = None  # (task, and METRICS) on request


def choose_path(path: str = "auto", sparse: bool = False) -> str:
    if path not in ("auto", "expr", "arrow"):
        raise ValueError(f"unknown path {path!r}")
    if path == "expr" and sparse:
        raise ValueError("sparse vectors use the Arrow path")
    return "arrow" if path == "auto" else path


def partials_expr(points: DataFrame, centers, prev=None, features: str = "features", precision: str = "double") -> DataFrame:
    """``(cluster_id, n, changed, s_0 .. s_(d-1))`` through the expression path."""
    d = len(centers[0])
    assigned = with_nearest(points.select(F.col(features).alias("_x")), centers, "cluster_id", "_x", precision)
    if prev is None:
        assigned = assigned.withColumn("_chg", F.lit(1))
    else:
        assigned = with_nearest(assigned, prev, "_prev", "_x", precision).withColumn(
            "_chg", (F.col("cluster_id") != F.col("_prev")).cast("int")
        )
    # rows of the wrong width or with a missing or non-finite coordinate are counted, not guessed at
    # (unrolled tests: no lambda, so the check stays in generated code; NaN sorts above infinity)
    odd = " OR ".join(f"isnull(get(_x, {j})) OR NOT abs(get(_x, {j})) < double('infinity')" for j in range(d))
    bad = f"CAST(sum(CASE WHEN _x IS NULL OR size(_x) <> {d} THEN 1 WHEN {odd} THEN 1 ELSE 0 END) AS BIGINT) AS bad"
    aggs = ["count(1) AS n", "CAST(sum(_chg) AS BIGINT) AS changed", bad]
    aggs += [f"sum(get(_x, {j})) AS s_{j}" for j in range(d)]
    return assigned.groupBy("cluster_id").agg(*[F.expr(a) for a in aggs])


def nearest(chunk: Chunk, C: np.ndarray, precision: str = "double", search=None) -> np.ndarray:
    """Index of the nearest centre of each row, the lowest on ties.

    Sparse rows use |x|^2 - 2 x.c + |c|^2 over their entries; rows whose two best values
    lie within rounding of each other are settled by the plain scan. ``search`` is a prepared
    ``searcher`` of the same centres.
    """
    d = C.shape[1]
    if chunk.dense is not None or precision == "float":
        search = search or searcher(C, np.float32 if precision == "float" else np.float64)
        return search.nearest(chunk.matrix(d))
    dot = np.stack([np.bincount(chunk.where, chunk.val * c[chunk.idx], chunk.rows) for c in C], axis=1)
    square = np.bincount(chunk.where, chunk.val**2, chunk.rows)[:, None]
    cc = (C * C).sum(1)
    dist = square - 2 * dot + cc
    best = dist.argmin(1)
    if len(C) > 1:
        two = np.partition(dist, 1, axis=1)[:, :2]
        close = np.flatnonzero(two[:, 1] - two[:, 0] <= 1e-9 * (square[:, 0] + cc.max() + 1))
        for at in np.array_split(close, -(-len(close) // 512)) if len(close) else ():
            best[at] = scan_distances(chunk.matrix(d, at), C, np.float64).argmin(1)
    return best.astype(np.int32)


class Assigner:
    """Assignment of chunks to ``C``, and whether it differs from the assignment to ``P``.

    The distance to a centre changes by no more than the centre moved. Where the best centre of a
    row leads the second best by more than both moved, the assignment to ``P`` is the same and is
    not worked out.
    """

    #: Below this width a second scan costs less than looking for the second best.
    MIN_WIDTH = 8

    def __init__(self, C: np.ndarray, P: np.ndarray | None, precision: str = "double"):
        self.C, self.P, self.precision = C, P, precision
        dtype = np.float32 if precision == "float" else np.float64
        self.now, self.then = searcher(C, dtype), None if P is None else searcher(P, dtype)
        self.sparse = 0
        self.moved = None if P is None else np.sqrt(((C - P) ** 2).sum(1))

    @property
    def evaluated(self) -> int:
        return self.now.evaluated + (self.then.evaluated if self.then else 0) + self.sparse

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray | None]:
        """(cluster of each row, changed or not; None without ``P``)."""
        if chunk.dense is None and self.precision != "float":
            self.sparse += chunk.rows * len(self.C) * (1 if self.P is None else 2)
        m, lead = None, None
        if self.P is not None and chunk.dense is not None and isinstance(self.now, Scan) and len(self.C) > 1 and self.C.shape[1] >= self.MIN_WIDTH:
            dist = scan_distances(chunk.dense, self.C, self.now.dtype)
            self.now.evaluated += dist.size
            m = dist.argmin(1).astype(np.int32)
            two = np.sqrt(np.partition(dist, 1, axis=1)[:, :2].astype(np.float64))
            slack = 1e-3 if self.precision == "float" else 1e-9
            lead = two[:, 1] - two[:, 0] > (self.moved[m] + self.moved.max()) * (1 + slack) + slack * two[:, 1]
        if m is None:
            m = nearest(chunk, self.C, self.precision, self.now)
        if self.P is None:
            return m, None
        if lead is None:
            return m, nearest(chunk, self.P, self.precision, self.then) != m
        changed, open_ = np.zeros(len(m), bool), np.flatnonzero(~lead)
        if len(open_):
            changed[open_] = self.then.nearest(chunk.dense[open_]) != m[open_]
        return m, changed


def add_sums(chunk: Chunk, m: np.ndarray, total: ExactSums) -> None:
    """Add the rows of each cluster to ``total``."""
    if chunk.dense is not None:
        total.add_dense(chunk.dense, m)
    else:
        total.add_sparse(m[chunk.where] * np.int64(total.shape[1]) + chunk.idx, chunk.val)


# Partial sums leave a task in blocks of this many coordinates: K * ceil(d / B)
# rows per task and place of digits, merged by (cluster, block, place) with B plain sums each.
SUM_BLOCK = 32
_PARTIALS = "task int, cluster_id int, block int, place int, n long, changed long, bad long, vals array<long>"


def _timed(batches, spent: list[int]):
    """``batches`` with the nanoseconds spent on waiting for them in ``spent[0]``."""
    batches = iter(batches)
    while True:
        t0 = time.perf_counter_ns()
        batch = next(batches, None)
        spent[0] += time.perf_counter_ns() - t0
        if batch is None:
            return
        yield batch


def vector_chunks(batches, d: int):
    """Chunks of an Arrow vector column."""
    for rb in batches:
        col = rb.column(0)
        for lo, n in chunk_slices(col):
            yield read_chunk(col.slice(lo, n), d)[0]


class Partials:
    """What a task gathers: counts and exact sums per cluster, and its metrics."""

    def __init__(self, k: int, d: int):
        self.k, self.d, self.blocks = k, d, -(-d // SUM_BLOCK)
        self.n, self.changed, self.bad = np.zeros(k, np.int64), np.zeros(k, np.int64), 0
        self.sums = ExactSums(k, self.blocks * SUM_BLOCK)
        self.read, self.distance_ns, self.sum_ns = [0], 0, 0

    def add(self, chunk: Chunk, assign: Assigner) -> np.ndarray | None:
        """Count and sum the rows of a chunk; returns their clusters."""
        self.bad += chunk.bad
        if not chunk.rows:
            return None
        t0 = time.perf_counter_ns()
        m, changed = assign(chunk)
        t1 = time.perf_counter_ns()
        self.add_assigned(chunk, m, changed)
        self.distance_ns += t1 - t0
        self.sum_ns += time.perf_counter_ns() - t1
        return m

    def add_assigned(self, chunk: Chunk, m: np.ndarray, changed: np.ndarray | None) -> None:
        counts = np.bincount(m, minlength=self.k)
        self.n += counts
        self.changed += counts if changed is None else np.bincount(m[changed], minlength=self.k)
        add_sums(chunk, m, self.sums)

    def batch(self, evaluated: int):
        """The Arrow batch of _PARTIALS rows."""
        import pyarrow as pa
        from pyspark import TaskContext

        rows: list[tuple] = []
        vals: list[np.ndarray] = []

        def row(cluster, block, place, n=0, changed=0, bad=0, values=()):
            rows.append((cluster, block, place, n, changed, bad))
            vals.append(np.pad(np.asarray(values, np.int64), (0, SUM_BLOCK - len(values))))

        total = int(self.n.sum())
        row(-1, -1, 0, bad=self.bad, values=(1, total, evaluated, self.read[0], self.distance_ns, self.sum_ns))
        for c in np.flatnonzero(self.n).tolist():
            row(c, -1, 0, int(self.n[c]), int(self.changed[c]))
        for place, digit in self.sums.settle().items():
            by_block = digit.reshape(self.k, self.blocks, SUM_BLOCK)
            for c, b in np.argwhere(by_block.any(2)).tolist():
                row(c, b, place, values=by_block[c, b])
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(vals)), SUM_BLOCK).cast(pa.list_(pa.int64()))
        names = ["task", "cluster_id", "block", "place", "n", "changed", "bad", "vals"]
        arrays = [pa.array(np.full(len(rows), task, np.int32)), *[pa.array(c, k) for c, k in zip(cols, kinds)], lists]
        return pa.RecordBatch.from_arrays(arrays, names)


def _value(shipped):
    return shipped.value if hasattr(shipped, "value") else shipped


def _partials_fn(centers, prev, d: int, precision: str = "double", shipped=None, chunks=vector_chunks):
    C_ship, P_ship = shipped or (ship_centers(centers), None if prev is None else ship_centers(prev))
    k = len(centers)

    def fn(batches):
        assign, out = Assigner(_value(C_ship), _value(P_ship), precision), Partials(k, d)
        for chunk in chunks(_timed(batches, out.read), d):
            if precision == "float" and chunk.dense is not None:
                chunk.dense = chunk.dense.astype(np.float32).astype(np.float64)
            out.add(chunk, assign)
        if out.n.any() or out.bad:
            yield out.batch(assign.evaluated)

    return fn


def task_partials(points: DataFrame, centers, prev=None, features: str = "features", precision: str = "double", shipped=None) -> DataFrame:
    """Per-task partial rows of the Arrow path, not merged; ``points`` may be stored blocks."""
    from .blocks import block_chunks, is_blocks

    d = len(centers[0])
    stored = is_blocks(points)
    cols = [F.col(c) for c in ("x", "n", "bad")] if stored else [F.col(features)]
    fn = _partials_fn(centers, prev, d, precision, shipped, block_chunks if stored else vector_chunks)
    return points.select(*cols).mapInArrow(fn, _PARTIALS)


def merge_partials(parts: DataFrame) -> DataFrame:
    """``(cluster_id, block, place, n, changed, bad, s_0 .. s_(B-1))`` totals of whole numbers, exact in any order."""
    aggs = [F.sum("n").alias("n"), F.sum("changed").alias("changed"), F.sum("bad").alias("bad")]
    aggs += [F.expr(f"sum(vals[{j}]) AS s_{j}") for j in range(SUM_BLOCK)]
    return parts.groupBy("cluster_id", "block", "place").agg(*aggs)


def partials_arrow(points: DataFrame, centers, prev=None, features: str = "features", precision: str = "double", shipped=None) -> DataFrame:
    """Merged partials of the Arrow path (see ``merge_partials``): K * ceil(d / B) rows for each place of digits."""
    return merge_partials(task_partials(points, centers, prev, features, precision, shipped))


def read_stats(rows, k: int, d: int) -> tuple[StepStats, int]:
    """Statistics from collected totals, and the number of bad rows."""
    n, changed, bad = [0] * k, [0] * k, 0
    metrics = dict.fromkeys(METRICS, 0)
    parts: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        c, block = r["cluster_id"], r["block"]
        if c < 0:
            bad += r["bad"]
            metrics = {m: metrics[m] + r[f"s_{j}"] for j, m in enumerate(METRICS)}
        elif block < 0:
            n[c], changed[c] = int(r["n"]), int(r["changed"])
        else:
            for j in range(block * SUM_BLOCK, min((block + 1) * SUM_BLOCK, d)):
                if q := r[f"s_{j - block * SUM_BLOCK}"]:
                    parts.setdefault((c, j), {})[r["place"]] = q
    sums = [[0.0] * d for _ in range(k)]
    for (c, j), places in parts.items():
        sums[c][j] = rounded(places)
    return StepStats(n, changed, sums, metrics), bad


def check_rows(bad: int, d: int) -> None:
    if bad:
        raise ValueError(
            f"{bad} points have a wrong width, a missing coordinate or a non-finite one (expected {d} numbers); "
            "filter them with split_rejects first"
        )


def task_rows(parts: DataFrame) -> DataFrame:
    """(task, and METRICS) of the per-task partials."""
    return parts.where("cluster_id = -1").select("task", *[F.col("vals")[j].alias(m) for j, m in enumerate(METRICS) if m != "tasks"])


def step_stats(
    points: DataFrame,
    centers,
    prev=None,
    path: str = "auto",
    features: str = "features",
    precision: str = "double",
    task_report: bool = False,
) -> StepStats:
    """Run one assignment + partial aggregation pass; collect only K (x d) numbers.

    ``task_report`` writes the per-task partials to the scratch folder once and gives the tasks' metrics as a table.
    """
    from .blocks import is_blocks

    k, d = len(centers), len(centers[0])
    if choose_path(path, is_blocks(points) or is_sparse(points, features)) == "expr":
        n, changed, sums, bad = [0] * k, [0] * k, [[0.0] * d for _ in range(k)], 0
        for r in partials_expr(points, centers, prev, features, precision).collect():
            c = r["cluster_id"]
            bad += r["bad"]
            n[c], changed[c] = int(r["n"]), int(r["changed"])
            sums[c] = [float(r[f"s_{j}"] or 0.0) for j in range(d)]
        check_rows(bad, d)
        return StepStats(n, changed, sums)
    shipped = [ship_centers(c) if c is not None else None for c in (centers, prev)]
    parts = task_partials(points, centers, prev, features, precision, shipped)
    if task_report:
        from ..session import scratch_path

        where = scratch_path(parts.sparkSession, "pass")
        parts.write.parquet(where)
        parts = parts.sparkSession.read.schema(parts.schema).parquet(where)
    stats, bad = read_stats(merge_partials(parts).collect(), k, d)
    for b in shipped:
        if hasattr(b, "unpersist"):
            b.unpersist()
    check_rows(bad, d)
    if task_report:
        stats.tasks = task_rows(parts)
    return stats


def update_centers(old: Sequence[Sequence[float]], stats: StepStats, precision: str = "double") -> list[list[float]]:
    """Mean of each cluster (its exact sum as a double, divided by its size); an empty cluster keeps its previous centre.

    With ``precision="float"`` the mean is rounded to a 32-bit value.
    """
    from ..functions.vector import round_centers

    new = []
    for k, row in enumerate(old):
        if stats.n[k] > 0:
            new.append([s / stats.n[k] for s in stats.sums[k]])
        else:
            new.append([float(v) for v in row])
    return round_centers(new, precision)
