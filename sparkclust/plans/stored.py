"""Training on stored tables: points, membership and log in shared storage, continued at any time.

``store_training`` writes the points once as blocks, bucketed by block number. A pass joins
them with the membership of the pass before, stored in the same buckets, so the join needs no shuffle.
It writes the new membership, and in the same rows what the task has summed up. So

* the change count compares stored labels: no pass assigns against two models, and a run that
  continues from a saved model and membership (a warm start) has it from its first pass on;
* each row's lead (distance to the second nearest centre less that to the nearest) is kept too.
  Where the centres moved less than that, the label stands and no distance is worked out;
* a run that was stopped continues from the last finished pass and gives the same bits.

A folder holds ``points``, ``pass-<t>`` (membership) and ``log``.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import round_centers
from ..operators.blocks import first_of_blocks, matrix, to_blocks, width_of
from ..operators.pruned import CenterGroups, MIN_CENTERS, scan_distances
from ..operators.update import _PARTIALS, Chunk, Partials, _timed, _value, check_rows, merge_partials, read_stats, ship_centers, update_centers
from ..session import path_exists
from .kmeans import KMeansRun
from .passlog import PassLog, fingerprint

_POINTS = "block long, ids array<{id}>, ord array<{ord}>, x binary, n int, bad long"
_LABELS = f"block long, labels binary, lead binary, parts array<struct<{_PARTIALS.replace(' ', ':').replace(',:', ',')}>>"


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """``df`` as Parquet files at ``path``, bucketed and sorted by ``block``; nothing stays in the catalog."""
    name = f"sparkclust_{uuid.uuid4().hex}"
    df.write.mode("overwrite").bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay


def _open_bucketed(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """The files of ``_write_bucketed`` as a bucketed table of this session."""
    name = f"sparkclust_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class _Leads:
    """Labels and leads of blocks for centres that moved from ``P`` to ``C``."""

    def __init__(self, C: np.ndarray, P: np.ndarray | None, precision: str):
        self.C, self.dtype, self.evaluated = C, np.float32 if precision == "float" else np.float64, 0
        self.slack = 1e-3 if precision == "float" else 1e-9
        self.moved = np.zeros(len(C)) if P is None else np.sqrt(((C - P) ** 2).sum(1))
        self.groups = CenterGroups(C, self.dtype) if len(C) >= MIN_CENTERS else None

    def _fresh(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.groups is not None:
            # the search by groups gives no second distance; it is used where it spares most of them
            before = self.groups.evaluated
            trial = X[: max(64, len(X) // 16)]
            m = self.groups.nearest(trial)
            if self.groups.evaluated - before < 0.4 * len(trial) * len(self.C):
                m = np.concatenate([m, self.groups.nearest(X[len(trial) :])]) if len(X) > len(trial) else m
                self.evaluated += self.groups.evaluated - before
                return m, np.zeros(len(X), np.float32)
            self.evaluated += self.groups.evaluated - before
            self.groups = None
        m, lead = np.empty(len(X), np.int32), np.empty(len(X), np.float32)
        for a in range(0, len(X), 2048):
            dist = scan_distances(X[a : a + 2048], self.C, self.dtype)
            self.evaluated += dist.size
            m[a : a + 2048] = dist.argmin(1)
            if len(self.C) == 1:
                lead[a : a + 2048] = np.inf
                continue
            two = np.sqrt(np.partition(dist, 1, axis=1)[:, :2].astype(np.float64))
            sure = two[:, 1] - two[:, 0] - self.slack * (1 + two[:, 1])
            lead[a : a + 2048] = np.nextafter(sure.astype(np.float32), np.float32(-np.inf))
        return m, lead

    def __call__(self, X: np.ndarray, labels: np.ndarray | None, lead: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if labels is None:
            return self._fresh(X)
        left = lead - (self.moved[labels] + self.moved.max()) * (1 + self.slack)
        m, lead = labels.copy(), np.nextafter(left.astype(np.float32), np.float32(-np.inf))
        if len(open_ := np.flatnonzero(~(lead > 0))):
            m[open_], lead[open_] = self._fresh(X[open_])
        return m, lead


def _pass_fn(C_ship, P_ship, k: int, d: int, precision: str):
    """Joined rows (block, x, n, bad, labels, lead) -> (block, labels, lead, parts); the last row has what the task summed up."""

    def fn(batches):
        import pyarrow as pa

        assign, out = _Leads(_value(C_ship), _value(P_ship), precision), Partials(k, d)
        waiting = None

        def row(block, m, lead, parts):
            listed = pa.array([parts], pa.list_(_parts_type()))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([m.tobytes()]), pa.array([lead.tobytes()]), listed], ["block", "labels", "lead", "parts"])

        for rb in _timed(batches, out.read):
            for block, x, n, bad, labels, lead in zip(*(rb.column(c).to_pylist() for c in ("block", "x", "n", "bad", "labels", "lead"))):
                out.bad += bad
                X = matrix(x, n, d)
                before = None if labels is None else np.frombuffer(labels, np.int32)
                t0 = time.perf_counter_ns()
                m, lead = assign(X, before, None if lead is None else np.frombuffer(lead, np.float32)) if n else (np.empty(0, np.int32), np.empty(0, np.float32))
                t1 = time.perf_counter_ns()
                if n:
                    out.add_assigned(Chunk(n, 0, dense=X), m, None if before is None else m != before)
                out.distance_ns, out.sum_ns = out.distance_ns + t1 - t0, out.sum_ns + time.perf_counter_ns() - t1
                if waiting:
                    yield row(*waiting, None)
                waiting = (block, m, lead)
        if waiting:
            yield row(*waiting, out.batch(assign.evaluated).to_pylist())

    return fn


def _parts_type():
    import pyarrow as pa

    whole = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.struct([(name, whole[kind]) for name, kind in (c.split() for c in _PARTIALS.split(", "))])


class StoredTraining:
    """A training folder; ``train`` adds passes to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = json.loads(spark.read.text(f"{self.path}/about").first()["value"])
        self.k, self.d, self.precision, self.buckets = (self.about[c] for c in ("k", "d", "precision", "buckets"))
        self.points = _open_bucketed(spark, f"{self.path}/points", self.about["points"], self.buckets)
        self.log = PassLog(spark, f"{self.path}/log", self.about["mark"])
        last = self.log.last() or {"centers": self.about["seeds"], "previous": None, "history": []}
        self.centers, self.previous, self.history = last["centers"], last["previous"], last["history"]

    def _labels(self, t: int) -> DataFrame:
        return _open_bucketed(self.spark, f"{self.path}/pass-{t:06d}", _LABELS, self.buckets)

    def _with_labels(self, points: DataFrame, t: int) -> DataFrame:
        """Points beside their stored labels: both sides lie in the same buckets, so neither is shuffled."""
        before = self._labels(t).select(F.col("block").alias("_block"), "labels", "lead")
        return points.hint("merge").join(before.hint("merge"), F.col("block") == F.col("_block"), "left").drop("_block")

    def next_labels(self) -> DataFrame:
        """What the next pass writes: (block, labels, lead, parts)."""
        cols = self.points.select("block", "x", "n", "bad")
        if self.history:
            rows = self._with_labels(cols, self.history[-1]["iteration"])
        else:
            rows = cols.withColumns({"labels": F.lit(None).cast("binary"), "lead": F.lit(None).cast("binary")})
        ships = ship_centers(self.centers), None if self.previous is None else ship_centers(self.previous)
        return rows.mapInArrow(_pass_fn(*ships, self.k, self.d, self.precision), _LABELS)

    def train(self, max_iter: int, threshold: float | None = None) -> StoredTraining:
        """Add passes until there are ``max_iter`` of them, or until one changes a share of at most ``threshold``."""
        while len(self.history) < max_iter and not (threshold is not None and self.history and self.history[-1]["delta"] <= threshold):
            t0, t = time.time(), len(self.history) + 1
            _write_bucketed(self.next_labels(), f"{self.path}/pass-{t:06d}", self.buckets)
            parts = self._labels(t).select(F.explode("parts").alias("p")).select("p.*")
            stats, bad = read_stats(merge_partials(parts).collect(), self.k, self.d)
            check_rows(bad, self.d)
            n, changed = sum(stats.n), sum(stats.changed)
            entry = {"iteration": t, "n": n, "changed": changed, "delta": changed / n, "elapsed_ms": int((time.time() - t0) * 1000), "metrics": stats.metrics}
            self.previous, self.centers = self.centers, update_centers(self.centers, stats, self.precision)
            self.history = [*self.history, entry]
            self.log.add(t, self.centers, self.previous, self.history)
        return self

    def membership(self) -> DataFrame:
        """``(id, cluster_id)`` of the last pass, read from the stored labels."""
        kind = self.points.schema["ids"].dataType.elementType.simpleString()

        def fn(batches):
            import pyarrow as pa

            for rb in batches:
                for i, labels in enumerate(rb.column("labels").to_pylist()):
                    yield pa.RecordBatch.from_arrays([rb.column("ids").slice(i, 1).flatten(), pa.array(np.frombuffer(labels, np.int32))], ["id", "cluster_id"])

        rows = self._with_labels(self.points.select("block", "ids"), self.history[-1]["iteration"])
        return rows.select("ids", "labels").mapInArrow(fn, f"id {kind}, cluster_id int")

    def run(self) -> KMeansRun:
        """The training as ``fit`` returns it."""
        return KMeansRun(self.centers, self.previous, self.membership(), self.history, self.history[0]["n"], self.d, "stored")


def store_training(points: DataFrame, path: str, k: int, order_by: str = "id", precision: str = "double", init=None, buckets: int | None = None) -> StoredTraining:
    """Write ``points(id, features)`` to a training folder; an existing folder of the same input and settings is opened instead."""
    spark, path = points.sparkSession, path.rstrip("/")
    mark = fingerprint(points, k=k, precision=precision, order_by=order_by, init=init)
    if path_exists(spark, f"{path}/about/_SUCCESS"):
        found = StoredTraining(spark, path)
        if found.about["mark"] != json.loads(json.dumps(mark)):
            raise ValueError(f"{path} holds a training of other points or settings")
        return found
    d = len(init[0]) if init else width_of(points)
    if d is None:
        raise ValueError("empty input: cannot train on zero points")
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = to_blocks(points.repartition(n) if mark["rows"] < n * 65536 else points, d, order_by, precision)
    numbered = blocks.select(F.monotonically_increasing_id().alias("block"), "*")
    _write_bucketed(numbered.repartition(n, "block"), f"{path}/points", n)
    schema = _POINTS.format(**{c: blocks.schema[a].dataType.elementType.simpleString() for c, a in (("id", "ids"), ("ord", "ord"))})
    stored = _open_bucketed(spark, f"{path}/points", schema, n)
    check_rows(int(stored.agg(F.sum("bad")).first()[0] or 0), d)
    seeds = init if init else first_of_blocks(stored, k, d)
    seeds = round_centers([*seeds, *[[0.0] * d] * (k - len(seeds))], precision)
    about = {"k": k, "d": d, "precision": precision, "buckets": n, "points": schema, "mark": mark, "seeds": seeds}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return StoredTraining(spark, path)
