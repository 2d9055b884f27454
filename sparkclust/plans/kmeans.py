"""Lloyd's K-means with first-K seeding, as a short driver loop over DataFrame passes.

Contract (per run)::

    C_0 = first K points in order (zero vectors pad when N < K)
    for t = 1..T:
        m_t     = argmin_k |x - C_(t-1),k|^2          ties -> lowest k
        delta_t = |{i : m_t(i) != m_(t-1)(i)}| / N    m_0 = -1, so delta_1 = 1
        C_t,k   = mean{x : m_t = k}, or C_(t-1),k when that set is empty
    stop: "fixed" runs T passes; "threshold" stops after the first pass with
          delta_t <= threshold (at least one pass, at most T)
    result: C_T and m_T (computed against C_(T-1), "lagged") or against C_T ("final")

Each pass is one job: points -> assignment -> map-side partial sums ->
shuffle of at most K (x d) rows per task -> K rows to the driver. The centres
re-enter the next plan as a constant, so the lineage never grows with T. The
change count needs no stored membership: the pass evaluates the assignment
against C_(t-1) and, where the centres' moves leave it open, against C_(t-2).

With ``log`` every finished pass is written to a folder in shared storage; a
run that was stopped goes on from there with ``resume=True``. Sums are exact,
so the outcome is the same to the last bit. ``plans.stored`` keeps points and
membership as tables, too.
"""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import round_centers, with_nearest
from ..operators.blocks import assign_blocks, first_of_blocks, to_blocks, width_of
from ..session import ensure_checkpoint_dir, ensure_parallelism
from ..operators.seed import centers_frame, seed_first_k
from ..operators.assign import predict
from ..operators.update import METRICS, check_rows, choose_path, is_sparse, step_stats, update_centers
from .passlog import PassLog, fingerprint


#: Coordinate differences worth a task of their own.
TASK_WORK = 4_000_000


@dataclass
class KMeansRun:
    centers: list[list[float]]  # C_T
    previous: list[list[float]]  # C_(T-1)
    membership: DataFrame  # (id, cluster_id)
    history: list[dict] = field(default_factory=list)
    n_points: int = 0
    dim: int = 0
    path: str = "expr"
    cached: DataFrame | None = None  # the persisted points, released by ``release()``
    tasks: DataFrame | None = None  # (iteration, task, rows, ...) of every task of every pass, with ``task_report``

    def release(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()
            self.cached = None

    @property
    def n_iter(self) -> int:
        return len(self.history)

    def centers_df(self, spark) -> DataFrame:
        return centers_frame(spark, self.centers)

    def history_df(self, spark) -> DataFrame:
        rows = [(h["iteration"], h["n"], h["changed"], h["delta"], h["elapsed_ms"]) for h in self.history]
        return spark.createDataFrame(rows, "iteration int, n long, changed long, delta double, elapsed_ms long")

    def metrics_df(self, spark) -> DataFrame:
        """What the tasks of each pass did, summed: see ``operators.update.METRICS``."""
        rows = [(h["iteration"], *[h["metrics"].get(m) for m in METRICS]) for h in self.history]
        return spark.createDataFrame(rows, "iteration int, " + ", ".join(f"{m} long" for m in METRICS))


def fit(
    points: DataFrame,
    k: int,
    max_iter: int = 20,
    threshold: float | None = None,
    stop: str = "fixed",
    order_by: str = "id",
    membership: str = "lagged",
    path: str = "auto",
    track_delta: bool | str = "auto",
    init: list[list[float]] | None = None,
    persist: bool = True,
    cache: str = "auto",
    precision: str = "double",
    task_report: bool = False,
    log: str | None = None,
    resume: bool = False,
) -> KMeansRun:
    """Train K-means on ``points(id, features)``; see the module docstring for the rules.

    ``track_delta``: ``"all"`` (or True) computes the change fraction of every
    pass (each pass then evaluates the assignment twice), ``"last"`` only of
    the final pass, ``"none"`` (or False) never; ``"auto"`` is ``"all"``.

    ``precision="float"`` stores coordinates and centres as 32-bit values and
    evaluates distances in 32-bit arithmetic (the single-precision CPU
    formula); sums stay exact and means are rounded to 32 bits.

    ``cache="blocks"`` checks the points once and keeps them as binary matrices in
    executor memory/disk (``operators.blocks``; dense vectors on the Arrow path);
    ``cache="persist"`` keeps the rows as they are. Lost parts are recomputed from
    their short lineage. ``cache="checkpoint"`` writes the rows once to the session's
    checkpoint folder, for inputs that are costly to recompute. ``"auto"`` takes
    blocks where they can be.

    ``log`` names a folder for the log of finished passes; ``resume=True`` continues
    from it if it holds passes of the same settings and input (other ones raise).
    ``task_report=True`` gives the metrics of every single task in ``run.tasks``.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be >= 1")
    if stop not in ("fixed", "threshold"):
        raise ValueError("stop must be 'fixed' or 'threshold'")
    if stop == "threshold" and threshold is None:
        raise ValueError("stop='threshold' needs a threshold")
    if membership not in ("lagged", "final"):
        raise ValueError("membership must be 'lagged' or 'final'")
    if points.isStreaming:
        raise ValueError("training needs a batch DataFrame; use predict() on streams")

    keep = ["id", "features"] + ([order_by] if order_by not in ("id", "features") else [])
    pts = points.select(*keep)
    if precision not in ("double", "float"):
        raise ValueError("precision must be 'double' or 'float'")
    if precision == "float" and not is_sparse(pts):
        # 32-bit coordinates, widened back: sums and the cache keep one layout
        pts = pts.withColumn("features", F.col("features").cast("array<float>").cast("array<double>"))
    if cache not in ("auto", "blocks", "persist", "checkpoint"):
        raise ValueError("cache must be 'auto', 'blocks', 'persist' or 'checkpoint'")
    sparse = is_sparse(pts)
    chosen = choose_path(path, sparse)
    can_block = not sparse and chosen == "arrow" and order_by != "features"
    if cache == "blocks" and not can_block:
        raise ValueError("cache='blocks' needs dense vectors and the Arrow path")
    if cache == "auto":
        cache = "blocks" if can_block else "persist"
    mark = fingerprint(pts, k=k, precision=precision, order_by=order_by, init=init, stop=stop, threshold=threshold) if log else None
    cached, d = None, None
    if persist and points.storageLevel == StorageLevel.NONE:
        # Lloyd passes re-read the points T times: spread them over at least
        # one partition per core before caching (inputs of one split would
        # otherwise run every pass in one task).
        pts = ensure_parallelism(pts)
        if cache == "checkpoint":
            ensure_checkpoint_dir(pts.sparkSession)
            pts = pts.checkpoint(eager=True)
        elif cache == "blocks":
            d = len(init[0]) if init else width_of(pts)
            if d is None:
                raise ValueError("empty input: cannot train on zero points")
            cached = to_blocks(pts, d, order_by, precision).persist(StorageLevel.MEMORY_AND_DISK)
            # fills the cache; passes over few points take no more tasks than they have work for
            rows = cached.agg(F.sum("n")).first()[0] or 0
            tasks = max(1, int(rows * d * k / TASK_WORK))
            pts = cached.coalesce(tasks) if tasks < cached.rdd.getNumPartitions() else cached
        else:
            pts = cached = pts.persist(StorageLevel.MEMORY_AND_DISK)
    # the seeding job is the first scan (it fills the cache); N comes from pass 1
    if init is not None:
        centers = [list(map(float, c)) for c in init]
    elif d is not None:
        seeds = first_of_blocks(pts, k, d)
        if not seeds:
            check_rows(int(pts.agg(F.sum("bad")).first()[0] or 0), d)
            raise ValueError("empty input: cannot seed from zero points")
        centers = seeds + [[0.0] * d for _ in range(k - len(seeds))]
    else:
        centers = seed_first_k(pts, k, order_by)
    centers = round_centers(centers, precision)
    if len(centers) != k:
        raise ValueError("init must hold exactly k centres")
    mode = {True: "all", False: "none"}.get(track_delta, track_delta)
    if mode == "auto":
        mode = "all"
    if mode not in ("all", "last", "none"):
        raise ValueError("track_delta must be 'all', 'last', 'none' or 'auto'")
    if stop == "threshold" and mode != "all":
        raise ValueError("stop='threshold' needs the change fraction of every pass")

    prev = None
    history: list[dict] = []
    n_points = 0
    task_tables: list[DataFrame] = []
    passes = PassLog(points.sparkSession, log, mark) if log else None
    if resume:
        if passes is None:
            raise ValueError("resume needs a log")
        if last := passes.last():
            centers, prev, history = last["centers"], last["previous"], last["history"]
            n_points = history[0]["n"]
    for t in range(len(history) + 1, max_iter + 1):
        if stop == "threshold" and history and not (history[-1]["delta"] > threshold):
            break
        t0 = time.time()
        want = mode == "all" or (mode == "last" and t == max_iter)
        stats = step_stats(pts, centers, prev if want else None, chosen, precision=precision, task_report=task_report)
        if t == 1:
            n_points = int(sum(stats.n))
            if n_points == 0:
                raise ValueError("empty input: cannot train on zero points")
        new = update_centers(centers, stats, precision)
        n_changed = sum(stats.changed) if (want and prev is not None) or t == 1 else None
        delta = (n_changed / n_points) if n_changed is not None else None
        history.append(
            {
                "iteration": t,
                "n": int(sum(stats.n)),
                "changed": n_changed,
                "delta": delta,
                "elapsed_ms": int((time.time() - t0) * 1000),
                "metrics": stats.metrics,
            }
        )
        if stats.tasks is not None:
            task_tables.append(stats.tasks.select(F.lit(t).alias("iteration"), "*"))
        prev, centers = centers, new
        if passes is not None:
            passes.add(t, centers, prev, history)

    member_centers = prev if membership == "lagged" else centers
    if d is not None:
        member = assign_blocks(pts, member_centers, precision)
    elif chosen == "arrow":
        member = predict(pts, member_centers, path="arrow", precision=precision)
    else:
        member = with_nearest(pts, member_centers, precision=precision).select("id", "cluster_id")
    tasks = functools.reduce(DataFrame.union, task_tables) if task_tables else None
    return KMeansRun(centers, prev, member, history, n_points, len(centers[0]), chosen, cached, tasks)
