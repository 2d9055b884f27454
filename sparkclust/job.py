"""Command-line jobs (``spark-submit -m sparkclust.job <mode> ...`` or ``python -m sparkclust.job``).

Modes::

    train         <points> <out> <k> <threshold> <iterations>   stop when delta <= threshold (or at the cap)
    par_train     <points> <out> <k> <threshold> <iterations>   fixed number of passes (threshold unused)
    par_train_cpu <points> <out> <k> <threshold> <iterations>   same as par_train
    predict       <points> <centres> <out>
    featurize     <json docs> <out>
    label         <json docs> <centres> [<out>]

An optional ``--precision=float`` (training and predict) evaluates distances
in 32-bit arithmetic with 32-bit centres; the default is ``double``.

Training with ``--log=<folder>`` logs every finished pass there; started again with the same
log, input and settings it goes on after the last one. ``--task-report=<folder>`` writes what every
task of every pass did (rows, distances, and the time spent on input, distances and sums) as
JSON lines; the printed report has the totals. ``--store=<folder>`` trains on stored tables (points as blocks,
the membership of every pass, the log): more passes later start from the stored membership.

``--bracketed=true|false`` says whether documents are featurized from their row
string (``[text]``) or the bare text. ``featurize`` (default true) stores the setting beside its
output (``<out>.options``), training copies it beside the model, and ``label`` uses the
model's setting unless the option is given (false for a model without one).

Training writes the centre lines to ``<out>.model`` (``par_*`` modes) or
``<out>.cluster_centres`` (``train``) and ``position cluster_id`` lines to
``<out>.membership``; predict writes ``<out>.membership``. Each output is a
folder of text part files in scan order (every line carries its position); ``--sorted`` sorts
them. ``label`` without an output folder prints every document's line.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession

from .plans.featurize import featurize_text
from .plans.kmeans import fit
from .plans.report import label_documents, label_lines
from .plans.stored import store_training
from .session import ensure_checkpoint_dir, min_input_splits, path_exists
from .sinks.text import feature_lines, membership_lines, read_centers, write_centers, write_lines
from .sources.documents import read_documents
from .sources.points import read_points

TRAIN_MODES = {"train": "threshold", "par_train": "fixed", "par_train_cpu": "fixed"}
USAGE = __doc__


def _centers_fmt(path: str) -> str:
    return "parquet" if path.rstrip("/").endswith(".parquet") else "text"


def write_options(spark: SparkSession, path: str, options: dict) -> None:
    spark.createDataFrame([(json.dumps(options),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".options")


def read_options(spark: SparkSession, path: str) -> dict:
    """The settings stored beside ``path``; none if it has none."""
    where = path.rstrip("/") + ".options"
    if not path_exists(spark, where):
        return {}
    row = spark.read.text(where).first()
    return json.loads(row["value"])


#: Splits that the input of a job is cut into at least.
MIN_SPLITS = 32


def run(spark: SparkSession, argv: list[str]) -> dict:
    with min_input_splits(spark, MIN_SPLITS):
        return _run(spark, argv)


def _run(spark: SparkSession, argv: list[str]) -> dict:
    if not argv:
        raise SystemExit(USAGE)
    mode = argv[0]
    precision, bracketed, order_by, log, task_report, store = "double", None, None, None, None, None
    args = []
    for a in argv[1:]:
        if a.startswith("--precision="):
            precision = a.split("=", 1)[1]
        elif a.startswith("--bracketed="):
            bracketed = {"true": True, "false": False}[a.split("=", 1)[1]]
        elif a.startswith("--log="):
            log = a.split("=", 1)[1]
        elif a.startswith("--store="):
            store = a.split("=", 1)[1]
        elif a.startswith("--task-report="):
            task_report = a.split("=", 1)[1]
        elif a == "--sorted":
            order_by = "id"
        else:
            args.append(a)
    ensure_checkpoint_dir(spark)
    t0 = time.time()
    if mode in TRAIN_MODES:
        if len(args) != 5:
            raise SystemExit(USAGE)
        src, out, k, threshold, iters = args[0], args[1], int(args[2]), float(args[3]), int(args[4])
        parsed = read_points(spark, src)
        t1 = time.time()
        if store is not None:
            result = store_training(parsed.points, store, k, precision=precision).train(iters, threshold if TRAIN_MODES[mode] == "threshold" else None).run()
        else:
            result = fit(
                parsed.points, k, max_iter=iters, threshold=threshold, stop=TRAIN_MODES[mode], precision=precision, log=log, resume=log is not None, task_report=task_report is not None
            )
        t2 = time.time()
        model_suffix = ".cluster_centres" if mode == "train" else ".model"
        write_centers(result.centers_df(spark), out + model_suffix, precision=precision)
        options = read_options(spark, src)
        if options:
            write_options(spark, out + model_suffix, options)
        write_lines(membership_lines(result.membership), out + ".membership", order_by=order_by)
        if result.tasks is not None:
            result.tasks.write.mode("overwrite").json(task_report)
        t3 = time.time()
        counts = parsed.counts()
        work = [h["metrics"] for h in result.history]
        return {
            "mode": mode,
            "lines": counts.get("lines"),
            "rejected": counts.get("rejected"),
            "n": result.n_points,
            "dim": result.dim,
            "iterations": result.n_iter,
            "delta": result.history[-1]["delta"],
            "read_ms": int((t1 - t0) * 1000),
            "train_ms": int((t2 - t1) * 1000),
            "write_ms": int((t3 - t2) * 1000),
            # summed over the tasks of all passes
            "tasks": sum(w["tasks"] for w in work),
            "distances": sum(w["distances"] for w in work),
            "task_read_ms": sum(w["read_ns"] for w in work) // 10**6,
            "task_distance_ms": sum(w["distance_ns"] for w in work) // 10**6,
            "task_sum_ms": sum(w["sum_ns"] for w in work) // 10**6,
        }
    if mode == "predict":
        if len(args) != 3:
            raise SystemExit(USAGE)
        from .operators.assign import predict

        centers = read_centers(spark, args[1], _centers_fmt(args[1]))
        t1 = time.time()
        parsed = read_points(spark, args[0], dim=len(centers[0]))
        assigned = predict(parsed.points, centers, precision=precision)
        t2 = time.time()
        write_lines(membership_lines(assigned), args[2] + ".membership", order_by=order_by)
        t3 = time.time()
        counts = parsed.counts()
        phases = {"model_ms": t1 - t0, "plan_ms": t2 - t1, "assign_write_ms": t3 - t2, "ms": t3 - t0}
        return {"mode": mode, "k": len(centers), "lines": counts.get("lines"), "rejected": counts.get("rejected"), **{p: int(s * 1000) for p, s in phases.items()}}
    if mode == "featurize":
        if len(args) != 2:
            raise SystemExit(USAGE)
        docs = read_documents(spark, args[0])
        # idx = position of the document in the input files
        bracketed = True if bracketed is None else bracketed
        feats = featurize_text(docs, "id", "text", bracketed=bracketed, index_by="file")
        write_lines(feature_lines(feats), args[1], order_by=order_by)
        write_options(spark, args[1], {"bracketed": bracketed})
        return {"mode": mode, "ms": int((time.time() - t0) * 1000)}
    if mode == "label":
        if len(args) not in (2, 3):
            raise SystemExit(USAGE)
        centers = read_centers(spark, args[1], _centers_fmt(args[1]))
        if bracketed is None:
            bracketed = read_options(spark, args[1]).get("bracketed", False)
        lines = label_lines(label_documents(read_documents(spark, args[0]), centers, bracketed=bracketed))
        if len(args) == 3:
            write_lines(lines, args[2], order_by=order_by)
        else:
            # printed partition by partition: the driver holds one at a time
            for row in (lines.orderBy(order_by) if order_by else lines).select("line").toLocalIterator():
                print(row["line"])
        return {"mode": mode, "k": len(centers), "ms": int((time.time() - t0) * 1000)}
    raise SystemExit(f"unknown mode {mode!r}\n{USAGE}")


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("sparkclust").getOrCreate()
    report = run(spark, list(sys.argv[1:] if argv is None else argv))
    print(json.dumps(report))


if __name__ == "__main__":
    main()
