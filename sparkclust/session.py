"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the scratch folder is a sub-folder of ``spark.checkpoint.dir``
(a shared filesystem named by the cluster); a local default is only set when
the session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sparkclust") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARKCLUST_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if unset (local runs)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        # every executor of a cluster has a disk of its own: only a local run may use one
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sparkclust-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sparkclust-{name}-{uuid.uuid4().hex[:12]}"


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a glob, asked of their file system (no job, no error if there are none)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    return [s.getPath().toString() for s in where.getFileSystem(conf).globStatus(where) or ()]


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(list_paths(spark, path))


@contextmanager
def min_input_splits(spark: SparkSession, minimum: int):
    """Inside, file scans are cut into at least ``minimum`` splits where their format can be cut (text anywhere, Parquet
    between row groups). Large inputs have more splits anyway. The splits are found when a scan runs, so the jobs have to run inside."""
    names = {"spark.sql.files.minPartitionNum": str(minimum), "spark.sql.files.openCostInBytes": "65536"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def ensure_parallelism(df, minimum: int | None = None):
    """Spread a batch DataFrame with fewer partitions than cores (e.g. a one-split file).

    Large inputs already arrive in many splits and pass through unchanged; rows and results are the same.
    Behind a shuffle the partitions are known only after running it, so such a plan passes through as well.
    """
    if df.isStreaming:
        return df
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    want = minimum or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
