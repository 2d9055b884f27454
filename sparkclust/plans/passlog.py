"""A durable log of training passes: one small JSON file per finished pass in shared storage.

A pass counts once its folder is complete (Spark's commit marks it), so a run that is stopped
at any time leaves a log that ends with a finished pass. Numbers are written so that
reading them gives the same doubles.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import list_paths


def fingerprint(points: DataFrame, **settings) -> dict:
    """Settings, and number and hash sum of the points (in any order, however partitioned)."""
    h = F.xxhash64("id", F.to_json(F.struct("features")) if points.schema["features"].dataType.typeName() == "struct" else F.col("features"))
    row = points.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash")).first()
    return {**settings, "rows": row["rows"], "hash": row["hash"]}


class PassLog:
    def __init__(self, spark: SparkSession, path: str, mark: dict):
        self.spark, self.path, self.mark = spark, path.rstrip("/"), json.loads(json.dumps(mark))

    def add(self, t: int, centers, previous, history: list[dict]) -> None:
        entry = json.dumps({"pass": t, "mark": self.mark, "centers": centers, "previous": previous, "history": history})
        # the entries of a run are K x d numbers each: one row, one file
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/pass-{t:06d}")

    def last(self) -> dict | None:
        """The last finished pass; None if there is none. Raises if it belongs to other settings or other points."""
        done = list_paths(self.spark, f"{self.path}/pass-*/_SUCCESS")
        if not done:
            return None
        latest = max(p.rsplit("/", 2)[1] for p in done)
        entry = json.loads(self.spark.read.text(f"{self.path}/{latest}").first()["value"])
        if entry["mark"] != self.mark:
            odd = sorted(k for k in self.mark if self.mark[k] != entry["mark"].get(k))
            raise ValueError(f"the log in {self.path} belongs to a run with other {', '.join(odd)}")
        return entry
