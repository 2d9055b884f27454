"""First-K seeding with zero padding."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_k_rows(points: DataFrame, k: int, order_by: str = "id") -> list[list[float]]:
    """Features of the first ``min(N, K)`` points in ``order_by`` order.

    The K keys are found on the key column alone, then only those K wide rows
    are fetched (see ``take_first``).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    from .limit import take_first
    from .update import dense_row

    rows = take_first(points.select(order_by, "features") if order_by != "features" else points, k, order_by)
    return [dense_row(r["features"]) for r in rows]


def seed_first_k(points: DataFrame, k: int, order_by: str = "id", dim: int | None = None) -> list[list[float]]:
    """Initial centres C_0: the first K objects, zero vectors appended when N < K."""
    seeds = first_k_rows(points, k, order_by)
    if not seeds:
        raise ValueError("empty input: cannot seed from zero points")
    d = dim if dim is not None else len(seeds[0])
    for row in seeds:
        if len(row) != d:
            raise ValueError("seed rows have different widths")
    return seeds + [[0.0] * d for _ in range(k - len(seeds))]


def centers_frame(spark, centers: list[list[float]]) -> DataFrame:
    """K x d centres as ``(cluster_id INT, center ARRAY<DOUBLE>)`` (K-sized, driver-built)."""
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster_id int, center array<double>")
