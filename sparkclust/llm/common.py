"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value of the query contracts: a word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals out both sides by key, whatever size Spark expects of ``df``.

    A small estimate is no bound on what the driver would have to hold: a number in a file or a shuffle takes a few bytes,
    a broadcast row about 100 to 200, and rows made by ``explode`` are not in the estimate at all.
    """
    return df.hint("merge")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(value: Column, seed: int = 0) -> Column:
    """A 60-bit number, uniform over distinct values: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), value.cast("string"))), 1, 15), 16, 10).cast("long")


def bucket_bits(n_rows: int, rows_per_bucket: int = 20_000, least: int = 6) -> int:
    """Bits of a uniform hash that cut ``n_rows`` into buckets of about ``rows_per_bucket``."""
    return max(least, math.ceil(math.log2(max(1, n_rows / rows_per_bucket))))


def rank_in_group(df: DataFrame, groups: list[str], bucket: str, order: list[str], rank: str, total: str | None = None) -> DataFrame:
    """0-based ``rank`` of each row of its group, in order of (``bucket``, ``order``).

    ``bucket`` must be ascending in the wanted order. Rows are numbered inside
    (group, bucket) and shifted by the counts of the group's earlier buckets, so
    a group of any size spreads over its buckets. ``df`` is read twice and has to
    give the same rows both times. ``total`` names a column for the group's size.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.withColumn("_rn", local).join(offsets, on)
    out = joined.withColumn(rank, (F.col("_off") + F.col("_rn") - 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_rn", "_off", "_total", *[f"_k{i}" for i in range(len(keys))])


#: Equal rows that one task deals out.
COPIES = 20_000


def number_equal_rows(df: DataFrame, out: str) -> DataFrame:
    """The rows of ``df`` with ``out``, a number from 0 among rows that are equal in all columns.

    Equal rows are counted (in part before the shuffle) and dealt out again, many of them by several tasks.
    """
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= COPIES).withColumn("_first", F.lit(0).cast("long"))
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long")))
    many = counted.where(F.col("_n") > COPIES).withColumn("_first", firsts).repartition(*[F.col(f"`{c}`") for c in df.columns], "_first")
    numbers = F.explode(F.sequence(F.col("_first"), F.least(F.col("_n"), F.col("_first") + COPIES) - 1))
    return few.unionByName(many).withColumn(out, numbers).drop("_n", "_first")


def stream_groups(frames, keys: list[str]):
    """Groups of equal adjacent ``keys`` in a stream of Arrow batches: (key tuple, table), one group in memory."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for f in frames:
        if not f.num_rows:
            continue
        cols = [f.column(c).to_numpy(zero_copy_only=False) for c in keys]
        change = np.zeros(f.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), f.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a].item() for c in cols)
            if now != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key = [], now
            held.append(f.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
