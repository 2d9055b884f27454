"""Connected components of an edge list, as alternating star contractions.

Each round points every node to the smallest node it has met; rounds repeat until nothing
changes (about the logarithm of a component's diameter). The smallest neighbour is a
partial aggregate, and the edges of a node are salted before they are joined with it (in both
halves of a round), so a node with very many edges costs no single task more than its share.
The salted nodes are never broadcast: the driver would hold SALTS rows of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled

SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m`` of their ``u`` from ``least`` (_u, m): its row is dealt out to SALTS parts of the edges."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(shuffled(least.select("_u", "m", salts)), (F.col("u") == F.col("_u")) & (F.col("salt") == F.col("_salt")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the component's smallest node."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "cc-edges")
    while True:
        # large star: neighbours above a node go to the smallest node around it
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("_u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = _with_least(large, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "cc-round")
        # done when the pairs are stars already: every node has one, and no centre has any
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).union(after.select("v", F.lit(0)))
        seen = ends.groupBy("node").agg(F.sum("leaf").alias("pairs"), F.min("leaf").alias("least"))
        if seen.where("pairs > 1 OR (pairs = 1 AND least = 0)").isEmpty():
            break
        pairs = after
    centres = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("label")).union(centres)
