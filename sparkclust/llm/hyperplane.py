"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine verification, connected components.

Equal vectors are one class from the start, so copies never become pairs. Every
class is put into one bucket of each table, by the signs of its products with
``bits`` random hyperplanes. Two vectors of cosine c share a bucket with
probability (1 - acos(c) / pi) ** bits; ``plan_tables`` takes as many bits as keep
an average bucket at ``rows_per_bucket`` and as many tables as leave a pair at
the threshold unfound with probability ``miss`` at most (nearer pairs: less).

A bucket is compared as matrix products in doubles. One of more than ``BLOCK``
classes is dealt into blocks and every pair of blocks is a group of its own, so
no task holds a hot bucket. Pairs aren't emitted: a group gives each class the
number of vectors linked to it, counting a pair only in the first table that the
two share, and its smallest class in the group's link graph. These are the edges
of the connected components.

Defined results
* vectors that are null, empty, zero or hold null or non-finite components: no links, a component of their own.
* vectors of different widths never link. Components of any finite size are compared (rows are scaled by powers of two).
* repeated rows are vectors of their own (linked by cosine 1); rows of one vec_id may lie in different components.
* a null vec_id counts as the largest id; a component of null ids only has the component id null.
* an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import is_finite_vector
from .common import materialize, stream_groups, table
from .components import components

#: Classes of a bucket that are compared at once; larger buckets are dealt into blocks.
BLOCK = 2000
#: Buckets of more than BLOCK classes that may be broadcast (four numbers each); beyond it a salted join.
MAX_BROADCAST_BUCKETS = 500_000
#: A class of a thousandth of all rows or more is broadcast for the way back: there are a thousand at most.
HOT_SHARE = 1000
_NO_ID = (1 << 63) - 1


def plan_tables(n: int, min_cosine: float, rows_per_bucket: int = 1000, miss: float = 1e-3) -> tuple[int, int]:
    """(bits, tables) for ``n`` classes."""
    same = 1 - math.acos(min_cosine) / math.pi
    bits = max(4, math.ceil(math.log2(max(1, n) / rows_per_bucket)))
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


def hyperplanes(width: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, bits * tables))


def _matrix(column) -> np.ndarray:
    """Rows of equal width as doubles, scaled by powers of two to a largest component in [0.5, 1)."""
    X = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(X, -np.frexp(np.abs(X).max(1))[1][:, None])


def _signer(bits: int, tables: int, seed: int):
    """Arrow batches (u, id, n, width, vec) -> the same with ``sig``, the bucket in each table."""
    import pyarrow as pa

    powers = 1 << np.arange(bits)

    def fn(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                H = planes.setdefault(width, hyperplanes(width, bits, tables, seed))
                for part in np.array_split(at, -(-len(at) // 2048)):
                    rows = batch.take(pa.array(part))
                    signs = (_matrix(rows.column("vec")) @ H >= 0).reshape(len(part), tables, bits)
                    sig = (signs * powers).sum(2).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, tables, dtype=np.int32)), pa.array(sig.ravel()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "sig"])

    return fn


def _roots(hit: np.ndarray) -> np.ndarray:
    """Smallest index connected to each vertex of a symmetric link matrix (each row is looked at once)."""
    root = np.arange(len(hit))
    seen = ~hit.any(1)
    for start in range(len(hit)):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):
            root[front] = start
            front = np.flatnonzero(hit[front].any(0) & ~seen)
            seen[front] = True
    return root


def _compare(min_cosine: float):
    """Groups of one pair of blocks -> (u, id, links, root_u, root_id) of every linked class."""
    import pyarrow as pa

    def fn(batches):
        for (_, tab, _, lo, hi), rows in stream_groups(batches, ["width", "tab", "bucket", "lo", "hi"]):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks().sort_by([("id", "ascending"), ("u", "ascending")])
            cols = {c: rows.column(c).to_numpy() for c in ("u", "id", "n", "own")}
            sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            a, b = np.flatnonzero(cols["own"] == lo), np.flatnonzero(cols["own"] == hi)
            new = np.triu(np.ones((len(a), len(a)), bool), 1) if lo == hi else np.ones((len(a), len(b)), bool)
            for t in range(tab):  # a pair counts in the first table that it shares
                new &= sig[a, t][:, None] != sig[b, t]
                if not new.any():
                    break
            if not new.any():
                continue
            X = _matrix(rows.column("vec").combine_chunks())
            norm = np.sqrt((X * X).sum(1))
            hit = new & (X[a] @ X[b].T >= min_cosine * (norm[a][:, None] * norm[b]))
            if not hit.any():
                continue
            n = cols["n"].astype(np.float64)  # counts far below 2 ** 53
            links = np.zeros(rows.num_rows)
            links[a] += hit @ n[b]
            links[b] += n[a] @ hit
            full = np.zeros((rows.num_rows, rows.num_rows), bool)
            full[np.ix_(a, b)] |= hit
            full |= full.T
            root, at = _roots(full), np.flatnonzero(links)
            r = root[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (cols["u"][at], cols["id"][at], links[at].astype(np.int64), cols["u"][r], cols["id"][r])],
                names=["u", "id", "links", "root_u", "root_id"],
            )

    return fn


def _dealt(signed: DataFrame) -> DataFrame:
    """A row per class, table and pair of blocks it takes part in."""
    keys = ["width", "tab", "bucket"]
    spread = signed.select("u", F.explode(F.transform("sig", lambda s, t: F.struct(t.alias("tab"), s.alias("bucket")))).alias("x"), "width")
    sizes = spread.groupBy("width", "x.tab", "x.bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    large = materialize(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hyper-large")
    rows = signed.select("*", F.posexplode("sig").alias("tab", "bucket"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    if large.count() <= MAX_BROADCAST_BUCKETS:
        rows = rows.join(F.broadcast(large), on, "left")
    else:
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(16)).cast("int")).join(salted, [*on, F.col("salt") == F.col("_salt")], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("u", F.lit(7)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("u", "id", "n", "vec", "sig", *keys, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def near_duplicates(
    vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, rows_per_bucket: int = 1000, miss: float = 1e-3
) -> DataFrame:
    """id, n_links, component_id, kept for every row of ``vectors``."""
    x = F.col("vec")
    usable = F.coalesce((F.size(x) > 0) & is_finite_vector(x) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vid"), F.col(f"`{vec_col}`").alias("vec")).withColumn("usable", usable)
    keyed = rows.where("usable").select("vid", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(seed + 1), "vec").alias("h2"))
    classes = materialize(
        keyed.groupBy("h1", "h2")
        .agg(F.coalesce(F.min("vid"), F.lit(_NO_ID)).alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
        .select(F.monotonically_increasing_id().alias("u"), "id", "n", F.size("vec").alias("width"), "vec", "h1", "h2"),
        "hyper-classes",
    )
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits, tables = plan_tables(n_classes, min_cosine, rows_per_bucket, miss)
    kind = dict(classes.dtypes)["vec"]
    signed = materialize(
        classes.select("u", "id", "n", "width", "vec").mapInArrow(_signer(bits, tables, seed), f"u long, id long, n long, width int, vec {kind}, sig array<int>"),
        "hyper-signed",
    )
    group = ["width", "tab", "bucket", "lo", "hi"]
    dealt = _dealt(signed).repartition(*group).sortWithinPartitions(*group)
    found = materialize(dealt.mapInArrow(_compare(min_cosine), "u long, id long, links long, root_u long, root_id long"), "hyper-links")
    links = found.groupBy(F.col("u").alias("_u")).agg(F.sum("links").alias("links"))
    # nodes in order of id, so the smallest node of a component has its smallest id
    edges = found.where("u <> root_u").select(F.struct("id", "u").alias("a"), F.struct(F.col("root_id").alias("id"), F.col("root_u").alias("u")).alias("b"))
    labels = components(edges).select(F.col("node.u").alias("_v"), F.col("label.id").alias("component"))
    result = materialize(
        classes.join(links, F.col("u") == F.col("_u"), "left").join(labels, F.col("u") == F.col("_v"), "left").select(
            F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "hyper-result",
    )
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    hot = F.broadcast(result.where(F.col("n") * HOT_SHARE >= n_rows))
    members = keyed.select("vid", "h1", "h2")
    linked = members.join(hot, same).union(members.join(hot, same, "left_anti").join(result.where(F.col("n") * HOT_SHARE < n_rows), same))
    component = F.nullif(F.col("component"), F.lit(_NO_ID)).alias("component_id")
    out = linked.select("vid", F.col("n_links").cast("long").alias("n_links"), component).union(
        rows.where(~F.col("usable")).select("vid", F.lit(0).cast("long"), F.col("vid").cast("long"))
    )
    return out.select(F.col("vid").alias(id_col), "n_links", "component_id", F.col("vid").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_hyperplanes(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
c AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.reach = l.a),
m AS (SELECT vec_id, min(reach) AS component_id FROM c GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM m LEFT JOIN k ON m.vec_id = k.a
"""
