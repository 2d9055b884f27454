"""Exact top-k inner products by a Voronoi join.

Components become integers (floor(scale * x)), so scores are exact. Pivots are drawn
from a bounded hash sample; every vector, query or candidate, belongs to the group of
its nearest pivot. One small summary per group (pivot, radius, count, the smallest
distances to the pivot) is enough for bounds: a candidate x of group p and a query q obey
    |q.x - q.p| <= |q| * |x - p|  (Cauchy-Schwarz)
so the k-th largest of q.p - |q| * d over the summaries' distances d is a floor for the
query's k-th score, and q.p + |q| * radius a ceiling for all of a group. A query goes only
to groups whose ceiling reaches its floor. Large groups are cut into chunks of bounded
size; the queries a chunk needs are compared with it in blocks, and each task keeps k per
query before the final merge of k rows per query and chunk. The small side (the queries)
is what gets replicated; candidates are shuffled once.

Defined results
* vectors that are null, empty, or hold null or non-finite components take no part.
* scores beyond 64 bits are the largest or smallest LONG; components count as 2**100 / scale at most.
* vectors of different widths have no score; each width is joined on its own.
* ties in the score go to the smaller id; rows with the query's own id are never its candidates.
* repeated rows (one id, equal vectors) count as rows of their own; a null id takes no part.
* fewer candidates than k: all of them; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK_ROWS = 2048
_EXACT = 2.0**52  # sums of products below this are exact in float64


def quantize(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, q, v array<double> of whole numbers, width) of the vectors that take part."""
    def whole(x: Column) -> Column:
        x = F.greatest(F.lit(-(2.0**100)), F.least(F.lit(2.0**100), x.cast("double") * scale))
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # such doubles are whole

    v = F.transform(F.col(vector_col), whole)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(finite, F.lit(False)))
    return good.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), v.alias("v"), F.size(vector_col).alias("width")
    )


def _matrix(column, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width)


def pick_pivots(data: DataFrame, most: int, seed: int) -> dict[int, np.ndarray]:
    """Per width up to ``most`` pivots (about the square root of the rows), the vectors of lowest hash."""
    key = F.xxhash64(F.lit(seed), F.to_json("v"))
    sizes = {r["width"]: r["n"] for r in data.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for width, n in sizes.items():
        want = int(min(most, max(1, round(n**0.5 / 2))))
        step = max(1, n // (want * 4))
        some = data.where((F.col("width") == width) & (F.pmod(key, F.lit(step)) == 0)).select("v").distinct()
        rows = some.orderBy(F.xxhash64(F.lit(seed), F.to_json("v")), F.to_json("v")).limit(want).collect()
        rows = rows or data.where(F.col("width") == width).select("v").limit(1).collect()
        pivots[width] = np.array([r["v"] for r in rows], np.float64)
    return pivots


def assign_groups(data: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``grp`` (nearest pivot) and ``dist`` (to it) to (id, v, width)."""
    shared = data.sparkSession.sparkContext.broadcast(pivots)  # bounded: `most` pivots a width

    def run(frames):
        import pyarrow as pa

        for f in frames:
            widths = f.column("width").to_numpy(zero_copy_only=False)
            grp, dist = np.zeros(len(widths), np.int32), np.zeros(len(widths))
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                x, p = _matrix(f.column("v").take(pa.array(at)), w), shared.value[w]
                for a in range(0, len(at), 4096):
                    y = x[a : a + 4096]
                    g = (((p * p).sum(1) - 2 * (y @ p.T))).argmin(1)
                    grp[at[a : a + 4096]] = g
                    dist[at[a : a + 4096]] = np.sqrt(((y - p[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(grp), pa.array(dist)], [*f.schema.names, "grp", "dist"])

    return data.mapInArrow(run, "id long, q boolean, v array<double>, width int, row long, grp int, dist double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
          most_pivots: int = 256, chunk_rows: int = CHUNK_ROWS, seed: int = 0) -> DataFrame:
    """query_id, rank, id, score: the ``k`` highest inner products of every query row."""
    spark = vectors.sparkSession
    data = materialize(quantize(vectors, is_query, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "knn-data")
    pivots = pick_pivots(data, most_pivots, seed)
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    grouped = materialize(assign_groups(data, pivots), "knn-grouped")

    # summaries: a row per group, at most `most_pivots` a width; the smallest distances of k + 1 ids (the query's own may be among them)
    near = Window.partitionBy("width", "grp").orderBy("dist", "id")
    by_id = grouped.groupBy("width", "grp", "id").agg(F.min("dist").alias("dist"))
    closest = by_id.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lows = {(r["width"], r["grp"]): sorted(map(tuple, r["d"])) for r in closest.groupBy("width", "grp").agg(F.collect_list(F.struct("dist", "id")).alias("d")).collect()}
    stats = {
        (r["width"], r["grp"]): (r["radius"], r["n"])
        for r in grouped.groupBy("width", "grp").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    }
    summary = {}
    for width, p in pivots.items():
        radius, chunks = np.full(len(p), -1.0), np.ones(len(p), np.int64)
        near_grp, low, owner = [], [], []
        for g in range(len(p)):
            if (width, g) in stats:
                radius[g], n = stats[width, g]
                chunks[g] = -(-n // chunk_rows)
                for d, i in lows[width, g]:
                    near_grp.append(g)
                    low.append(d)
                    owner.append(i)
        summary[width] = (p, radius, chunks, np.array(near_grp, np.int64), np.array(low), np.array(owner, np.int64))
    shared = spark.sparkContext.broadcast(summary)

    def chunk_of(rows, grp, chunks):
        mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % chunks[grp].astype(np.uint64)).astype(np.int64)

    def route(frames):
        """Candidates go to their chunk; queries to every chunk of the groups they need."""
        import pyarrow as pa

        for f in frames:
            widths = f.column("width").to_numpy(zero_copy_only=False)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                part = f.take(pa.array(at))
                p, radius, chunks, near_grp, low, owner = shared.value[w]
                ids, grp, number = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "grp", "row"))
                x = _matrix(part.column("v"), w)
                out = [(np.arange(len(ids)), grp.astype(np.int64), chunk_of(number, grp, chunks), np.zeros(len(ids), bool))]
                q = np.flatnonzero(part.column("q").to_numpy(zero_copy_only=False))
                for a in range(0, len(q), 512):
                    rows = q[a : a + 512]
                    dot, norm = x[rows] @ p.T, np.sqrt((x[rows] ** 2).sum(1, keepdims=True))
                    slack = 1e-9 * (np.abs(dot).max() + norm.max() * max(radius.max(), 0) + 1)
                    # the k-th best of what is certain, rows of the query's own id aside
                    sure = np.where(owner == ids[rows][:, None], -np.inf, dot[:, near_grp] - norm * low)
                    floor = np.partition(sure, -k, axis=1)[:, -k] if sure.shape[1] >= k else np.full(len(rows), -np.inf)
                    need = (dot + norm * radius >= floor[:, None] - slack) & (radius >= 0)
                    r, g = np.nonzero(need)
                    n = chunks[g]
                    first = np.cumsum(n) - n
                    out.append((np.repeat(rows[r], n), np.repeat(g, n), np.arange(int(n.sum())) - np.repeat(first, n), np.ones(int(n.sum()), bool)))
                for row, g, c, is_q in out:
                    for a in range(0, len(row), 20_000):
                        s = slice(a, a + 20_000)
                        sub = part.take(pa.array(row[s]))
                        yield pa.RecordBatch.from_arrays(
                            [sub.column("row"), sub.column("id"), sub.column("v"), sub.column("width"), pa.array(g[s], pa.int64()), pa.array(c[s], pa.int64()), pa.array(is_q[s])],
                            ["row", "id", "v", "width", "grp", "chunk", "is_q"],
                        )

    routed = grouped.mapInArrow(route, "row long, id long, v array<double>, width int, grp long, chunk long, is_q boolean")
    # a chunk's candidates come first, then its queries stream by: memory holds one chunk and one batch
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = routed.repartition(n, "width", "grp", "chunk").sortWithinPartitions("width", "grp", "chunk", "is_q", "id")

    def solve(frames):
        import pyarrow as pa

        key, ids, xs = None, [], []
        for f in frames:
            cols = [f.column(c).to_numpy(zero_copy_only=False) for c in ("width", "grp", "chunk", "is_q")]
            change = np.any([c[1:] != c[:-1] for c in cols], axis=0) if len(f) > 1 else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), f.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, now = f.slice(a, b - a), tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    key, ids, xs = now, [], []
                part_ids = part.column("id").to_numpy(zero_copy_only=False)
                x = _matrix(part.column("v"), key[0])
                if not cols[3][a]:
                    ids.append(part_ids)
                    xs.append(x)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
                cand, y = ids[0], xs[0]
                rows = part.column("row").to_numpy(zero_copy_only=False)
                longest = np.sqrt((y * y).sum(1).max())
                for q0 in range(0, len(x), 256):
                    q = x[q0 : q0 + 256]
                    if np.sqrt((q * q).sum(1).max()) * longest < _EXACT:
                        scores = q @ y.T
                    else:  # whole numbers of any size
                        scores = np.array([[int(u) for u in r] for r in q], object) @ np.array([[int(u) for u in r] for r in y], object).T
                        scores = np.minimum(np.maximum(scores, -(2**63)), 2**63 - 1)
                    out = ([], [], [], [])
                    for i, s in enumerate(scores):
                        other = cand != part_ids[q0 + i]
                        c, s = cand[other], s[other]
                        if len(s) > k:
                            keep = np.flatnonzero(s >= np.partition(s, -k)[-k])
                            c, s = c[keep], s[keep]
                        best = np.lexsort((c, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], c[j]))[:k], int)
                        out[0].extend([int(rows[q0 + i])] * len(best))
                        out[1].extend([int(part_ids[q0 + i])] * len(best))
                        out[2].extend(c[best].tolist())
                        out[3].extend(int(v) for v in s[best])
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["row", "query_id", "id", "score"])

    found = dealt.mapInArrow(solve, "row long, query_id long, id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op7_voronoi(spark, sf_dir):
    out = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
