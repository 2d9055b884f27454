"""Mixing sources to target weights by nested hash-threshold histograms.

Every document has a 60-bit hash. A source whose target is ``r`` whole copies
of itself plus a rest takes every document ``r`` times, and once more those
whose hash lies below the source's threshold. The threshold is the hash at
which the running sum of sizes reaches the rest. It is found without sorting:
sum sizes by (source, 10 bits of hash), find the bucket in which the rest is
reached, sum only that bucket by its next 10 bits, and so on until it holds one
document. Thresholds are nested: a larger target takes a superset.

The hash is that of the id (without an id: of the text). Rows that share it, as repeated
rows do, get hashes of their own from their scan position, so they are taken one by one.

Defined results
* null or empty text: size 0, takes 0 words; a null source is a source of its own (last in order).
* a source of size 0 has target 0; an empty table gives an empty result.
* the document at the threshold is taken if that brings the source nearer to its target.
* rows of one id, and rows without an id of one text, are mixed like any others; reruns over the same files agree.
* a null id is replaced by a hash of the text. Extra columns of the input are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rowindex import with_row_index
from .common import hash60, materialize, table, word_count

_BITS, _LEVELS = 10, 6  # 6 levels of 1024 buckets use up the 60 bits


def source_targets(per_source: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes by weight, capped per source.

    Sources in code-point order, null last, take the weights in turn. The
    level (words per unit of weight) rises until the caps no longer bind: one
    small aggregate over the source rows per round, one row to the driver.
    """
    ordered = with_row_index(per_source.withColumn("_last", F.col("source").isNull().cast("int")), ["_last", "source"], "_pos")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = materialize(
        ordered.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("_pos") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * float(max_repeat)).alias("cap"),
        ),
        "mix-sources",
    )
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        full, rest = s.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (total - full) / rest if rest else level
        if raised <= level:
            break
        level = raised
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _refine(compact: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``repeat`` whole copies and the hash ``threshold`` below which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select(
        "source", "source_size", "target", whole.alias("repeat"), (F.col("target") - whole * F.col("source_size")).alias("rest"),
        # the boundary bucket: hashes lo <= h < hi, `below` words under it, `held` documents of `edge` words in it
        F.lit(0).cast("long").alias("lo"), F.lit(1 << 60).cast("long").alias("hi"), F.lit(0).cast("long").alias("below"),
        F.lit(2).cast("long").alias("held"), F.lit(0).cast("long").alias("edge"),
    )
    for level in range(1, _LEVELS + 1):
        shift = 60 - _BITS * level
        # a few numbers per source: Spark broadcasts them while their size allows
        open_ = state.where("held > 1").select(F.col("source").alias("_s"), "lo", "hi", "below", "rest")
        inside = compact.join(open_, F.col("source").eqNullSafe(F.col("_s"))).where("key >= lo AND key < hi")
        hist = inside.groupBy("_s", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.first("below").alias("_b"), F.first("rest").alias("_rest")
        )
        upto = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        reached = hist.withColumn("cum", F.col("_b") + F.sum("s").over(upto)).where("cum > _rest")
        boundary = reached.groupBy(F.col("_s").alias("_e")).agg(F.min(F.struct("bucket", (F.col("cum") - F.col("s")).alias("below"), "n", "s")).alias("e"))
        found = F.col("e").isNotNull()
        state = state.join(boundary, F.col("source").eqNullSafe(F.col("_e")) & found, "left").select(
            "source", "source_size", "target", "repeat", "rest",
            F.when(found, F.shiftleft("e.bucket", shift)).otherwise(F.col("lo")).alias("lo"),
            # a source that never reaches its rest has size 0: nothing below its threshold
            F.when(found, F.shiftleft(F.col("e.bucket") + 1, shift)).otherwise(F.col("hi")).alias("hi"),
            F.coalesce("e.below", "below").alias("below"),
            F.when(found, F.col("e.n")).when(F.col("held") > 1, F.lit(0)).otherwise(F.col("held")).cast("long").alias("held"),
            F.coalesce("e.s", "edge").alias("edge"),
        )
        state = materialize(state, f"mix-level{level}")
        if state.where("held > 1").isEmpty():
            break
    # the boundary bucket holds one document now (or repeated rows of one): in if that is nearer
    nearer = (F.col("edge") > 0) & (2 * (F.col("rest") - F.col("below")) >= F.col("edge"))
    return state.select("source", "source_size", "target", "repeat", F.when(nearer, F.col("hi")).otherwise(F.col("lo")).alias("threshold"))


def copies(
    docs: DataFrame, size: Column, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, n_copies (and the columns in ``keep``)."""
    key = hash60(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), seed)
    narrow = [F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")]
    compact = materialize(docs.select(*narrow, F.monotonically_increasing_id().alias("at")), "mix-compact")
    shared = materialize(compact.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "mix-shared")
    n_shared = shared.count()
    wide = docs.select(*keep, *narrow, F.lit(0).alias("at")) if keep else compact
    if n_shared:
        if keep:  # stored with their positions, so that both looks at the rows see the same ones
            wide = materialize(docs.select(*keep, *narrow, F.monotonically_increasing_id().alias("at")), "mix-wide")
            compact = _own_keys(wide.select("_id", "source", "size", "key", "at"), shared, n_shared, seed)
            wide = _own_keys(wide, shared, n_shared, seed)
        else:
            wide = compact = materialize(_own_keys(compact, shared, n_shared, seed), "mix-keys")
    per_source = compact.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _refine(compact, source_targets(per_source, weights, share, max_repeat)).withColumnRenamed("source", "_s")
    n_copies = (F.col("repeat") + (F.col("key") < F.col("threshold")).cast("long")).alias("n_copies")
    joined = wide.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    named = [F.col(c) for c in keep] if keep else [F.col("_id").alias(id_col)]
    return joined.select(*named, "size", "source_size", "target", n_copies)


#: Up to this many shared hashes are broadcast; more are joined with salt.
MAX_BROADCAST = 500_000


def _own_keys(rows: DataFrame, shared: DataFrame, n_shared: int, seed: int) -> DataFrame:
    """``rows`` with keys of their own for those whose key is in ``shared``."""
    own = hash60(F.concat_ws("|", "key", "at"), seed)
    if n_shared <= MAX_BROADCAST:
        marked = rows.join(F.broadcast(shared), F.col("key") == F.col("_key"), "left")
    else:
        salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        marked = rows.withColumn("_part", F.pmod("at", F.lit(16)).cast("int")).join(salted, (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_salt")), "left")
    return marked.select(*[F.when(F.col("_key").isNotNull(), own).otherwise(F.col("key")).alias("key") if c == "key" else F.col(c) for c in rows.columns])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with all its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(F.col(options.get("id_col", "doc_id")), F.col(options.get("text_col", "text")), F.col(options.get("source_col", "source")), row)
    counted = copies(packed, word_count(F.col(options.get("text_col", "text"))), keep=("_row",), **options)
    return counted.select(F.explode(F.array_repeat("_row", F.col("n_copies").cast("int"))).alias("_row")).select("_row.*")


def op2_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = copies(docs, word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0|' || doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM o),
r AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
      FROM o WINDOW w AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT r.*, cap * weight_from <= weight * (total - cap_before) AS capped FROM r, t),
l AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) AS level FROM f, t),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight * level) END AS target FROM f, l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rep FROM g),
x AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.rep, h.target - h.rep * h.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS cum
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       (size * (rep + CASE WHEN cum <= rest OR (cum - size <= rest AND 2 * (rest - (cum - size)) >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
