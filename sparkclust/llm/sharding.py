"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; rank r of a
source of n rows gets the fractional rank (r + phase) / n, where the phase (a
hash of the source in [0, 1)) keeps many small sources from falling on one
place. Sorted by fractional rank, every stretch of rows has the mixture of the
whole, so cutting the order into equal stretches gives matching shards. The law
is ``rows``: shard sizes are at most one row apart.

Neither ranking puts a group into one task: rows are numbered inside buckets
(of the hash within a source, of the fractional rank overall) and shifted by
the counts of the buckets before. Equal rows are numbered among themselves (they are
counted, and dealt out again with numbers), so they have hashes of their own and spread as well.

Defined results
* null or empty text: size 16 (0 bytes and 16), text_crc32 0; a null source is a stratum of its own.
* repeated rows (same id, source and text; null ids too) are interchangeable; each has a place of its own.
* fewer rows than shards: one row per shard, the rest of the shards are empty; an empty table gives an empty result.
* equal texts are spread like any other rows: the law ``rows`` does not keep groups together.
* extra columns of the input are carried by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, hash60, materialize, number_equal_rows, rank_in_group, table


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, source, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    compact = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            crc.alias("text_crc32"),
        ),
        "shard-compact",
    )
    compact = materialize(number_equal_rows(compact, "copy"), "shard-numbered")
    name = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), "text_crc32", "copy")
    compact = compact.withColumn("h", hash60(name, seed))
    n = compact.count()
    bits = bucket_bits(n)
    within = compact.withColumn("_b", F.shiftright("h", 60 - bits))
    ranked = rank_in_group(within, ["source"], "_b", ["h", "id", "text_crc32", "size", "copy"], "_r", "_of")
    phase = F.shiftright(hash60(F.coalesce("source", F.lit("")), seed + 1), 7) / float(1 << 53)
    placed = materialize(ranked.withColumn("_f", (F.col("_r") + phase) / F.col("_of")).drop("_b", "_r", "_of"), "shard-ranked")
    spread = placed.withColumn("_b", F.least(F.floor(F.col("_f") * (1 << bits)), F.lit((1 << bits) - 1)).cast("long"))
    ordered = rank_in_group(spread.withColumn("_all", F.lit(0)), ["_all"], "_b", ["_f", "source", "h", "id", "text_crc32", "size", "copy"], "_pos")
    shard = F.expr(f"_pos * {n_shards}L div {max(n, 1)}L")
    return ordered.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), "size", "text_crc32", "source", "shard",
        (F.col("_pos") - F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", **options) -> None:
    """Write the rows of ``docs`` (unique ids) as ``path/shard=<k>/``, ordered by slot inside a file."""
    placed = assign_shards(docs, n_shards, id_col=id_col, **options).select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = docs.join(placed, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartition(n_shards, "_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)


def op8_shards(spark, sf_dir):
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# (crc32 goes through its table of 256 remainders, byte by byte)
SQL = """
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, 3988292384 * (b & 1))) ORDER BY i) AS t
             FROM (SELECT unnest(range(256))::BIGINT AS i)),
b AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, (octet_length(encode(text)) + 16)::BIGINT AS size,
             xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(x, '..'), lambda v: ('0x' || v)::BIGINT),
               lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS text_crc32
      FROM b, tab),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) - 1 AS copy FROM c),
h AS (SELECT *, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32 || '|' || copy), 1, 15))::BIGINT AS h,
             (('0x' || substr(md5('1|' || coalesce(source, '')), 1, 15))::BIGINT >> 7) / 9007199254740992.0::DOUBLE AS phase FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size, copy) - 1 + phase)
             / (count(*) OVER (PARTITION BY source))::DOUBLE AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // n)::INTEGER AS shard,
       (pos - ((pos * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""
