"""Cross-entropy difference of a target and a background n-gram model.

Tokens are characters; three boundary marks stand before every text. The counts of all 4-grams
of the corpus are gathered once, split into target documents and all documents, so both models share
the vocabulary and cover the same 4-grams. Each is an interpolated Witten-Bell model of orders 4 to 1
over a uniform floor, built from the count table with aggregates and joins. A document's losses are
the means of -ln p over its tokens; its score is target loss minus background loss (low: like the target).
A document is scored by models that have counted it: all documents by the background model, target documents by both,
which lowers their target loss by what one text weighs among all target texts.

The counts are summed within stretches of text, then by Spark within each task, then shuffled. Scoring reads
the texts again: with up to ``MAX_BROADCAST`` 4-grams their two log-probabilities are broadcast; beyond that the
(document, 4-gram, count) rows are joined with the model by a shuffle. Both ways give the same sums.

Defined results
* null or empty text: 0 tokens, losses and score null.
* very long texts are counted whole; repeated rows count as often as they occur; a null id is a document like others.
* no target document at all: the target model is uniform over the vocabulary. An empty table gives an empty result.
* a document whose target flag is null isn't a target. Extra columns are kept by ``score_documents`` only if named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .encoding import text_slices

ORDER, MARK = 4, "\x02"
STRETCH = 2_000_000
#: 4-grams whose two log-probabilities (24 bytes with the key) may be broadcast.
MAX_BROADCAST = 4_000_000
#: Label rows (a few bytes each) that may be broadcast to flag the targets.
MAX_LABELS = 2_000_000


def _stretches(texts: list[str]):
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > STRETCH:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the 4-gram that ends at each character, the characters with their marks, and tokens per text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(MARK * (ORDER - 1) + t for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # multilinear hash: code points times fixed odd numbers
    odd = np.random.default_rng(41).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    wide = chars.astype(np.uint64) + np.uint64(1)
    n = max(0, len(chars) - ORDER + 1)
    codes = sum((wide[k : k + n] * odd[k] for k in range(ORDER)), np.zeros(n, np.uint64))
    codes = codes ^ (codes >> np.uint64(29))
    # grams that start inside one text's last three characters run into the next text: leave them out
    total = lens + ORDER - 1
    place = np.arange(n) - np.repeat(np.cumsum(total) - total, total)[:n]
    inside = place < np.repeat(lens, total)[:n]
    return codes[inside], np.flatnonzero(inside), lens


def count_grams(docs: DataFrame, is_target: Column, text_col: str = "text") -> DataFrame:
    """(g, ct, cb): every 4-gram of the corpus with its counts in target documents and in all documents."""

    def run(frames):
        import pyarrow as pa

        for f in text_slices(frames, "text"):
            texts, target = [t or "" for t in f.column("text").to_pylist()], f.column("target").to_numpy(zero_copy_only=False)
            for a, b in _stretches(texts):
                codes, at, lens = gram_codes(texts[a:b])
                group, uniques = pd.factorize(codes)
                first = np.empty(len(uniques), np.int64)
                first[group[::-1]] = at[::-1]
                joined = "".join(MARK * (ORDER - 1) + t for t in texts[a:b])
                flags = np.repeat(target[a:b], lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([joined[k : k + ORDER] for k in first.tolist()], pa.string()), pa.array(np.bincount(group[flags], minlength=len(uniques))), pa.array(np.bincount(group, minlength=len(uniques)))],
                    ["g", "ct", "cb"],
                )

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    return rows.mapInArrow(run, "g string, ct long, cb long").groupBy("g").agg(F.sum("ct").alias("ct"), F.sum("cb").alias("cb"))


def build_model(grams: DataFrame) -> DataFrame:
    """(g, lt, lb): -ln p of the last character of every 4-gram under the target and the background model."""
    level = materialize(grams, "lm-grams")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.substring("g", 2, k).alias("g")).agg(F.sum("ct").alias("ct"), F.sum("cb").alias("cb"))
        levels[k] = level = materialize(level, f"lm-{k}grams")
    vocabulary = max(1, levels[1].count())
    lower = None
    for k in range(1, ORDER + 1):
        context = F.substring("g", 1, k - 1)
        seen = levels[k].withColumn("x", context)
        around = seen.groupBy(F.col("x").alias("_x")).agg(
            F.sum("ct").alias("nt"), F.sum("cb").alias("nb"),
            F.count(F.when(F.col("ct") > 0, 1)).alias("tt"), F.count(F.when(F.col("cb") > 0, 1)).alias("tb"),
        )
        joined = seen.join(around, F.col("x") == F.col("_x"))
        if lower is None:
            joined = joined.withColumn("qt", F.lit(1.0 / vocabulary)).withColumn("qb", F.lit(1.0 / vocabulary))
        else:
            joined = joined.join(lower, F.substring("g", 2, k - 1) == F.col("_g"))

        def interpolated(c: str, n: str, t: str, q: str) -> Column:
            return F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(q)) / (F.col(n) + F.col(t))).otherwise(F.col(q))

        lower = joined.select(F.col("g").alias("_g"), interpolated("ct", "nt", "tt", "qt").alias("qt"), interpolated("cb", "nb", "tb", "qb").alias("qb"))
        lower = materialize(lower, f"lm-p{k}")
    return lower.select(F.col("_g").alias("g"), (-F.log("qt")).alias("lt"), (-F.log("qb")).alias("lb"))


def _coded(model: DataFrame) -> DataFrame:
    """The model keyed by the codes of its 4-grams."""

    def run(frames):
        import pyarrow as pa

        odd = np.random.default_rng(41).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for f in frames:
            chars = np.frombuffer("".join(f.column("g").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
            codes = ((chars.astype(np.uint64) + np.uint64(1)) * odd).sum(1, dtype=np.uint64)
            codes = (codes ^ (codes >> np.uint64(29))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), f.column("lt"), f.column("lb")], ["code", "lt", "lb"])

    return model.mapInArrow(run, "code long, lt double, lb double")


def score_documents(docs: DataFrame, is_target: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id (and ``keep``), n_tokens, loss_target, loss_background, score for every document."""
    spark = docs.sparkSession
    model = materialize(_coded(build_model(count_grams(docs, is_target, text_col))), "lm-model")
    columns = list(dict.fromkeys([id_col, *keep]))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    if model.count() <= MAX_BROADCAST:
        got = model.toPandas().sort_values("code")
        shared = spark.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("code", "lt", "lb")))

        def run(frames):
            import pyarrow as pa

            keys, lt, lb = shared.value
            for f in text_slices(frames, "text"):
                texts = [t or "" for t in f.column("text").to_pylist()]
                n, sums = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)))
                for a, b in _stretches(texts):
                    codes, _, lens = gram_codes(texts[a:b])
                    n[a:b] = lens
                    if not len(codes):
                        continue
                    group, uniques = pd.factorize(codes)
                    at = np.searchsorted(keys, uniques.view(np.int64))
                    full = np.flatnonzero(lens) + a
                    starts = (np.cumsum(lens) - lens)[lens > 0]
                    for k, loss in enumerate((lt, lb)):
                        sums[k, full] = np.add.reduceat(loss[at][group], starts)
                yield pa.RecordBatch.from_arrays([f.column("row"), pa.array(n), pa.array(sums[0]), pa.array(sums[1])], ["row", "n", "st", "sb"])

        summed = packed.mapInArrow(run, packed.select("row").schema.add("n", "long").add("st", "double").add("sb", "double"))
    else:
        numbered = materialize(packed.withColumn("uid", F.monotonically_increasing_id()), "lm-texts")

        def spread(frames):
            import pyarrow as pa

            for f in text_slices(frames, "text"):
                texts, uid = [t or "" for t in f.column("text").to_pylist()], f.column("uid").to_numpy(zero_copy_only=False)
                for a, b in _stretches(texts):
                    codes, _, lens = gram_codes(texts[a:b])
                    rows = pd.DataFrame({"uid": np.repeat(uid[a:b], lens), "code": codes.view(np.int64)}).value_counts().reset_index()
                    yield pa.RecordBatch.from_pandas(rows[["uid", "code", "count"]], preserve_index=False)

        counts = numbered.select("uid", "text").mapInArrow(spread, "uid long, code long, count long")
        sums = counts.join(model, "code").groupBy("uid").agg(
            F.sum("count").alias("n"), F.sum(F.col("count") * F.col("lt")).alias("st"), F.sum(F.col("count") * F.col("lb")).alias("sb")
        )
        summed = numbered.select("uid", "row").join(sums, "uid", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), "st", "sb")
    loss = [F.when(F.col("n") > 0, F.col(c) / F.col("n")) for c in ("st", "sb")]
    out = summed.select("row", F.col("n").alias("n_tokens"), loss[0].alias("loss_target"), loss[1].alias("loss_background"))
    return out.select(*[F.col("row")[c].alias(c) for c in columns], "n_tokens", "loss_target", "loss_background", (F.col("loss_target") - F.col("loss_background")).alias("score"))


def flag_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``target``: a row of ``labels`` gives the document quality 1."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    if good.count() <= MAX_LABELS:  # keeps the texts out of a shuffle
        good = F.broadcast(good)
    return docs.join(good, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))


def op3_xent(spark, sf_dir):
    docs = flag_targets(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = score_documents(docs, F.col("target"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


SQL = """
WITH d AS (SELECT doc_id, string_split(chr(2) || chr(2) || chr(2) || text, '') AS s, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target
           FROM documents WHERE text IS NOT NULL AND text <> ''),
x AS (SELECT doc_id, target, s[i] || s[i + 1] || s[i + 2] || s[i + 3] AS g
      FROM (SELECT doc_id, target, s, unnest(range(1, len(s) - 2)) AS i FROM d)),
pd AS (SELECT doc_id, g, count(*) AS n, any_value(target) AS target FROM x GROUP BY doc_id, g),
g4 AS (SELECT g, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS ct, sum(n)::DOUBLE AS cb FROM pd GROUP BY g),
g3 AS (SELECT substr(g, 2) AS g, sum(ct) AS ct, sum(cb) AS cb FROM g4 GROUP BY 1),
g2 AS (SELECT substr(g, 2) AS g, sum(ct) AS ct, sum(cb) AS cb FROM g3 GROUP BY 1),
g1 AS (SELECT substr(g, 2) AS g, sum(ct) AS ct, sum(cb) AS cb FROM g2 GROUP BY 1),
c4 AS (SELECT *, substr(g, 1, 3) AS c FROM g4), c3 AS (SELECT *, substr(g, 1, 2) AS c FROM g3), c2 AS (SELECT *, substr(g, 1, 1) AS c FROM g2),
n4 AS (SELECT c, sum(ct) AS nt, sum(cb) AS nb, count(*) FILTER (ct > 0) AS tt, count(*) AS tb FROM c4 GROUP BY c),
n3 AS (SELECT c, sum(ct) AS nt, sum(cb) AS nb, count(*) FILTER (ct > 0) AS tt, count(*) AS tb FROM c3 GROUP BY c),
n2 AS (SELECT c, sum(ct) AS nt, sum(cb) AS nb, count(*) FILTER (ct > 0) AS tt, count(*) AS tb FROM c2 GROUP BY c),
n1 AS (SELECT sum(ct) AS nt, sum(cb) AS nb, count(*) FILTER (ct > 0) AS tt, count(*) AS tb, 1.0 / count(*) AS q FROM g1),
p1 AS (SELECT g, CASE WHEN nt > 0 THEN (ct + tt * q) / (nt + tt) ELSE q END AS qt, (cb + tb * q) / (nb + tb) AS qb FROM g1, n1),
p2 AS (SELECT c2.g, CASE WHEN nt > 0 THEN (ct + tt * qt) / (nt + tt) ELSE qt END AS qt, (cb + tb * qb) / (nb + tb) AS qb FROM c2 JOIN n2 USING (c) JOIN p1 ON p1.g = substr(c2.g, 2)),
p3 AS (SELECT c3.g, CASE WHEN nt > 0 THEN (ct + tt * qt) / (nt + tt) ELSE qt END AS qt, (cb + tb * qb) / (nb + tb) AS qb FROM c3 JOIN n3 USING (c) JOIN p2 ON p2.g = substr(c3.g, 2)),
p4 AS (SELECT c4.g, CASE WHEN nt > 0 THEN (ct + tt * qt) / (nt + tt) ELSE qt END AS qt, (cb + tb * qb) / (nb + tb) AS qb FROM c4 JOIN n4 USING (c) JOIN p3 ON p3.g = substr(c4.g, 2)),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_tokens, sum(n * -ln(qt)) / sum(n) AS lt, sum(n * -ln(qb)) / sum(n) AS lb FROM pd JOIN p4 USING (g) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(lt, 6) AS loss_target, round(lb, 6) AS loss_background, round(lt - lb, 6) AS score
FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id
"""
