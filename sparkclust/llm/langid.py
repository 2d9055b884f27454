"""Language identification by hierarchical discrimination.

A text becomes a histogram of hashed byte n-grams (1 to 3 bytes of its lower-cased
letters and the blanks between them), square-rooted and brought to length 1. Linear
classifiers decide in two steps: one-versus-rest support vector machines choose the
language family, then one-versus-one machines vote among the languages of that family.
The families come from ``FAMILIES``; a language missing there is a family of its own.

Training uses at most ``per_language`` labelled texts of each language, those of lowest
hash, however many languages there are, and at most ``FAMILY_ROWS`` of all of them (as many of
each) for the family machines. The machines are trained by Spark tasks, ``MACHINES`` family
machines or the pairs of one family by each; a task holds its histograms as 16-bit floats (8 KB a
text), and only the weights (dim numbers a machine) reach the driver and the workers. Prediction
reads every text whole and uses nothing but the text.

Defined results
* null text or text without a letter: ``und``, score 0.
* very long texts are read whole, in slices of ``_SLICE`` bytes; equal texts get equal answers.
* a null id is not held out: such rows are learned from, in the query and in the pipeline.
* ties go to the first language (family) in code-point order; an empty table gives an empty result.
* with no labelled text at all every document is ``und`` with score 0; with one language all lettered texts get it.
* extra columns are kept by ``predict``; the new columns are ``lang_pred`` and ``score``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .encoding import text_slices

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy gd br".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn ur mr ne gu pa".split(),
    "semitic": "ar he mt am".split(),
}
DIM = 4096
_SLICE = 1 << 18
#: Bytes of text and rows whose histograms are made at once.
_TEXTS, _ROWS = 500_000, 64
#: Family machines trained by one task.
MACHINES = 16
#: Training texts that the family machines share, whatever the number of languages.
FAMILY_ROWS = 24_000
#: Up to this many languages with more texts than wanted are marked by a broadcast; more by a shuffle join.
MAX_BROADCAST = 200_000

_FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
# ASCII bytes that are no letters become a blank
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def histogram(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Rows of hashed 1- to 3-byte n-gram counts, square-rooted, of length 1."""
    out = np.zeros((len(texts), dim), np.float32)
    for first in range(0, len(texts), _ROWS):
        group = texts[first : first + _ROWS]
        counts = np.zeros(len(group) * dim, np.int32)
        pending, held = [], 0

        def flush():
            nonlocal pending, held
            if not pending:
                return
            b = np.concatenate([x for _, x in pending]).astype(np.uint32)
            row = np.repeat(np.array([r * dim for r, _ in pending], np.int32), [len(x) for _, x in pending])
            keep = b[1:] + b[:-1] != 64  # runs of blanks count once
            g2 = (b[:-1] << 8) | b[1:]
            g3 = (g2[:-1] << 8) | b[2:]
            for gram, r, ok in ((b, row, None), (g2, row[1:], keep), (g3, row[2:], keep[:-1] & keep[1:])):
                bucket = ((gram + np.uint32(1)) * np.uint32(2654435761)) >> np.uint32(32 - dim.bit_length() + 1)
                at = bucket.view(np.int32) + r
                counts[:] += np.bincount(at if ok is None else at[ok], minlength=len(counts)).astype(np.int32)
            pending, held = [], 0

        for r, t in enumerate(group):
            raw = np.frombuffer(b" " + t.lower().encode("utf-8", "ignore").translate(_BLANK) + b" ", np.uint8)
            for a in range(0, len(raw), _SLICE):
                pending.append((r, raw[max(0, a - 2) if a else 0 : a + _SLICE]))
                held += len(pending[-1][1])
                if held >= _SLICE:
                    flush()
        flush()
        x = np.sqrt(counts.reshape(len(group), dim).astype(np.float32))
        x[:, ((32 + 1) * 2654435761 % 2**32) >> (32 - dim.bit_length() + 1)] = 0  # the lone blank
        out[first : first + len(group)] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return out


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by averaged stochastic subgradient descent.

    ``y`` is +1 or -1 for each of ``rows``, the rows of ``x`` to learn from.
    Each class carries half of the loss, whatever its number of rows.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    lam, step, batch = 1.0 / (c * n), 0, 32
    w, b = np.zeros(x.shape[1]), 0.0
    w_sum, b_sum, averaged = np.zeros_like(w), 0.0, 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // batch)):
            step += 1
            rate = 1.0 / (1.0 + lam * step * 50)
            some = x[rows[at]].astype(np.float32)
            inside = y[at] * (some @ w + b) < 1
            g = (weight[at] * y[at])[inside] / len(at)
            w = (1 - rate * lam) * w + rate * (g @ some[inside])
            b += 0.1 * rate * g.sum()
            if epoch >= epochs // 2:
                w_sum += w
                b_sum += b
                averaged += 1
    return w_sum / averaged, b_sum / averaged


class Model:
    """families: one-versus-rest weights; pairs: one-versus-one weights inside each family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({_FAMILY_OF.get(v, v) for v in self.langs})
        members: dict[str, list[str]] = {f: [] for f in self.families}
        for v in self.langs:
            members[_FAMILY_OF.get(v, v)].append(v)
        self.members = [members[f] for f in self.families]
        self.pairs = [(a, b) for m in self.members for i, a in enumerate(m) for b in m[i + 1 :]]

    def fit(self, rows: DataFrame, dim: int) -> "Model":
        """Train all machines on ``rows`` (lang, h, r: place in its language, x: float16 histogram as bytes) in Spark tasks."""
        spark, n_fam = rows.sparkSession, len(self.families) if len(self.families) > 1 else 0
        # blocks of (column, positive, negative); family machines have no negative and need all rows
        blocks = [[(k, self.families[k], None) for k in range(a, min(a + MACHINES, n_fam))] for a in range(0, n_fam, MACHINES)]
        n_all, needs = len(blocks), []
        column = {p: n_fam + k for k, p in enumerate(self.pairs)}
        for m in self.members:
            if len(m) > 1:
                needs += [(v, len(blocks)) for v in m]
                blocks.append([(column[a, b], a, b) for i, a in enumerate(m) for b in m[i + 1 :]])
        self.w, self.b = np.zeros((dim, n_fam + len(self.pairs)), np.float32), np.zeros(n_fam + len(self.pairs), np.float32)
        if not blocks:
            return self
        shared_rows = rows.where(F.col("r") <= max(1, FAMILY_ROWS // len(self.langs)))
        everywhere = shared_rows.crossJoin(F.broadcast(spark.range(n_all).select(F.col("id").cast("int").alias("block"))))
        inside = rows.join(F.broadcast(spark.createDataFrame(needs, "_lang string, block int")), F.col("lang") == F.col("_lang")).drop("_lang")
        dealt = everywhere.union(inside).repartition(len(blocks), "block").sortWithinPartitions("block", "lang", "h")
        shared = spark.sparkContext.broadcast(blocks)

        def solve(frames):
            import pyarrow as pa

            def train(block, langs, rows):
                x = np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), dim)
                lang = np.array(langs, object)
                fam = np.array([_FAMILY_OF.get(v, v) for v in langs], object)
                done = []
                for k, a, b in shared.value[block]:
                    at = np.arange(len(rows)) if b is None else np.flatnonzero((lang == a) | (lang == b))
                    w, offset = linear_svm(x, at, np.where((fam if b is None else lang)[at] == a, 1.0, -1.0))
                    done.append((k, w.astype(np.float32).tobytes(), float(offset)))
                cols = list(zip(*done))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64())], ["k", "w", "b"])

            now, langs, held = None, [], []
            for f in frames:
                for block, lang, x in zip(*[f.column(c).to_pylist() for c in ("block", "lang", "x")]):
                    if block != now:
                        if held:
                            yield train(now, langs, held)
                        now, langs, held = block, [], []
                    langs.append(lang)
                    held.append(x)
            if held:
                yield train(now, langs, held)

        for r in dealt.mapInArrow(solve, "k int, w binary, b double").toLocalIterator():
            self.w[:, r["k"]], self.b[r["k"]] = np.frombuffer(r["w"], np.float32), r["b"]
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        step = max(1, 8_000_000 // max(1, len(self.b)))  # bounds the margins of many machines
        if len(texts) > step:
            parts = [self.predict(texts[a : a + step]) for a in range(0, len(texts), step)]
            return [v for p, _ in parts for v in p], np.concatenate([s for _, s in parts])
        margin = histogram(texts, len(self.w)) @ self.w + self.b
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        n_fam = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :n_fam].argmax(1) if n_fam else np.zeros(len(texts), int)
        score = sure[np.arange(len(texts)), family] if n_fam else np.ones(len(texts))
        column = {p: n_fam + k for k, p in enumerate(self.pairs)}
        out = np.empty(len(texts), object)
        for f in np.unique(family).tolist():
            rows, m = np.flatnonzero(family == f), self.members[f]
            votes, trust = np.zeros((len(rows), len(m))), np.zeros((len(rows), len(m)))
            for i, a in enumerate(m):
                for j in range(i + 1, len(m)):
                    s = sure[rows, column[a, m[j]]]
                    votes[:, i] += s >= 0.5
                    votes[:, j] += s < 0.5
                    trust[:, i] += s
                    trust[:, j] += 1 - s
            best = (votes + trust / (len(m) + 1)).argmax(1)
            out[rows] = np.array(m, object)[best]
            if len(m) > 1:
                score[rows] = score[rows] * trust[np.arange(len(rows)), best] / (len(m) - 1)
        return out.tolist(), score


def train(labelled: DataFrame, per_language: int = 600, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> Model | None:
    """Fit on at most ``per_language`` texts of each language (those of lowest text hash)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(text_col), F.lit(1 << 40)).alias("h"), F.col(text_col).alias("text"))
    counts = materialize(rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    langs = [r["lang"] for r in counts.select("lang").collect()]
    if not langs:
        return None
    # the wanted number by hash and four standard deviations more, whatever a language holds; the lowest are kept below
    wanted = per_language + 4 * per_language**0.5
    limits = counts.where(F.col("n") > wanted).select(F.col("lang").alias("_lang"), F.floor(F.lit(wanted) / F.col("n") * (1 << 40)).alias("_upto"))
    if limits.count() <= MAX_BROADCAST:
        limits = F.broadcast(limits)
    chosen = rows.join(limits, F.col("lang") == F.col("_lang"), "left").where("_upto is null or h < _upto")
    # copies of a text are dropped within each task already
    sample = chosen.select("lang", "h", "text").dropDuplicates(["lang", "h"])

    def features(frames):
        import pyarrow as pa

        for f in text_slices(frames, "text", _TEXTS):
            x = histogram(f.column("text").to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([f.column("lang"), f.column("h"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["lang", "h", "x"])

    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    made = sample.mapInArrow(features, "lang string, h long, x binary").withColumn("r", lowest).where(F.col("r") <= per_language)
    return Model(langs).fit(materialize(made, "lang-train"), dim)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``row``, a struct of ``docs``' columns (or of those in ``keep``), with lang_pred and score."""
    names = docs.columns if keep is None else []
    # the row travels in a struct, so no column of it can clash; the text goes beside it, once
    others = [F.col(f"`{c}`") for c in names if c != text_col] if keep is None else keep
    row = F.struct(*others) if others else F.struct(F.lit(None).alias("_none"))
    text = F.col(f"`{text_col}`")
    packed = docs.select(row.alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    # plain arrays and lists: ``dim`` numbers for each family and each pair inside a family
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))
    out = ["row", "text"] if keep is None else ["row"]

    def run(frames):
        import pyarrow as pa

        m = None
        if shared.value is not None:
            m = Model.__new__(Model)
            vars(m).update(shared.value)
        for f in text_slices(frames, "text", _TEXTS):
            lettered = f.column("lettered").to_numpy(zero_copy_only=False)
            lang, score = np.full(len(lettered), "und", object), np.zeros(len(lettered))
            at = np.flatnonzero(lettered)
            if m is not None and len(at):
                lang[at], score[at] = m.predict(f.column("text").take(pa.array(at)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in out], pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], [*out, "lang_pred", "score"])

    schema = packed.select(*out).schema.add("lang_pred", "string").add("score", "double")
    done = packed.mapInArrow(run, schema)
    if keep is not None:
        return done
    whole = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return done.select(F.struct(*whole).alias("row"), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the labelled documents that aren't held out; predict all. Result: struct ``row``, lang_pred, score."""
    model = train(docs.where(~held_out()), **options)
    return predict(docs, model)


def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs, model, keep=[F.col("doc_id"), held_out().alias("held_out")])
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")
