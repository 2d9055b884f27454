"""Line-first cleaning: drop failing lines, then reject documents that lose too much text.

All of it is column expressions. A line fails if it is
* noise: symbols ``#*$%&|<>`` or doubled exclamation marks at ``noise`` or more per word,
* navigation: three or more ``|`` separators, or one or two words without end punctuation
  next to other lines, or
* boilerplate: at most ``boiler_words`` words that match a licence / notice phrase.
Blank lines never fail. A document is kept if the base rules of the contract
hold and its failed lines carry at most ``max_loss`` of its words.

Repeated 3-word windows are found inside the row: each window becomes one
number (hash bits over its position), the numbers are sorted as primitives, and
equal neighbours are confirmed on the words themselves. No shuffle, no Python,
and time n log n in the words of a text.

Defined results
* null or empty text: no words, all counts 0, base_failed true, kept false, cleaned text empty.
* very long texts are processed whole, in one row; ties and repeated rows get equal results.
* extra columns are kept by ``clean_documents``; new columns carry the names given there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

# Phrases that start a licence or notice line.
BOILERPLATE = (
    r"(?i)^\W*(all rights reserved|licensed under|released under|this work is licensed|copyright|©|"
    r"privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|subscribe to|sign up|log ?in|"
    r"click here|read more|share this|follow us|powered by|skip to content|back to top)\b"
)
SYMBOL = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``words``."""
    n = F.size(words)
    shift = F.length(F.bin(n))

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3).cast("long"), p - F.get(starts, j - 1))).cast("long"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

    def from_keys(args: Column) -> Column:
        keys, bits = args["keys"], args["bits"]
        mask = args["mask"]

        def same(a: Column, b: Column) -> Column:
            p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal_words = [F.get(words, p + k) == F.get(words, q + k) for k in range(3)]
            high = F.call_function("shiftrightunsigned", a, bits) == F.call_function("shiftrightunsigned", b, bits)
            return F.coalesce(high & equal_words[0] & equal_words[1] & equal_words[2], F.lit(False))

        twice = F.filter(keys, lambda k, j: same(k, F.get(keys, j + 1)) | same(k, F.get(keys, j - 1)))
        return _let(F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(mask))), covered)

    def body(bits: Column) -> Column:
        raw = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", window_hash(i), bits).bitwiseOR(i.cast("long")))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return _let(F.struct(F.sort_array(raw).alias("keys"), bits.alias("bits"), mask.alias("mask")), from_keys)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(shift, body))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    dup = _let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    per_words = _let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), 1),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    return F.struct(
        per_words.alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOL).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    )


def judge_lines(text: Column, noise: float = 0.3, boiler_words: int = 20) -> Column:
    """Array of (line, words, failed) for the lines of a text."""

    def judge(lines: Column) -> Column:
        single = F.size(lines) < 2

        def one(line: Column) -> Column:
            w = _count(line, WORD)

            def verdict(w: Column) -> Column:
                marks = _count(line, SYMBOL) + _count(line, "!!")
                noisy = marks >= w * F.lit(noise)
                menu = (_count(line, r"\|") >= 3) | ((w <= 2) & ~single & ~line.rlike(r"[.!?:;…。！？\"'”»)\]]\s*$"))
                boiler = (w <= boiler_words) & line.rlike(BOILERPLATE)
                failed = (w > 0) & (((marks > 0) & noisy) | menu | boiler)
                return F.struct(line.alias("line"), w.cast("long").alias("words"), failed.alias("failed"))

            return _let(w, verdict)

        return F.transform(lines, one)

    return _let(F.split(F.coalesce(text, F.lit("")), "\n"), judge)


def quality(text: Column, max_loss: float = 0.3, **rules) -> Column:
    """Struct of the base counts, base_failed, lost_words, kept and the cleaned text."""

    def assemble(m: Column) -> Column:
        c, lines = m["c"], m["lines"]
        n, rep = c["w"]["n_words"], c["w"]["n_repeat_words"]
        base_failed = (n < 50) | (100 * rep > 50 * n)
        lost = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.when(x["failed"], x["words"]).otherwise(0))
        cleaned = F.array_join(F.transform(F.filter(lines, lambda x: ~x["failed"]), lambda x: x["line"]), "\n")
        return F.struct(
            n.alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"),
            rep.alias("n_repeat_words"), base_failed.alias("base_failed"), lost.alias("lost_words"),
            (~base_failed & (lost <= n * F.lit(max_loss))).alias("kept"), cleaned.alias("cleaned"),
        )

    return _let(F.struct(base_counts(text).alias("c"), judge_lines(text, **rules).alias("lines")), assemble)


def clean_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The kept documents with their failing lines removed; all columns of ``docs`` stay."""
    # the verdict and the row travel in one array column that is exploded, so the rules run once per row
    q = quality(F.col(f"`{text_col}`"), **rules)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = F.filter(F.array(F.struct(row.alias("row"), q.alias("q"))), lambda x: x["q"]["kept"])
    x = docs.select(F.explode(kept).alias("x"))
    return x.select(*[(F.col("x.q.cleaned") if c == text_col else F.col("x.row")[c]).alias(c) for c in docs.columns])


def op6_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    q = docs.select("doc_id", F.explode(F.array(quality(F.col("text")))).alias("q"))
    return q.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             len(regexp_extract_all(line, '[#*$%&|<>]')) + len(regexp_extract_all(line, '!!')) AS marks,
             len(regexp_extract_all(line, '[|]')) AS bars, many
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) > 1 AS many FROM d)),
lost AS (SELECT doc_id, sum(n)::BIGINT AS lost_words FROM l
         WHERE n > 0 AND ((marks > 0 AND marks >= n * 0.3) OR bars >= 3
            OR (n <= 2 AND many AND NOT regexp_matches(line, '[.!?:;…。！？"''”»)\]]\s*$'))
            OR (n <= 20 AND regexp_matches(line, '@BOILER@')))
         GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(lost_words, 0) <= n_words * 0.3) AS kept
FROM b LEFT JOIN lost ON b.doc_id = lost.doc_id
""".replace("@BOILER@", BOILERPLATE)
