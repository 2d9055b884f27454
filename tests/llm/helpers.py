"""Frames with awkward rows, shared by the tests of this folder."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ("id", "row", "size", "key", "h", "label", "uid", "th", "target", "source_size", "rank", "x", "q", "g", "host", "start", "_s", "_b", "score")


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def prose(seed, n_words=120, lang=0):
    stems = (["the", "ing", "tion", "and", "of", "wh"], ["der", "sch", "ung", "heit", "ein", "über"], ["les", "eau", "tion", "que", "é", "aux"])[lang]
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    lines, left = [], n_words
    while left > 0:
        k = min(left, rng.randint(8, 15))
        lines.append(sentence(rng, k, vocab))
        left -= k
    return "\n".join(lines)


def awkward_rows():
    long_text = prose(99, 60_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one", "de", None, 3),
        (None, prose(1), "en", "b", 5), (None, prose(1), "en", "b", 5), (None, None, None, None, None),
        (5, prose(2), None, "b", 7), (6, prose(2), "en", "c", 7), (7, prose(2), "en", "c", 7), (7, prose(2), "en", "c", 7),
        (8, long_text, "en", "b", 9), (9, "  a  b\n\n　c  d \n", "fr", "", 1), (10, "<|endoftext|> x\x00y 😀 é́ don't 1234", "en", "z", 2),
        (11, "12 34 !!", "en", "z", 2),
    ]
    return rows + [(20 + i, prose(200 + i, 60 + i, i % 3), ("en", "de", "fr")[i % 3], "abc"[i % 3], i) for i in range(24)]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}) if clash else df


def words(text):
    return WORD.findall(text or "")
