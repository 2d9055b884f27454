"""From raw documents to packed sequences: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. ``run`` writes each result as Parquet and reads it as the next input.

Defined results
* null, empty and letterless texts go in the first stage; very long texts pass whole, and cleaned of failing lines.
* a null language or source is a value like others (a row without a language teaches nothing); a null id is a row like others.
* of repeated rows, copies and near copies one row stays: that of the smallest id, null ids last; ties are told apart
  by a hash of the whole row.
* an empty table gives an empty result; columns of any other names pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclust.llm import langid, mixing, ngram_join, packing, quality
from sparkclust.llm.common import materialize, table

#: Language answers less sure than this count as rejected (two coin flips score 0.25).
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark, docs, sf_dir):
    """Rejects texts without a letter and texts whose language can't be told."""
    answered = langid.identify(docs)
    sure = answered.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return sure.select("row.*")


def quality_rules(spark, docs, sf_dir):
    """Removes failing lines; rejects documents by the base rules and by the share of words lost."""
    return quality.clean_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard(spark, docs, sf_dir):
    """Keeps the smallest id of every group of copies and near copies."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    """Repeats and drops documents so that every source meets its target weight."""
    return mixing.mix(docs)


def pack_sequences(spark, docs, sf_dir):
    """Packs the documents into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# the linear classifiers of the first stage have no SQL form
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
