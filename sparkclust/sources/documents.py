"""Document sources: JSON records with a nested ``user`` struct, read with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField(
            "user",
            T.StructType([T.StructField("lang", T.StringType()), T.StructField("name", T.StringType())]),
        ),
        T.StructField("text", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_documents(spark: SparkSession, path, schema: T.StructType = DOC_SCHEMA) -> DataFrame:
    """JSON lines (file, folder or glob) -> documents; unparsable lines keep ``_corrupt_record``."""
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def documents_from_table(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", user_lang_col: str = "source", text_col: str = "text", user_name_col: str | None = None) -> DataFrame:
    """A document table -> the JSON document shape (``user.lang`` and ``user.name`` from the columns named)."""
    name = F.lit(None) if user_name_col is None else F.col(user_name_col)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(lang_col).alias("lang"),
        F.struct(F.col(user_lang_col).alias("lang"), name.cast("string").alias("name")).alias("user"),
        F.col(text_col).alias("text"),
    )


def write_documents_json(docs: DataFrame, path: str) -> None:
    docs.select("id", "lang", "user", "text").write.mode("overwrite").json(path)


def register_documents(docs: DataFrame, name: str = "document_rows") -> DataFrame:
    """Expose documents to SQL under ``name`` (temp view)."""
    docs.createOrReplaceTempView(name)
    return docs
