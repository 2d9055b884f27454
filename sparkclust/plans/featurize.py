"""Text -> hashed character-bigram term frequencies.

Two physical forms, same numbers:

* ``arrow``: an Arrow UDF turns batches of texts into sparse (or dense) bucket histograms in one
  pass (UTF-16 units via NumPy), a slice of bounded size at a time. No shuffle at all.
* ``sql`` (long form): bucket array per text, ``explode``, then
  ``groupBy(id, bucket).count()`` with a partial aggregate in the stage of the explode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_BUCKETS, SLICE_UNITS, bucket_entries, row_text, units_to_buckets, utf16_units
from ..functions.vector import dense_from_long
from ..operators.rowindex import with_file_position, with_row_index

# Cells, zeros included, of the dense histograms that are made together.
_SLICE_CELLS = 1 << 18
# Texts whose sparse histograms are made together.
_SLICE_TEXTS = 1024


def hashed_tf_long(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    n_features: int = DEFAULT_BUCKETS,
    bracketed: bool = True,
    impl: str = "arrow",
) -> DataFrame:
    """``(id, bucket INT, tf DOUBLE)`` for every non-zero bucket of every text.

    ``impl="arrow"`` counts inside the row (sparse histograms of whole batches) and explodes the
    non-zero buckets: no shuffle. ``impl="sql"`` is pure Catalyst, with a row per character.
    """
    if impl == "arrow":
        sparse = df.select(F.col(id_col).alias("id"), _sparse_udf(n_features)(row_text(F.col(text_col), bracketed)).alias("_v"))
        cells = sparse.select("id", F.explode(F.arrays_zip("_v.idx", "_v.val")).alias("_c"))
        return cells.select("id", F.col("_c.idx").alias("bucket"), F.col("_c.val").alias("tf"))
    if impl != "sql":
        raise ValueError(f"unknown impl {impl!r}")
    src = df.select(F.col(id_col).alias("id"), utf16_units(row_text(F.col(text_col), bracketed)).alias("_u"))
    exploded = src.select("id", F.explode(units_to_buckets(F.col("_u"), n_features)).alias("bucket"))
    return exploded.groupBy("id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def dense_from_tf(long_tf: DataFrame, n_features: int = DEFAULT_BUCKETS) -> DataFrame:
    """Long ``(id, bucket, tf)`` -> ``(id, features ARRAY<DOUBLE>)``; groups hold at most ``n_features`` entries."""
    grouped = long_tf.groupBy("id").agg(F.collect_list(F.struct("bucket", "tf")).alias("_e"))
    return grouped.select("id", dense_from_long(F.col("_e"), n_features).alias("features"))


def _slices(batches: Iterator[pa.Array], rows: int) -> Iterator[list]:
    """The texts of Arrow batches, at most ``rows`` and ``SLICE_UNITS`` units (or one text) at a time."""
    for batch in batches:
        # a text has no more UTF-16 units than bytes
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(batch):
            before = int(upto[lo - 1]) if lo else 0
            hi = int(np.searchsorted(upto, before + SLICE_UNITS, "right"))
            hi = min(max(hi, lo + 1), lo + rows, len(batch))
            yield batch.slice(lo, hi - lo).to_pylist()
            lo = hi


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _dense_udf(n_features: int):
    @F.arrow_udf("array<double>")
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _slices(batches, max(1, _SLICE_CELLS // n_features)):
            row, bucket, count = bucket_entries(texts, n_features)
            cells = np.zeros((len(texts), n_features))
            cells[row, bucket] = count
            yield _lists(np.arange(len(texts) + 1) * n_features, cells.ravel())

    return dense


def _sparse_udf(n_features: int):
    @F.arrow_udf("struct<size:int,idx:array<int>,val:array<double>>")
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _slices(batches, _SLICE_TEXTS):
            row, bucket, count = bucket_entries(texts, n_features)
            cuts = np.searchsorted(row, np.arange(len(texts) + 1))
            size = pa.array(np.full(len(texts), n_features, np.int32))
            yield pa.StructArray.from_arrays([size, _lists(cuts, bucket.astype(np.int32)), _lists(cuts, count)], ["size", "idx", "val"])

    return sparse


def hashed_tf_sparse(
    df: DataFrame, id_col: str = "id", text_col: str = "text", n_features: int = DEFAULT_BUCKETS, bracketed: bool = True
) -> DataFrame:
    """``(id, features STRUCT<size, idx, val>)``: only the non-zero buckets are stored.

    Same numbers as the dense form; a short text costs a few entries instead of
    ``n_features`` doubles, which is what a cached training set holds.
    """
    return df.select(F.col(id_col).alias("id"), _sparse_udf(n_features)(row_text(F.col(text_col), bracketed)).alias("features"))


def hashed_tf_dense(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    n_features: int = DEFAULT_BUCKETS,
    bracketed: bool = True,
    impl: str = "arrow",
) -> DataFrame:
    """``(id, features ARRAY<DOUBLE>)`` of width ``n_features``, one row per input row."""
    if impl == "sql":
        long_tf = hashed_tf_long(df, id_col, text_col, n_features, bracketed, impl="sql")
        ids = df.select(F.col(id_col).alias("id"))
        dense = dense_from_tf(long_tf, n_features)
        # texts without any bigram still get a zero vector
        zero = F.array_repeat(F.lit(0.0), n_features)
        return ids.join(dense, "id", "left").select("id", F.coalesce("features", zero).alias("features"))
    if impl != "arrow":
        raise ValueError(f"unknown impl {impl!r}")
    udf = _dense_udf(n_features)
    return df.select(F.col(id_col).alias("id"), udf(row_text(F.col(text_col), bracketed)).alias("features"))


def featurize_text(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    n_features: int = DEFAULT_BUCKETS,
    bracketed: bool = True,
    form: str = "dense",
    impl: str = "arrow",
    index_by: str | None = None,
) -> DataFrame:
    """The featurize job: texts -> term-frequency vectors.

    ``index_by`` replaces the id by the 0-based position in that order (the
    featurizer's ``idx``); ``index_by="file"`` uses the position in the input
    files (a file-backed DataFrame). ``form="long"`` returns ``(id, bucket, tf)``.
    """
    src = df
    key = id_col
    if index_by == "file":
        src = with_file_position(df, out="_idx")
        key = "_idx"
    elif index_by is not None:
        src = with_row_index(df, index_by, out="_idx")
        key = "_idx"
    if form == "long":
        return hashed_tf_long(src, key, text_col, n_features, bracketed, impl)
    if form == "sparse":
        return hashed_tf_sparse(src, key, text_col, n_features, bracketed)
    if form != "dense":
        raise ValueError(f"unknown form {form!r}")
    return hashed_tf_dense(src, key, text_col, n_features, bracketed, impl)
