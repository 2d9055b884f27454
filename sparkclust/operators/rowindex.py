"""Dense 0-based row indexes and exclusive prefix offsets without a global sort task.

``row_number() over (order by k)`` with no partition key moves every row into
one task. Here

* a Parquet scan whose files lie in key order already is numbered where it is: position =
  rows of the files before it + ``_metadata.row_index``. Whether that holds is found from the key
  columns alone, in one narrow pass without a shuffle;
* any other table is dealt by Spark's range partitioning (bounds from a sample, found by binary
  search), sorted inside the ranges and written once with (range, place in the range). The range
  sizes, one number a range, then shift the places.

The rows travel in a struct, so a table may have columns of any names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits
# Splits (a path and a few numbers each) whose offsets may be collected or broadcast.
MAX_BROADCAST_SPLITS = 200_000


def _cols(order_by: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def exclusive_offsets(sizes: DataFrame, order_by: str | Sequence[str], size_col: str = "n", out: str = "offset") -> DataFrame:
    """``sum(n) over (order by ... rows between unbounded preceding and 1 preceding)``, 0 for the first row.

    One window over the whole table: only for tables bounded by a partition or
    split count. ``running_offsets`` handles tables of any size.
    """
    w = Window.orderBy(*_cols(order_by)).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size_col).over(w), F.lit(0)).cast("long"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per physical partition: ``(pid INT, n BIGINT)``."""
    return df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))


# Sample rows per range: bounds of this many sampled keys keep the ranges even.
_SAMPLE_PER_RANGE = 30


def range_column(df: DataFrame, keys: Sequence[Column], n: int) -> Column:
    """The number of the key range (0 .. n-1) a row falls into, as a pure function of its key.

    The bounds are found once, from a hash sample of the keys alone (about
    30 * n narrow rows reach the driver), and enter the plan as literals.
    Every branch that evaluates the column therefore agrees, whatever other
    columns it reads. Nulls sort first, as in ``orderBy``.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    narrow = df.select(key.alias("k"), F.xxhash64(*keys).alias("h"))
    total = narrow.count()
    step = max(1, total // (_SAMPLE_PER_RANGE * n))
    sample = narrow.where(F.pmod("h", F.lit(step)) == 0).select("k").distinct().orderBy("k").collect()
    types = [f.dataType for f in narrow.schema["k"].dataType.fields]
    picks = sorted({len(sample) * i // n for i in range(1, n)} - {0})
    bounds = [
        F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(sample[p]["k"], types))]) for p in picks
    ]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("row")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder: whatever reads it sees the same rows, also after a lost executor."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- positions of a scan ------------------------------------------------------


def _comparable(col):
    """An Arrow column -> (null flags, values that numpy compares as Spark does), None if it can't."""
    import pyarrow as pa

    kind = col.type
    missing = col.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_temporal(kind):
        whole = col.cast(pa.int32() if pa.types.is_date32(kind) else pa.int64()) if pa.types.is_temporal(kind) else col.cast(pa.int64())
        return missing, whole.fill_null(0).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(kind):
        return missing, col.fill_null(0).to_numpy(zero_copy_only=False)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return missing, col.fill_null("").to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(kind):
        return missing, np.array([v or 0 for v in col.to_pylist()], object)
    return None


def _descents(cols: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether each row but the first is below the row before it (nulls first, NaN last, left to right)."""
    below = np.zeros(len(cols[0][0]) - 1, bool)
    equal = np.ones(len(below), bool)
    for missing, v in cols:
        a, b, x, y = missing[:-1], missing[1:], v[:-1], v[1:]
        less, same = (y < x) & ~a & ~b, (y == x) & ~a & ~b
        if v.dtype.kind == "f":
            nan_x, nan_y = np.isnan(x) & ~a, np.isnan(y) & ~b
            less, same = (less | (nan_x & ~nan_y & ~b)) & ~nan_y, same | (nan_x & nan_y)
        below |= equal & (less | (b & ~a))
        equal &= same | (a & b)
    return below


def _has_row_index(df: DataFrame) -> bool:
    """Whether ``df`` is a projection of files that number their rows (Parquet), with that number still at hand."""
    plan = df._jdf.queryExecution().analyzed()
    hidden = plan.metadataOutput()
    kinds = [hidden.apply(i).dataType().catalogString() for i in range(hidden.size()) if hidden.apply(i).name() == "_metadata"]
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and any("row_index:" in k for k in kinds)


def _scan_runs(df: DataFrame, keys: Sequence[Column]) -> list | None:
    """Stretches of the scan, one per split: (file, first and last place, first and last key).

    None if the scan isn't dense (rows were filtered or multiplied) or not in key order.
    """
    if not _has_row_index(df):
        return None
    narrow = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    names = [f"k{i}" for i in range(len(keys))]
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in names}

    def fn(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("ok", pa.bool_())])
        end = None  # the last row so far, and where its stretch began
        begin = None

        def run(ok=True):
            first, last = begin.select(names).to_batches()[0], end.select(names).to_batches()[0]
            arrays = [begin.column("file").chunk(0), begin.column("at").chunk(0), end.column("at").chunk(0), pa.array([ok])]
            keys_ = [x.column(c) for x in (first, last) for c in names]
            return pa.RecordBatch.from_arrays([*arrays, *keys_], [*schema.names, *[f"f_{c}" for c in names], *[f"l_{c}" for c in names]])

        for rb in batches:
            table = pa.Table.from_batches([rb])
            for part in ([table] if end is None else [pa.concat_tables([end, table])]):
                whole = part.combine_chunks()
                file = whole.column("file").to_numpy()
                at = whole.column("at").to_numpy()
                cols = [_comparable(whole.column(c).combine_chunks()) for c in names]
                if any(c is None for c in cols):
                    begin = begin or whole.slice(0, 1)
                    end = whole.slice(len(at) - 1, 1)
                    yield run(False)
                    return
                begin = begin or whole.slice(0, 1)
                turn = file[1:] != file[:-1]
                bad = ~turn & (_descents(cols) | (np.diff(at) != 1))
                for i in np.flatnonzero(turn).tolist():
                    end = whole.slice(i, 1)
                    yield run(not bad.any())
                    begin = whole.slice(i + 1, 1)
                end = whole.slice(len(at) - 1, 1)
                if bad.any():
                    yield run(False)
                    return
        if end is not None:
            yield run()

    ends = ", ".join(f"{p}_{c} {kinds[c]}" for p in "fl" for c in names)
    runs = _stored(narrow.mapInArrow(fn, f"file string, first long, last long, ok boolean, {ends}"), "scan-runs")
    n, good = runs.agg(F.count(F.lit(1)), F.coalesce(F.min("ok"), F.lit(True))).first()
    if not good or n > MAX_BROADCAST_SPLITS:
        return None
    # a row per split: their order is the order of the files, and inside a file that of the places
    ordered = Window.orderBy("file", "first")
    key = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in names])
    before, follows = F.lag("last").over(ordered), F.lag("file").over(ordered) == F.col("file")
    gap = F.when(follows, F.col("first") != before + 1).otherwise(F.col("first") != 0)
    falls = F.coalesce(F.lag(key("l")).over(ordered) > key("f"), F.lit(False))
    if keys and not runs.select(gap.alias("gap"), falls.alias("falls")).where("gap or falls").isEmpty():
        return None
    return runs.select("file", "first", "last").collect()


def _by_file(df: DataFrame, runs: list, out: str) -> DataFrame:
    """``df`` numbered by its place in its file and the rows of the files before it."""
    sizes: dict[str, int] = {}
    for r in runs:
        sizes[r["file"]] = max(sizes.get(r["file"], 0), r["last"] + 1)
    offsets, total = [], 0
    for f in sorted(sizes, key=lambda f: f.encode()):
        offsets.append((f, total))
        total += sizes[f]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_file string, off long"))
    placed = df.select(_whole_row(df), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).join(starts, F.col("file") == F.col("_file"))
    return placed.select(*_unpacked(df, out), (F.col("off") + F.col("at")).cast("long").alias(out))


def _unpacked(df: DataFrame, out: str) -> list[Column]:
    return [F.col("row")[c].alias(c) for c in df.columns if c != out]


def with_scan_index(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Append the 0-based position of each row in physical order (file path, then place in the file).

    ``df`` reads Parquet files: nothing is sorted, written or shuffled. A scan that is no longer dense (a filter)
    or of other files is numbered from its split counts.
    """
    runs = _scan_runs(df, [F.lit(0)])
    return _by_file(df, runs, out) if runs else with_file_position(df, out)


# ---- positions by key -----------------------------------------------------------


def _by_range(df: DataFrame, keys: list[Column], n: int | None, size: Column | None = None) -> DataFrame:
    """(row, range, place, and with ``size`` the running sum before the row) in key order, equal keys in scan order."""
    names = [f"k{i}" for i in range(len(keys))]
    extra = [] if size is None else [F.coalesce(size, F.lit(0)).cast("long").alias("size")]
    keyed = df.select(_whole_row(df), *[k.alias(c) for k, c in zip(keys, names)], *extra, F.monotonically_increasing_id().alias("tie"))
    # the scan position as last key lets the ranges split one very frequent key
    # (without a number of ranges, Spark joins small neighbours of its shuffle partitions)
    dealt = keyed.repartitionByRange(*([n] if n else []), *names, "tie").sortWithinPartitions(*names, "tie")
    place = F.monotonically_increasing_id()
    cols = ["row", F.shiftright(place, 33).cast("int").alias("range"), place.bitwiseAND(F.lit(_LOW_BITS)).alias("place")]
    placed = dealt.select(*cols, *([] if size is None else ["size"]))
    if size is not None:

        def running(batches):
            import pyarrow as pa

            total = 0
            for rb in batches:
                v = rb.column("size").to_numpy()
                upto = total + np.cumsum(v)
                total = int(upto[-1]) if len(v) else total
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(upto - v, pa.int64())], [*rb.schema.names, "before"])

        placed = placed.mapInArrow(running, StructType([*placed.schema.fields, StructField("before", LongType())]))
    return _stored(placed, "by-range")


def with_row_index(df: DataFrame, order_by, out: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = 0-based position of each row in ascending ``order_by`` order (in place of a column of that name).

    Rows with equal keys are ordered by scan position.
    """
    keys = _cols(order_by)
    runs = _scan_runs(df, keys)
    if runs:
        return _by_file(df, runs, out)
    placed = _by_range(df, keys, num_partitions)
    sizes = placed.groupBy(F.col("range").alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    # one row per range: a broadcast of as many rows as there are ranges
    offsets = F.broadcast(exclusive_offsets(sizes, "_range", "n", "off"))
    joined = placed.join(offsets, F.col("range") == F.col("_range"))
    return joined.select(*_unpacked(df, out), (F.col("off") + F.col("place")).cast("long").alias(out))


def with_file_position(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Append the 0-based position of each row in file order (a file-backed DataFrame).

    File order = file path, then byte offset of the split, then row order
    inside the split. Positions come from per-split counts and their prefix
    sum; the rows themselves are never sorted or shuffled.
    """
    raw = df.select(
        _whole_row(df),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    offsets = running_offsets(splits, ["file", "block"], "n", "off")
    offsets = offsets.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "off", "first", "n")
    if offsets.count() <= MAX_BROADCAST_SPLITS:  # rows stay in their scan order; beyond it Spark shuffles
        offsets = F.broadcast(offsets)
    joined = raw.join(offsets, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    # the scan has to be cut as it was when its splits were counted
    place = F.col("at") - F.col("first")
    other = F.raise_error(F.lit("the input is split in another way than when its rows were counted")).cast("long")
    position = F.when((place >= 0) & (place < F.col("n")), F.col("off") + place).otherwise(other)
    return joined.select(*_unpacked(df, out), position.cast("long").alias(out))


def running_offsets(
    sizes: DataFrame, order_by, size_col: str = "n", out: str = "offset", num_partitions: int | None = None
) -> DataFrame:
    """Exclusive prefix sum of ``size_col`` in ``order_by`` order, for tables of any size.

    Each key range takes a running sum and adds the prefix of the range totals (one row per range, broadcast).
    """
    placed = _by_range(sizes, _cols(order_by), num_partitions, F.col(_quoted(size_col)))
    totals = placed.groupBy(F.col("range").alias("_range")).agg(F.sum("size").alias("total"))
    starts = F.broadcast(exclusive_offsets(totals, "_range", "total", "off").select("_range", "off"))
    joined = placed.join(starts, F.col("range") == F.col("_range"))
    return joined.select(*_unpacked(sizes, out), (F.col("off") + F.col("before")).cast("long").alias(out))


def group_offsets(df: DataFrame, group_col: str) -> DataFrame:
    """Size of each group and the exclusive prefix sum of sizes in group order."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    return running_offsets(sizes, group_col, "n", "offset")
