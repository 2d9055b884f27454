"""Point sources: tables to ``points(id BIGINT, features ARRAY<DOUBLE>)`` and the text line format.

Text format (one object per line)::

    <id> <c0> <c1> ... <c(d-1)>

tokens separated by one blank; the first token is kept as ``src_id`` and the
object's identity is its 0-based position in file order. Lines with a wrong
width or a token that is not a finite number go to a ``rejects`` DataFrame
instead of silently shifting later coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import is_finite_vector
from ..operators.rowindex import with_file_position

# Fixed value: the line trim strips every character at or below U+0020 from both ends.
_EDGE_CONTROL = r"^[\x00-\x20]+|[\x00-\x20]+$"


@dataclass
class ParsedPoints:
    points: DataFrame  # id BIGINT, src_id STRING, features ARRAY<DOUBLE>
    rejects: DataFrame  # id BIGINT, line STRING, reason STRING
    observation: object = None  # Observation: lines / rejected, filled by the first job that parses

    def counts(self) -> dict:
        """``{"lines": n, "rejected": r}`` once a job has read the points (no extra job)."""
        return dict(self.observation.get) if self.observation is not None else {}


def points_from_columns(df: DataFrame, id_col: str, cols: Sequence[str | Column]) -> DataFrame:
    """Any table -> points; each listed column (or expression) becomes one coordinate."""
    exprs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.array(*[e.cast("double") for e in exprs]).alias("features"),
    )


def points_from_array(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """A table with an array column (e.g. embeddings) -> points."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("features"))


def split_rejects(points: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Separate rows whose vector is null, non-finite or of the wrong width."""
    width = F.size("features")
    ok = F.col("features").isNotNull() & is_finite_vector(F.col("features")) & (width > 0)
    if dim is not None:
        ok = ok & (width == F.lit(dim))
    flagged = points.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = flagged.where("_ok").drop("_ok")
    bad = flagged.where(~F.col("_ok")).drop("_ok")
    return good, bad


def scala_trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_CONTROL, "")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text files -> ``(line_no BIGINT, line STRING)`` with ``line_no`` the 0-based position in file order.

    See ``with_file_position``: lines are numbered from per-split counts, never sorted.
    """
    text = spark.read.text(path)
    return with_file_position(text, "line_no").select("line_no", F.col("value").alias("line"))


def parse_point_lines(lines: DataFrame, dim: int | None = None, line_col: str = "line", pos_col: str = "line_no") -> ParsedPoints:
    """Parse ``id c0 .. c(d-1)`` lines into points and rejects.

    ``dim`` defaults to the width of the first line (by position) that isn't blank.
    """
    trimmed = scala_trim(F.col(line_col))
    tokens = F.split(trimmed, " ")
    coords_txt = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    # the string-to-double cast itself trims characters <= U+0020 from both
    # ends, which is the token trim rule, so no per-token regex is needed
    coords = F.transform(coords_txt, _try_double)
    df = lines.select(
        F.col(pos_col).cast("long").alias("id"),
        F.col(line_col).alias("line"),
        tokens.getItem(0).alias("src_id"),
        coords.alias("features"),
    )
    if dim is None:
        first = df.where(F.length(scala_trim(F.col("line"))) > 0).agg(F.min_by(F.size("features"), "id").alias("w")).first()
        if first["w"] is None:
            raise ValueError("empty input: no lines to parse")
        dim = int(first["w"])
    width = F.size("features")
    parsed_ok = F.forall("features", lambda v: v.isNotNull())
    finite = is_finite_vector(F.col("features"))
    reason = (
        F.when(width != F.lit(dim), F.lit("width"))
        .when(~parsed_ok, F.lit("parse"))
        .when(~finite, F.lit("nonfinite"))
    )
    flagged = df.withColumn("reason", reason)
    obs = None
    if not flagged.isStreaming:
        from pyspark.sql import Observation

        obs = Observation("parse")
        flagged = flagged.observe(
            obs,
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.col("reason").isNotNull().cast("long")).alias("rejected"),
        )
    points = flagged.where(F.col("reason").isNull()).select("id", "src_id", "features")
    rejects = flagged.where(F.col("reason").isNotNull()).select("id", "line", "reason")
    return ParsedPoints(points, rejects, obs)


def _try_double(c: Column) -> Column:
    # text that is not a number -> NULL (a reject)
    return c.try_cast("double")


def first_line(spark: SparkSession, path: str | Sequence[str]) -> str | None:
    """The first line in file order that isn't blank; one line per split reaches the reduction."""
    lines = spark.read.text(path).select(
        "value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place")
    )
    return lines.where(F.length(scala_trim(F.col("value"))) > 0).agg(F.min_by("value", "place").alias("line")).first()["line"]


def line_width(line: str) -> int:
    """Coordinates on a point line: tokens after the id (same trim and split as the parser)."""
    import re

    body = re.sub(_EDGE_CONTROL, "", line)
    return max(len(body.split(" ")) - 1, 0)


def read_points(spark: SparkSession, path: str | Sequence[str], dim: int | None = None) -> ParsedPoints:
    """Text point files -> points (id = position in file order) and rejects.

    ``dim`` defaults to the width of the first line that isn't blank.
    """
    if dim is None:
        first = first_line(spark, path)
        if first is None:
            raise ValueError("empty input: no lines to parse")
        dim = line_width(first)
    return parse_point_lines(read_lines(spark, path), dim)
