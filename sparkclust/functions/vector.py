"""Column expressions over ``ARRAY<DOUBLE>`` feature vectors.

All of these are built-in Catalyst expressions, so they run JVM-side and work
on batch and streaming DataFrames alike. Centres enter a plan as one folded
literal (``centers_literal``): the model is K x d numbers, a size fixed by the
caller, not by the data.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Centres larger than this many numbers are refused as a plan literal; such
# models take the Arrow path, where they travel as a broadcast variable.
MAX_LITERAL_VALUES = 100_000
# Models up to this many numbers are unrolled into plain arithmetic on constants.
MAX_UNROLLED_VALUES = 256


def _check_centers(centers: Sequence[Sequence[float]]) -> tuple[int, int]:
    k = len(centers)
    if k == 0:
        raise ValueError("no centres")
    d = len(centers[0])
    for row in centers:
        if len(row) != d:
            raise ValueError("centres have different widths")
        for v in row:
            if not math.isfinite(float(v)):
                raise ValueError("centres must be finite numbers")
    if k * d > MAX_LITERAL_VALUES:
        raise ValueError(f"K*d = {k * d} exceeds the literal bound {MAX_LITERAL_VALUES}")
    return k, d


def centers_literal(centers: Sequence[Sequence[float]]) -> Column:
    """K x d centres as one constant ``ARRAY<ARRAY<DOUBLE>>`` (folded by Catalyst)."""
    _check_centers(centers)
    text = json.dumps([[float(v) for v in row] for row in centers])
    return F.from_json(F.lit(text), "array<array<double>>")


PRECISIONS = ("double", "float")


def _check_precision(precision: str) -> str:
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {PRECISIONS}")
    return precision


def sq_distance(x: Column, c: Column, precision: str = "double") -> Column:
    """Squared Euclidean distance, summed left to right over coordinates, no root.

    ``precision="float"`` evaluates every step in 32-bit floats (multiply,
    then add), the single-precision CPU formula.
    """
    t = _check_precision(precision)
    return F.aggregate(
        F.zip_with(x.cast(f"array<{t}>"), c.cast(f"array<{t}>"), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0).cast(t),
        lambda acc, v: acc + v,
    )


def nearest_center(x: Column, centers: Sequence[Sequence[float]], precision: str = "double") -> Column:
    """0-based index of the nearest centre; the lowest index wins ties.

    ``array_min`` over ``struct(dist, idx)`` orders by distance, then index,
    which is the strict-``<`` scan rule of Lloyd's assignment step.
    """
    k, d = _check_centers(centers)
    t = _check_precision(precision)
    if k * d <= MAX_UNROLLED_VALUES:
        # Small models: unrolled arithmetic against constants stays inside
        # whole-stage codegen (higher-order functions are interpreted).
        terms = []
        for i, row in enumerate(centers):
            dist = None
            for j, v in enumerate(row):
                diff = F.get(x, F.lit(j)).cast(t) - F.lit(float(v)).cast(t)
                term = diff * diff
                dist = term if dist is None else dist + term
            terms.append(F.struct(dist.alias("d"), F.lit(i).alias("k")))
        best = terms[0] if k == 1 else F.least(*terms)
        return best.getField("k").cast("int")
    lit = centers_literal(centers)
    scored = F.transform(lit, lambda c, i: F.struct(sq_distance(x, c, t).alias("d"), i.alias("k")))
    return F.array_min(scored).getField("k").cast("int")


def sql_double(v: float) -> str:
    """Exact SQL literal of a finite double (shortest round-trip text + ``D``)."""
    v = float(v)
    if not math.isfinite(v):
        raise ValueError("non-finite value")
    return f"({v!r}D)"


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unrolled_distance_sql(features: str, row: Sequence[float], precision: str = "double") -> str:
    """``(x0-c0)*(x0-c0) + (x1-c1)*(x1-c1) + ...`` as SQL text (a missing coordinate gives null), summed left to right."""
    col = _quote(features)
    single = _check_precision(precision) == "float"
    terms = []
    for j, v in enumerate(row):
        lit = sql_double(v)
        xj = f"get({col}, {j})"
        if single:
            lit, xj = f"CAST({lit} AS FLOAT)", f"CAST({xj} AS FLOAT)"
        terms.append(f"(({xj} - {lit}) * ({xj} - {lit}))")
    return " + ".join(terms)


def with_nearest(
    df, centers: Sequence[Sequence[float]], out: str = "cluster_id", features: str = "features", precision: str = "double"
):
    """DataFrame form of ``nearest_center`` (preferred in plans).

    Small models compute the K distances as columns of one projection, then
    take ``least`` of them and the first index that reaches it: no structs, no
    lambdas, so the step stays in whole-stage codegen. The projection is sent
    as SQL text, so building it costs a few calls whatever K and d are.
    """
    k, d = _check_centers(centers)
    if k * d > MAX_UNROLLED_VALUES:
        return df.withColumn(out, nearest_center(F.col(features), centers, precision))
    names = [f"_d{i}_{out}" for i in range(k)]
    best = f"_best_{out}"
    keep = [_quote(c) for c in df.columns]
    staged = df.selectExpr(
        *keep, *[f"{unrolled_distance_sql(features, row, precision)} AS {_quote(n)}" for row, n in zip(centers, names)]
    )
    least = f"least({', '.join(_quote(n) for n in names)})" if k > 1 else _quote(names[0])
    cases = " ".join(f"WHEN {_quote(names[i])} = {_quote(best)} THEN {i}" for i in range(k - 1))
    idx = f"CAST(CASE {cases} ELSE {k - 1} END AS INT)" if k > 1 else "CAST(0 AS INT)"
    staged = staged.selectExpr(*keep, *[_quote(n) for n in names], f"{least} AS {_quote(best)}")
    return staged.selectExpr(*keep, f"{idx} AS {_quote(out)}")


def center_distances(x: Column, centers: Sequence[Sequence[float]], precision: str = "double") -> Column:
    """Array of the squared distance to every centre, in centre order."""
    lit = centers_literal(centers)
    return F.transform(lit, lambda c: sq_distance(x, c, precision))


def round_centers(centers: Sequence[Sequence[float]], precision: str = "double") -> list[list[float]]:
    """Centres as the given precision stores them (float: rounded to 32-bit values)."""
    import numpy as np

    if _check_precision(precision) == "float":
        return np.asarray(centers, dtype=np.float32).astype(np.float64).tolist()
    return [[float(v) for v in row] for row in centers]


def is_finite_vector(x: Column) -> Column:
    """True when no element is null, NaN or infinite."""
    return F.forall(
        x,
        lambda v: v.isNotNull() & ~F.isnan(v) & (v != F.lit(float("inf"))) & (v != F.lit(float("-inf"))),
    )


def dense_from_long(entries: Column, width: int, idx_field: str = "bucket", val_field: str = "tf") -> Column:
    """``ARRAY<STRUCT<idx, val>>`` (sparse entries, unique indexes) -> dense ``ARRAY<DOUBLE>``.

    Entries are sorted by index and appended with the zero run before each:
    one pass over the entries instead of one map lookup per position.
    """
    ordered = F.array_sort(entries)
    filled = F.aggregate(
        ordered,
        F.array().cast("array<double>"),
        lambda acc, e: F.concat(
            acc,
            F.array_repeat(F.lit(0.0), e.getField(idx_field) - F.size(acc)),
            F.array(e.getField(val_field).cast("double")),
        ),
    )
    return F.concat(filled, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(filled)))
