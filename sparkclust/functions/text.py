"""Text expressions: row strings, UTF-16 code units, character bigrams and the bigram hash.

Bigram buckets follow the legacy hashing term-frequency rule: a term's bucket is
its Java ``String.hashCode`` modulo the bucket count. For a two-unit string
``u0 u1`` that is ``31*u0 + u1``; for a one-unit text the only term is the text
itself (``u0``); an empty text has no terms. Units are UTF-16 code units, so a
character outside the Basic Multilingual Plane counts as two (a surrogate pair).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hashing rule.
HASH_MULTIPLIER = 31
DEFAULT_BUCKETS = 1000
# UTF-16 surrogate arithmetic (fixed by the encoding).
_SUPPLEMENTARY_BASE = 65536
_HIGH_SURROGATE = 55296
_LOW_SURROGATE = 56320
# UTF-16 units whose bigrams are counted together.
SLICE_UNITS = 1 << 18


def value_text(c: Column) -> Column:
    """Value as the row-string printer shows it: ``null`` for NULL."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def row_string(*cols: Column) -> Column:
    """``[v1,v2,...]``: comma-joined values in brackets, ``null`` for NULL."""
    return F.concat(F.lit("["), F.concat_ws(",", *[value_text(c) for c in cols]), F.lit("]"))


def row_text(text: Column, bracketed: bool = True) -> Column:
    """The text a document is featurized from: the one-column row string, or the bare text."""
    return row_string(text) if bracketed else F.coalesce(text, F.lit("null"))


def utf16_units(s: Column) -> Column:
    """``ARRAY<INT>`` of UTF-16 code units of ``s``."""
    chars = F.filter(F.split(s, ""), lambda c: c != F.lit(""))

    def units(c):
        cp = F.ascii(c)
        off = cp - F.lit(_SUPPLEMENTARY_BASE)
        pair = F.array(
            F.lit(_HIGH_SURROGATE) + F.shiftright(off, 10),
            F.lit(_LOW_SURROGATE) + off.bitwiseAND(F.lit(1023)),
        )
        return F.when(cp >= F.lit(_SUPPLEMENTARY_BASE), pair).otherwise(F.array(cp))

    return F.flatten(F.transform(chars, units))


def units_to_buckets(u: Column, n_buckets: int = DEFAULT_BUCKETS) -> Column:
    """Bigram buckets from an ``ARRAY<INT>`` of UTF-16 units."""
    n = F.size(u)
    pairs = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: (F.lit(HASH_MULTIPLIER) * u[i] + u[i + 1]) % F.lit(n_buckets),
    )
    return (
        F.when(n >= 2, pairs)
        .when(n == 1, F.array(u[0] % F.lit(n_buckets)))
        .otherwise(F.array().cast("array<int>"))
    )


def text_chars(s: Column) -> Column:
    """``ARRAY<STRING>`` of the characters (code points) of ``s``."""
    return F.filter(F.split(s, ""), lambda c: c != F.lit(""))


def chars_to_bigrams(chars: Column) -> Column:
    """Sliding two-character strings from a character array (one character gives itself).

    Takes the character array as a column so it is built once per row; indexing
    an array is O(1), unlike ``substring`` at a character offset.
    """
    n = F.size(chars)
    grams = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(chars[i], chars[i + 1]))
    return F.when(n >= 2, grams).when(n == 1, chars).otherwise(F.array().cast("array<string>"))


def _entries(raw: list[bytes], n_buckets: int):
    """Cell (row * n_buckets + bucket) and count of the non-zero cells of UTF-16 texts, in order."""
    import numpy as np

    size = np.fromiter((len(r) // 2 for r in raw), np.int64, len(raw))
    units = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int64)
    # one term per unit but the last of its text; a text of one unit is its own term
    row = np.repeat(np.arange(len(raw)), size)
    last = np.zeros(len(units), bool)
    last[np.cumsum(size)[size > 0] - 1] = True
    follows = np.append(units[1:], 0)
    lone = size[row] == 1
    bucket = np.where(lone, units, HASH_MULTIPLIER * units + follows) % n_buckets
    keep = lone | ~last
    return np.unique(row[keep] * n_buckets + bucket[keep], return_counts=True)


def _long_entries(raw: bytes, n_buckets: int, stretch: int):
    """``_entries`` of one text beyond ``stretch`` units: stretches share a unit, so every bigram is counted once."""
    import numpy as np

    cell, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(raw) // 2 - 1, stretch):
        more, n = _entries([raw[2 * lo : 2 * (lo + stretch + 1)]], n_buckets)
        cell, at = np.unique(np.concatenate([cell, more]), return_inverse=True)
        count = np.bincount(at, np.concatenate([count, n])).astype(np.int64)
    return cell, count


def bucket_entries(texts, n_buckets: int = DEFAULT_BUCKETS):
    """Bucket counts of many texts at once: row, bucket and count of every non-zero cell, row by row.

    Texts are worked on ``SLICE_UNITS`` units at a time, however long or many they are.
    """
    import numpy as np

    cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held: list[bytes] = []

    def add(first: int, found) -> None:
        cells.append(first * n_buckets + found[0])
        counts.append(found[1])

    n = units = 0  # texts seen, units held
    for t in texts:
        raw = t.encode("utf-16-le", "surrogatepass") if t else b""
        if held and units + len(raw) // 2 > SLICE_UNITS:
            add(n - len(held), _entries(held, n_buckets))
            held, units = [], 0
        if len(raw) // 2 > SLICE_UNITS:
            add(n, _long_entries(raw, n_buckets, SLICE_UNITS))
        else:
            held.append(raw)
            units += len(raw) // 2
        n += 1
    if held:
        add(n - len(held), _entries(held, n_buckets))
    cell, count = np.concatenate(cells), np.concatenate(counts)
    return cell // n_buckets, cell % n_buckets, count.astype(np.float64)


def bucket_counts_numpy(text: str | None, n_buckets: int = DEFAULT_BUCKETS):
    """The whole histogram of one text."""
    import numpy as np

    out = np.zeros(n_buckets, dtype=np.float64)
    _, bucket, count = bucket_entries([text], n_buckets)
    out[bucket] = count
    return out
