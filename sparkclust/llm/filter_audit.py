"""Filter interaction audit: what each filter removes in every order, by forward-backward path counting.

The subsets of the filters form a lattice; applying filter f after the subset S is
the edge (S, f), and every order of the filters is a path from the empty to the
full subset. What an edge removes depends on S only, not on the order inside S,
so documents are counted once per failure mask and an edge sums masks. The number
of orders through an edge is (orders reaching S) * (orders leaving S + f), both
counted along the lattice; weighted by it, an edge's removals add up to the
Shapley total of its filter, and the steps of every single order are read from
the same edges.

One scan makes a narrow row per document (id, part, mask, SHA-256 of the text);
all the rest works on these or on counts per (part, mask).

Defined results
* null text: empty text. Null source: the part ''. An empty table gives an empty result.
* a null id has no smaller id and no label: it never fails the copies filter.
* repeated rows count as often as they occur; rows of one id and text are no copies of each other.
* labels of one id: flagged if any of its rows is; a null label is no flag.
* very long texts are processed whole, in one row; other columns of the tables aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table


def rules(text: Column) -> dict[str, Column]:
    """Failure conditions of the contract by letter, but for the copies (``E``)."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)

    def few_and_alike(w: Column) -> Column:
        n = F.size(w)
        return F.struct((n < 50).alias("A"), (100 * F.size(F.array_distinct(w)) < 65 * n).alias("B"))

    listed = F.transform(F.array(words), few_and_alike)[0]  # the words of a text are listed once
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": listed["A"], "B": listed["B"], "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


class Lattice:
    """Edges of the subset lattice of ``letters`` with the orders through them, and the steps of all orders."""

    def __init__(self, letters: str):
        self.letters, full = letters, (1 << len(letters)) - 1
        bits = {f: 1 << i for i, f in enumerate(letters)}
        by_size = sorted(range(full + 1), key=int.bit_count)
        reach, leave = dict.fromkeys(by_size, 0), dict.fromkeys(by_size, 0)
        reach[0] = leave[full] = 1
        for s in by_size:
            for b in bits.values():
                if not s & b:
                    reach[s | b] += reach[s]
        for s in reversed(by_size):
            for b in bits.values():
                if not s & b:
                    leave[s] += leave[s | b]
        assert reach[full] == leave[0] == factorial(len(letters))
        self.edges = [(s, f, b, reach[s] * leave[s | b]) for s in by_size for f, b in bits.items() if not s & b]
        self.steps = [
            (sum(bits[g] for g in order[:k]), f, "".join(order), k + 1) for order in permutations(letters) for k, f in enumerate(order)
        ]


def edge_counts(masks: DataFrame, lattice: Lattice) -> DataFrame:
    """Counts of every edge of every part, from (part, mask, n, good, toxic) rows (2 ** filters of them a part at most)."""
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("letter"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, f, b, w in lattice.edges])
    at = masks.select("*", F.explode(edges).alias("e")).select("*", "e.*")
    meets = F.col("mask").bitwiseAND(F.col("state"))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    here = (meets == 0) & fails

    def total(what: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0)).cast("long")

    counts = at.groupBy("part", "state", "letter", "orders").agg(
        total("n", (meets == 0) & ~fails).alias("kept"),
        total("n", here).alias("removed"),
        total("n", (meets != 0) & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    all_edges = Window.partitionBy("part", "letter")
    return counts.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(all_edges).cast("long"))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", letters: str = "ABCDE") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bit i for ``letters[i]``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bit = {f: F.lit(1 << i) for i, f in enumerate(letters)}
    mask = sum((F.when(c, bit[f]).otherwise(0) for f, c in rules(text).items()), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("h"))
    # repeated rows of one id and text become one row, in part before the shuffle
    rows = materialize(rows.groupBy("id", "part", "mask", "h").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    known = rows.where("id IS NOT NULL")
    # the smallest id of each text; (text, id) is met by few rows, so a text of very many copies stays spread
    first = known.groupBy("h").agg(F.min("id").alias("id")).select(F.col("h").alias("_h"), F.col("id").alias("_id"))
    copies = known.join(first, (F.col("h") == F.col("_h")) & (F.col("id") == F.col("_id")), "left").select(
        "id", "part", F.when(F.col("_id").isNull(), F.col("mask") + bit["E"]).otherwise(F.col("mask")).alias("mask"), "n"
    )
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("_l")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    flagged = copies.join(flags, F.col("id") == F.col("_l"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.where("id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return flagged.union(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row per part, order of the filters and step; see the module docstring."""
    lattice = Lattice("ABCDE")
    edges = edge_counts(failure_masks(docs, labels, **columns), lattice)
    # the steps of all orders: a constant number of rows, whatever the data
    steps = docs.sparkSession.createDataFrame(lattice.steps, "state int, letter string, filter_order string, step int")
    return edges.join(F.broadcast(steps), ["state", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask,
             coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic
      FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || p.c || q.c || r.c AS filter_order FROM x a, x b, x p, x q, x r
      WHERE len(list_distinct([a.c, b.c, p.c, q.c, r.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS b,
             coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
e AS (SELECT part, filter_order, step, b,
             sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM e
"""
