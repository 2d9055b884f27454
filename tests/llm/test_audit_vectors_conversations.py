"""Filter audit, near-duplicate vectors and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from helpers import frame, prose, words
from pyspark.sql import functions as F

from sparkclust.llm import conversations, filter_audit, hyperplane

# ---- filter audit --------------------------------------------------------------


def failures(rows):
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        out.append({f for f, bad in fails.items() if bad})
    return out


def brute_audit(rows, good, toxic):
    fails, out = failures(rows), Counter()
    result = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[3] or "") == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [i for i, x in mine if f in x and not x & before]
                total[f] += len(gone)
                result[part, order, k + 1] = [
                    sum(not x & (before | {f}) for _, x in mine), len(gone), sum(f in x and bool(x & before) for _, x in mine),
                    sum(x == {f} for _, x in mine), sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
        out.update({(part, f): n for f, n in total.items()})
    return {(p, o, s, *v, out[p, o[s - 1]]) for (p, o, s), v in result.items()}


def test_audit_of_awkward_documents(spark):
    rng = random.Random(1)
    rows = [(1, None, "", "a", 0), (2, "", "", "a", 0), (None, "", "", "a", 0), (None, prose(1), "", None, 0), (3, prose(1), "", "", 0), (3, prose(1), "", "", 0)]
    rows += [(4, prose(1), "", "b", 0), (5, "A" + prose(2).upper(), "", "b", 0), (6, prose(3, 30_000), "", "b", 0), (7, "x # y", "", "b", 0)]
    rows += [(10 + i, " ".join([f"w{k % (5 + 5 * i)}" for k in range(60)]) + rng.choice(["", " |", " ABCDEFGHIJKLMN"]), "", rng.choice("ab"), 0) for i in range(30)]
    rows += [(100 - i, prose(1000), "", "hot", 0) for i in range(50)]  # a large group of copies, the smallest id last
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 101, 1) if i != 4] + [(4, 0, 0), (4, 1, None), (None, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("part", "mask", "n", "state", "letter", "e", "_h", "_id")})
    got = filter_audit.filter_audit(docs, marks)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, good, toxic)
    assert got.count() == 600 * 4 and filter_audit.filter_audit(docs.where("false"), marks).count() == 0


def test_edges_carry_the_orders_through_them():
    lattice = filter_audit.Lattice("ABCD")
    through = Counter((s, f) for s, f, _, _ in lattice.steps)
    assert {(s, f): n for s, f, _, n in lattice.edges} == through and len(lattice.steps) == 24 * 4


# ---- near-duplicate vectors ------------------------------------------------------


def brute_vectors(rows, least=0.9):
    usable = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if usable[i] and usable[j] and len(a) == len(b):
                p, q = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= least:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    parent[top(i)] = top(j)
    groups = {}
    for i, (vid, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(vid)
    least_id = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    return Counter((vid, n, least_id[top(i)], vid == least_id[top(i)]) for i, ((vid, _), n) in enumerate(zip(rows, links)))


def vector_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 12))
    rows = [(i, (centres[i % 8] + rng.normal(0, [0.05, 0.2, 0.35][i % 3], 12)).tolist()) for i in range(200)]
    rows += [(300 - i, centres[0].tolist()) for i in range(40)]  # copies
    rows += [(400 + i, (centres[1] * 10.0 ** (40 * i)).tolist()) for i in range(-4, 5)]  # one direction, far scales
    rows += [(7, centres[2].tolist()), (7, centres[3].tolist()), (None, centres[4].tolist()), (None, centres[4].tolist())]
    rows += [(None, [0.0, 1.0]), (500, [0.0, 2.0]), (501, [1.0, 0.0]), (502, [3.0, 1.0]), (503, [3.0, 2.0])]
    rows += [(600, None), (601, []), (602, [0.0, 0.0]), (603, [1.0, None]), (604, [float("nan"), 1.0]), (605, [float("inf"), 1.0]), (None, None), (606, [-0.0, 2.0])]
    return rows


@pytest.mark.parametrize("block, broadcast, per_bucket", [(2000, 500_000, 1000), (9, 500_000, 1000), (9, 0, 1000), (30, 500_000, 2)])
def test_links_and_components_of_awkward_vectors(spark, monkeypatch, block, broadcast, per_bucket):
    monkeypatch.setattr(hyperplane, "BLOCK", block)
    monkeypatch.setattr(hyperplane, "MAX_BROADCAST_BUCKETS", broadcast)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "u", "n", "h1", "width", "sig", "own", "label", "usable")})
    got = hyperplane.near_duplicates(df, rows_per_bucket=per_bucket, miss=1e-9)
    assert Counter(tuple(r) for r in got.collect()) == brute_vectors(rows)
    assert hyperplane.near_duplicates(df.where("false")).count() == 0


def test_a_class_that_holds_most_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 4 else [float(i % 97), 5.0, 1.0]) for i in range(6000)]
    got = hyperplane.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    by_kind = Counter(tuple(v) for _, v in rows)
    kinds = list(by_kind)
    X = np.array(kinds)
    X /= np.linalg.norm(X, axis=1)[:, None]
    links = (X @ X.T >= 0.9) @ np.array([by_kind[k] for k in kinds]) - 1
    want = dict(zip(kinds, links.astype(int).tolist()))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: want[tuple(v)] for i, v in rows}


def test_recall_at_the_threshold():
    for n in (10, 10_000, 10**6, 10**9):
        bits, tables = hyperplane.plan_tables(n, 0.9)
        same = 1 - np.arccos(0.9) / np.pi
        assert (1 - same**bits) ** tables <= 1e-3 and n / 2**bits <= 1000


# ---- conversations ---------------------------------------------------------------

GOOD = re.compile(r"(s?(ua)+)?\Z")
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    """(role, text) rows in order -> (blank, duplicate, truncated) of each row."""
    out, seen = [], set()
    for role, text in rows:
        last = words(text)[-1][-1] if words(text) else ""
        kind = "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def brute_repair(rows):
    """The cheapest edits by trying all, insertions anywhere."""
    kinds, best = faults(rows), [(3 * len(rows), "D" * len(rows), "")]

    def search(i, cost, audit, initials, lines):
        if cost > best[0][0]:
            return
        if i == len(rows) and GOOD.match(initials):
            best[0] = min(best[0], (cost, audit, "\n".join(lines)))
        for to in "ua":
            search(i, cost + 2, audit + "I", initials + to, [*lines, NAME[to] + ":"])
        if i < len(rows):
            search(i + 1, cost + 3, audit + "D", initials, lines)
            if kinds[i] not in ("b", "d"):
                role, text = rows[i]
                late = kinds[i] == "t"
                search(i + 1, cost + late, audit + "K", initials + (role[:1] or "?"), [*lines, f"{role}:{text}"])
                for to in "ua":
                    search(i + 1, cost + 2 + late, audit + "R", initials + to, [*lines, f"{NAME[to]}:{text}"])

    search(0, 0, "", "", [])
    return best[0]


def plain_repair(rows):
    """The cheapest edits by whole strings, without tree or pruning."""
    state = {"": (0, "", "")}
    kinds = faults(rows)
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    for (role, text), kind in zip(rows, kinds):
        new = {}

        def offer(to, way):
            new[to] = min(new.get(to, way), way)

        for at, (cost, audit, lines) in state.items():
            offer(at, (cost + 3, audit + "D", lines))
            if kind in ("b", "d"):
                continue
            late = kind == "t"
            for put in ("", *(x for x in "ua" if x in steps[at])):
                here = put or at
                c, a, l = (cost + 2, audit + "I", lines + "\n" + NAME[put] + ":") if put else (cost, audit, lines)
                if role[:1] in ("s", "u", "a") and role[:1] in steps[here]:
                    offer(role[:1], (c + late, a + "K", l + f"\n{role}:{text}"))
                for to in "ua":
                    if to in steps[here]:
                        offer(to, (c + 2 + late, a + "R", l + f"\n{NAME[to]}:{text}"))
        state = new
    ends = {"": ("", ""), "a": ("", ""), "u": ("I", "\nassistant:"), "s": ("II", "\nuser:\nassistant:")}
    cost, audit, lines = min((c + 2 * len(ends[s][0]), a + ends[s][0], l + ends[s][1]) for s, (c, a, l) in state.items())
    return cost, audit, lines[1:]


def tree_repair(rows):
    edits = []
    search = conversations.Repair(edits.append)
    widest = seen = 0
    for (role, text), kind in zip(rows, faults(rows)):
        search.row(role, text, kind in ("b", "d"), kind == "t")
        seen += 1
        widest = max(widest, seen - len(edits))
    cost = search.finish()
    return (cost, "".join(e.letter for e in edits), "\n".join(f"{e.role}:{e.text}" for e in edits if e.letter != "D")), widest


def some_rows(rng, n):
    texts = ["Yes.", "No!", "half", " ", "", "a b?", "long text, cut"]
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", "User"]), rng.choice(texts) + rng.choice(["", "", str(rng.random()) + "."])) for _ in range(n)]


def test_repair_against_all_edits():
    rng = random.Random(3)
    for k in range(400):
        rows = some_rows(rng, k % 5)
        got, _ = tree_repair(rows)
        assert got == brute_repair(rows) == plain_repair(rows), rows


def test_repair_of_long_conversations_keeps_little():
    rng = random.Random(4)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(20, 120))
        assert tree_repair(rows)[0] == plain_repair(rows)
    neat = [(("user", "assistant")[i % 2], f"Row {i}.") for i in range(20_000)]
    got, widest = tree_repair(neat)
    assert got[0] == 0 and got[1] == "K" * 20_000 and widest < 20
    told = [(("user", "user", "user", "assistant")[i % 4], f"Row {i}.") for i in range(4001)]
    got, widest = tree_repair(told)
    assert got == plain_repair(told) and widest < 20
    only = [("user", f"Row {i}.") for i in range(1501)]
    assert tree_repair(only)[0] == plain_repair(only)  # unresolved to the last row


def want_report(rows, id_of):
    """Rows of the contract's query from (conv, turn, role, text)."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if id_of else 19
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = set()
    for conv, at in out.items():
        at.sort()
        lines = [(r, t) for _, _, r, t in at]
        turns = [t for known, t, *_ in at if known]
        kinds = Counter(faults(lines))
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, text = plain_repair(lines)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want.add((conv, gaps, kinds["b"], kinds["d"], kinds["t"], odd, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return want


def test_report_of_awkward_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(some_rows(rng, rng.randint(1, 9)))]
    rows += [(c, rng.choice([None, 0, 3, 3, 9]), rng.choice([None, "user", "assistant"]), rng.choice([None, "é😀.", "Hm.", "x" * 10])) for c in (100, 101, None) for _ in range(12)]
    rows += [(102, None, None, None), (103, 5, "user", "One.")] + [(104, t, ("user", "assistant")[t % 2], f"Row {t}." * (1 + 2000 * (t == 7))) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "lost", "nth", "blank", "late", "place")})
    for damaged in (True, False):
        got = conversations.repair_conversations(df, damaged=damaged).collect()
        assert {tuple(r) for r in got} == want_report(rows, damaged) and len(got) == 66
    whole = conversations.repair_conversations(df, output="rows").where("conv_id = 104").orderBy("place").collect()
    assert [(r["place"], r["edit"], r["text"]) for r in whole] == [(t, "K", f"Row {t}." * (1 + 2000 * (t == 7))) for t in range(3000)]
    assert conversations.repair_conversations(df.where("false")).count() == 0


# ---- rows that are equal ---------------------------------------------------------


def repeated_rows(n=10_000):
    """Equal rows as half of the table: one id, no id, and one id with several texts."""
    rows = [(7, "the same words here", "en", "hot", 0)] * (n // 2) + [(None, "no id at all", "en", "hot", 0)] * (n // 4)
    rows += [(8, f"text {i % 50} of one id", "en", "hot", 0) for i in range(n // 4)]
    return rows + [(100 + i, "w " * (1 + i % 40), "en", "abc"[i % 3], 0) for i in range(n)]




@pytest.mark.parametrize("most", [0, 500_000])
def test_mix_takes_equal_rows_one_by_one(spark, monkeypatch, most):
    from sparkclust.llm import common, mixing

    monkeypatch.setattr(mixing, "MAX_BROADCAST", most)
    df = frame(spark, repeated_rows(), clash=False).repartition(7)
    got = mixing.copies(df, common.word_count(F.col("text"))).toPandas()
    taken = (got["size"] * got["n_copies"]).groupby([got["target"], got["source_size"]]).sum()
    assert len(taken) == 4 and all(abs(t - n) <= 40 for (t, _), n in taken.items())
    assert got.groupby(["target", "source_size"])["n_copies"].agg(lambda c: c.max() - c.min()).max() <= 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    per_source = mixed.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).toPandas()
    want = taken.tolist()
    assert all(min(abs(n - t) for t in want) <= 80 for n in per_source["n"])


def test_shards_files_and_packs_split_equal_rows(spark):
    import public_tokenizers

    from sparkclust.llm import bitplane, common, packing, sharding
    from sparkclust.session import scratch_path

    rows = repeated_rows(4000)
    df = common.materialize(frame(spark, rows), "repeated")
    shards = sharding.assign_shards(df)
    assert Counter(r["count"] for r in shards.groupBy("shard").count().collect()) == Counter({200: 40})
    hot = [r["count"] for r in shards.where("doc_id = 7").groupBy("shard").count().collect()]
    assert len(hot) == 40 and max(hot) - min(hot) <= 40
    again = sharding.assign_shards(df.repartition(5))
    assert sorted(map(str, shards.collect())) == sorted(map(str, again.collect()))
    slots = {(r["shard"], r["slot"]) for r in shards.collect()}
    assert slots == {(s, k) for s in range(40) for k in range(200)}
    numbered = common.number_equal_rows(df.select("doc_id", "text", "source"), "copy")
    assert numbered.count() == len(rows) and numbered.where("doc_id = 7").agg(F.count_distinct("copy"), F.max("copy")).first() == (2000, 1999)
    path = scratch_path(spark, "planes")
    manifest = bitplane.write_files(df, path, public_tokenizers.path("byte_bpe_50k.json"), n_files=8)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == len(rows) and len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
    back = bitplane.read_files(manifest, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in back]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r["start"] for r in back][1:] == list(np.cumsum([r["n_tokens"] for r in back])[:-1])
    packed = packing.pack(packing.cut_pieces(df, public_tokenizers.path("word_bpe_49k.json"))).toPandas()
    assert len(packed) == len(rows) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(packed.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_equal_rows_are_numbered_by_many_tasks(spark, monkeypatch, chunk):
    from sparkclust.llm import common

    monkeypatch.setattr(common, "COPIES", chunk)
    df = spark.createDataFrame([(1, "a")] * 10 + [(None, None)] * 7 + [(2, "b")], "id int, t string")
    got = Counter(tuple(r) for r in common.number_equal_rows(df, "copy").collect())
    assert got == Counter([(1, "a", k) for k in range(10)] + [(None, None, k) for k in range(7)] + [(2, "b", 0)])
