"""Operators over documents on awkward rows, against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward_rows, frame, prose, words
from pyspark.sql import functions as F

from sparkclust.llm import bitplane, common, langid, lmscore, mixing, ngram_join, packing, quality, sharding
from sparkclust.session import scratch_path


@pytest.fixture(scope="module")
def docs(spark):
    return common.materialize(frame(spark, awkward_rows()), "awkward")


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ---- n-gram join -------------------------------------------------------------


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    sets = [shingles(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    return links, groups


def test_join_on_awkward_rows(spark, docs):
    rows = awkward_rows()
    links, groups = brute_links(rows)
    got = ngram_join.join_groups(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["id"], r["n_links"]) for r in got) == Counter((r[0], n) for r, n in zip(rows, links))
    ids = {r["id"]: r["group_id"] for r in got if r["id"] is not None}
    for members in groups.values():
        named = [rows[i][0] for i in members if rows[i][0] is not None]
        assert all(ids[i] == min(named) for i in named)
    nameless = [r["group_id"] for r in got if r["id"] is None]
    assert all(g is not None and g < 0 for g in nameless) and len(set(nameless)) == 2


def test_join_near_copies_blocks_and_shared_passages(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage = prose(5, 60)
    rows = [(i, prose(1000 + i, 80) + "\n" + passage, "en", "a", 0) for i in range(25)]  # a shared passage is no link
    base = prose(7, 200).split(" ")
    for i in range(40):  # near copies, similar to each other in different degrees
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"x{i}_{k}"
        rows.append((100 + i, " ".join(w), "en", "a", 0))
    links, groups = brute_links(rows)
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 9)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", 0)
    frame_ = frame(spark, rows)
    got = {r["id"]: r for r in ngram_join.join_groups(frame_).collect()}
    assert [got[r[0]]["n_links"] for r in rows] == links
    assert len({g["group_id"] for g in got.values()}) == len(groups)
    kept = ngram_join.keep_one_of_each(frame_)
    assert kept.columns == frame_.columns and kept.count() == len(groups)


@pytest.mark.parametrize("most", [0, ngram_join.MAX_BROADCAST])
def test_one_row_of_each_group_whatever_the_ids(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", most)
    near = [prose(70).split(" ") for _ in range(4)]
    for k, w in enumerate(near):
        w[10] = f"near{k}"
    near = [" ".join(w) for w in near]
    rows = [(1, prose(60), "en", "a", 0)] * 3 + [(2, prose(60), "en", "b", 0)] * 2  # repeated rows with the smallest id
    rows += [(None, prose(61), "en", s, 0) for s in "aab"] + [(None, None, "en", "a", 0)] * 2 + [(9, " ", "en", "a", 0)] * 2
    rows += [(3, near[0], "en", "a", 0), (3, near[1], "en", "a", 0), (None, near[2], "en", "a", 0), (4, near[3], "en", "a", 0)]  # near copies under one id
    rows += [(1, prose(62), "en", "a", 0), (5, prose(62), "en", "a", 0)]  # an id of two groups
    _, groups = brute_links(rows)
    got = Counter(tuple(r) for r in ngram_join.keep_one_of_each(frame(spark, rows, clash=False)).collect())
    assert sum(got.values()) == len(groups) == 8 and not got - Counter(rows)
    for members in groups.values():
        named = [rows[i][0] for i in members if rows[i][0] is not None]
        assert {r[0] for r in got if r in {rows[i] for i in members}} == {min(named, default=None)}


def test_shorter_prefixes_until_the_target(spark, monkeypatch):
    depths = []
    real = ngram_join._bucket_edges
    monkeypatch.setattr(ngram_join, "_bucket_edges", lambda reps, depth: depths.append(depth) or real(reps, depth))
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "", "", 0), (1, " ".join(base[:85] + ["a"] + base[86:150] + ["b"] + base[151:]), "", "", 0), (2, " ".join([f"v{i}" for i in range(90)]), "", "", 0)]
    df = frame(spark, rows, clash=False)
    assert [r["n_links"] for r in sorted(ngram_join.join_groups(df).collect(), key=lambda r: r["id"])] == brute_links(rows)[0]
    assert depths[0] == ngram_join.DEPTH and depths == sorted(depths, reverse=True)


# ---- mixing ------------------------------------------------------------------


def test_mix_on_awkward_rows(docs):
    rows = awkward_rows()
    got = mixing.copies(docs, common.word_count(F.col("text"))).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(0 <= r["n_copies"] <= 3 for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["n_copies"] for r in got)


def test_mix_hot_source_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(4000)]
    got = mixing.copies(frame(spark, rows), common.word_count(F.col("text"))).toPandas()
    taken = (got["size"] * got["n_copies"]).groupby([got["target"], got["source_size"]]).sum()
    assert len(taken) == 6 and all(abs(t - n) <= 60 for (t, _), n in taken.items())
    again = mixing.copies(frame(spark, rows), common.word_count(F.col("text"))).toPandas()
    assert (got.sort_values("doc_id")["n_copies"].to_numpy() == again.sort_values("doc_id")["n_copies"].to_numpy()).all()


# ---- language identification -------------------------------------------------


def test_language_on_awkward_rows(docs):
    out = langid.identify(docs).collect()
    assert len(out) == len(awkward_rows())
    for r in out:
        lettered = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] != "und") == lettered and 0 <= r["score"] <= 1
    sure = [r for r in out if (r["row"]["doc_id"] or 0) >= 20]
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in sure]) >= 0.9


def test_language_held_out_accuracy(spark):
    from conftest import SF_MID

    got = langid.op4_langid(spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_language_with_nothing_to_learn(spark):
    df = frame(spark, [(0, "abc", None, "a", 0), (1, None, "en", "a", 0)])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(df).collect()} == {("und", 0.0)}
    one = frame(spark, [(1, "abc", "xx", "a", 0), (2, "abd", "xx", "a", 0)])
    assert {r["lang_pred"] for r in langid.predict(one, langid.train(one)).collect()} == {"xx"}


def test_any_number_of_languages(spark):
    import random

    langs = "en de nl fr es ru uk fi lt ga tr hi ar".split() + [f"x{k}" for k in range(17)]
    rows = []
    for k, lang in enumerate(langs):
        rng = random.Random(k)
        stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(40)), lang, "a", 0) for i in range(12)]
    out = langid.identify(frame(spark, rows, clash=False)).collect()
    assert len(out) == len(rows) and np.mean([r["lang_pred"] == r["row"]["lang"] for r in out]) >= 0.95


# ---- quality rules -----------------------------------------------------------


def test_quality_on_awkward_rows(docs):
    q = docs.select("doc_id", "text", F.explode(F.array(quality.quality(F.col("text")))).alias("v")).collect()
    for r in q:
        w = words(r["text"])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r["v"]["n_words"], r["v"]["word_chars"], r["v"]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)), r["doc_id"]
        if len(w) < 50:
            assert r["v"]["base_failed"] and not r["v"]["kept"]
    assert quality.clean_documents(docs).columns == docs.columns


@pytest.mark.parametrize(
    "line, fails",
    [
        ("All rights reserved.", True), ("Home | About | Contact | Help", True), ("buy### now$$$ it%%% works***", True), ("WOW!! SO!! GOOD!!", True),
        ("This sentence has one | bar and ends well.", False), ("Copyright law is long and this line of prose goes on well past the twenty words that a notice has in such a corpus.", False),
        ("Home", True), ("No.", False), ("", False),
    ],
)
def test_line_rules(spark, line, fails):
    body = prose(3, 100)
    df = spark.createDataFrame([(body + "\n" + line,)], "text string")
    v = df.select(quality.quality(F.col("text")).alias("v")).first()["v"]
    assert v["kept"] and v["cleaned"] == (body if fails else body + "\n" + line)


def test_documents_that_lose_too_much_are_rejected(spark):
    menu = "\n".join(" | ".join(f"item{i}{j}" for j in range(8)) for i in range(10))
    df = frame(spark, [(1, prose(4, 100) + "\n" + menu, "en", "a", 0), (2, prose(5, 400) + "\n" + menu, "en", "a", 0)])
    assert [(r["doc_id"], "item" in r["text"]) for r in quality.clean_documents(df).collect()] == [(2, False)]


# ---- sharding ----------------------------------------------------------------


def test_shards_on_awkward_rows(docs):
    rows = awkward_rows()
    got = sharding.assign_shards(docs, n_shards=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_match_the_mixture(spark, tmpdir_path):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else ("rare" if i % 6 else None), 0) for i in range(6000)]
    got = sharding.assign_shards(frame(spark, rows, clash=False), 10).toPandas()
    for _, shard in got.groupby("shard"):
        share = shard["source"].fillna("null").value_counts(normalize=True)
        assert abs(share["hot"] - 2 / 3) < 0.01 and abs(share["rare"] - 1 / 6) < 0.01
    path = f"{tmpdir_path}/shards"
    sharding.write_shards(frame(spark, rows), path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 6000 and back.select("_shard").distinct().count() == 4


# ---- token files and packing --------------------------------------------------


def encoded(name, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = encoded.__dict__.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("kind", [bitplane.BYTE, bitplane.BIT])
def test_bitplane_files(spark, docs, kind):
    import public_tokenizers

    path = scratch_path(spark, "test-planes")
    manifest = bitplane.write_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), kind=kind, block_ids=1000, n_files=3)
    got = sorted(bitplane.read_files(manifest, path).collect(), key=lambda r: r["start"])
    ids = [(r[0], encoded("byte_bpe_50k.json", r[1])) for r in awkward_rows()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in ids)
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_bitplane_random_access(tmp_path):
    ids = np.random.default_rng(0).integers(0, 2**32, 2500, dtype=np.uint64).astype(np.uint32)
    from pyarrow import fs

    name = str(tmp_path / "x.bplane")
    with fs.LocalFileSystem().open_output_stream(name) as sink:
        w = bitplane.Writer(sink, bitplane.BIT, 1000)
        w.append(ids, np.array([7]), np.array([False]), np.array([2500]))
        w.close()
    with fs.LocalFileSystem().open_input_file(name) as source:
        r = bitplane.Reader(source)
        assert [r.block(k).tolist() for k in (2, 0, 1)] == [ids[2000:].tolist(), ids[:1000].tolist(), ids[1000:2000].tolist()]


def test_packing_on_awkward_rows(docs):
    import public_tokenizers

    got = packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).toPandas()
    want = Counter()
    for r in awkward_rows():
        t = encoded("word_bpe_49k.json", r[1])
        for k in range(0, len(t), 2048):
            want[r[0] if r[0] is not None else -1, k // 2048, k, len(t[k : k + 2048]), zlib.crc32(np.array(t[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def one_at_a_time(lengths, full, rule):
    """Vector best-fit of single pieces, largest first, among all open bins."""
    full = np.array(full, float)
    weights = np.array([1.0, 0.05, 0.05]) / full**2
    room, n = np.empty((sum(lengths.values()), 3)), 0
    for length in sorted(lengths.elements(), reverse=True):
        need = np.array([length, 1, length * length], float)
        fits = np.flatnonzero((room[:n] >= need).all(1))
        if len(fits):
            after = room[fits] - need
            best = fits[np.argmin(after**2 @ weights if rule == "norm" else -(room[fits] * need) @ weights)]
        else:
            best, n = n, n + 1
            room[best] = full
        room[best] -= need
    return n


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = np.random.default_rng(5)
    lengths = Counter(np.minimum(1 + rng.geometric(0.01, 6_000), 512).tolist())
    runs, bins = packing.pack_lengths(lengths, 512, max_docs=6, max_cost=120_000 + 512 * 512, rule=rule)
    load = np.zeros((bins, 3), np.int64)
    placed = Counter()
    for length, _, per_bin, n, first, offset in runs:
        assert (load[first : first + n, 0] == offset).all()
        load[first : first + n] += np.array([length, 1, length * length]) * per_bin
        placed[length] += per_bin * n
    assert placed == lengths and load.max(0).tolist() <= [512, 6, 120_000 + 512 * 512] and (load[:, 0] > 0).all()
    assert bins <= 1.02 * one_at_a_time(lengths, [512, 6, 120_000 + 512 * 512], rule)


def test_packing_by_tokens_alone_is_tight():
    rng = np.random.default_rng(6)
    lengths = Counter(np.minimum(1 + rng.geometric(0.004, 30_000), 2048).tolist())
    _, bins = packing.pack_lengths(lengths, 2048)
    assert bins <= 1.01 * -(-sum(n * c for n, c in lengths.items()) // 2048)


# ---- language-model scores ----------------------------------------------------


def test_scores_on_awkward_rows_both_ways(spark, docs, monkeypatch):
    target = F.col("source") == "b"
    one = lmscore.score_documents(docs, target).collect()
    monkeypatch.setattr(lmscore, "MAX_BROADCAST", 0)
    two = lmscore.score_documents(docs, target).collect()

    def shown(rows):
        return sorted((r["doc_id"] or -1, r["n_tokens"], *(None if r[c] is None else round(r[c], 9) for c in ("loss_target", "score"))) for r in rows)

    assert repr(shown(one)) == repr(shown(two)) and len(one) == len(awkward_rows())
    by = {r["doc_id"]: r for r in one}
    assert by[1]["n_tokens"] == 0 and by[1]["score"] is None and by[8]["score"] < by[20]["score"]
    assert by[8]["n_tokens"] == len(next(r[1] for r in awkward_rows() if r[0] == 8))


# ---- empty tables --------------------------------------------------------------


def test_empty_tables(spark, empty):
    import public_tokenizers

    assert ngram_join.join_groups(empty).count() == 0
    assert ngram_join.keep_one_of_each(empty).columns == empty.columns
    assert mixing.copies(empty, common.word_count(F.col("text"))).count() == 0
    assert langid.identify(empty).count() == 0
    assert quality.clean_documents(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    path = scratch_path(spark, "test-empty")
    assert bitplane.read_files(bitplane.write_files(empty, path, public_tokenizers.path("byte_bpe_50k.json")), path).count() == 0
    assert packing.pack(packing.cut_pieces(empty, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert lmscore.score_documents(empty, F.lit(True)).count() == 0
