"""The prefix tries of the n-gram join: links at the threshold, popular prefixes, the walk."""

import random

import numpy as np
import pytest
from helpers import frame
from test_corpus_operators import brute_links

from sparkclust.llm import common, components, ngram_join


def test_the_bound_is_met_at_the_threshold_itself():
    k = ngram_join.prefix_length()
    assert 1 - (1 - 0.8**k) ** ngram_join.TREES >= ngram_join.TARGET > 1 - (1 - 0.8 ** (k + 1)) ** ngram_join.TREES


@pytest.mark.parametrize("block, broadcast", [(20_000, 500_000), (15, 500_000), (15, 0)])
def test_links_that_just_reach_the_threshold(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", broadcast)
    rng = random.Random(7)
    rows = []
    for family in range(60):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((family * 10, " ".join(base), "", "", 0))
        for k, changes in enumerate((2, 2, 3)):  # two or three words changed: 10 to 15 of 116 shingles
            w = list(base)
            for at in rng.sample(range(10, 110), changes):
                w[at] = f"x{family}{k}{at}"
            rows.append((family * 10 + 1 + k, " ".join(w), "", "", 0))
    sets = {r[0]: {tuple(r[1].split()[i : i + 5]) for i in range(116)} for r in rows}
    near = [len(sets[f * 10] & sets[f * 10 + k]) / len(sets[f * 10] | sets[f * 10 + k]) for f in range(60) for k in (1, 2, 3)]
    assert sum(0.80 <= j <= 0.86 for j in near) > 40
    links, groups = brute_links(rows)
    got = {r["id"]: r for r in ngram_join.join_groups(frame(spark, rows, clash=False)).collect()}
    assert [got[r[0]]["n_links"] for r in rows] == links
    assert len({g["group_id"] for g in got.values()}) == len(groups)


def test_the_walk_connects_what_is_close_under_shorter_prefixes():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 60_000, (6, 28)).astype(np.uint16)
    sig = np.repeat(base, 5, axis=0)
    for i in range(len(sig)):  # members of a family differ in some numbers
        at = rng.choice(28, i % 5, replace=False)
        sig[i, at] = rng.integers(0, 60_000, len(at))
    sig[:, :2] = 7  # all under one node of length 2
    label = sig[:, :7]
    order = np.lexsort(label.T[::-1])
    edges = ngram_join.walk(sig[order], label[order], 7, 2, 18)
    parent = list(range(30))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[top(order[a])] = top(order[b])
    assert len({top(i) for i in range(30)}) == 6 and len(edges) == 24
    assert all(top(i) == top(i // 5 * 5) for i in range(30))


@pytest.mark.parametrize("most", [0, 500_000])
def test_the_driver_gets_no_rows_but_those_counted_before(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", most)
    plans = {}

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, name)

    monkeypatch.setattr(ngram_join, "materialize", kept)
    monkeypatch.setattr(components, "materialize", kept)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(f"f{i // 3}{w}" for w in base[: 100 - i % 3]), "en", "a", 1) for i in range(30)]
    links, groups = brute_links(rows)
    out = ngram_join.join_groups(frame(spark, rows, clash=False))
    plans["result"] = [out._jdf.queryExecution().executedPlan().toString()]
    got = {r["id"]: r for r in out.collect()}
    assert [got[r[0]]["n_links"] for r in rows] == links and len({g["group_id"] for g in got.values()}) == len(groups) == 10
    # these tables are far below Spark's threshold: what isn't asked for by its count would be broadcast by its estimate
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 2**20
    found = {name: sum(p.count("BroadcastHashJoin") for p in of) for name, of in plans.items()}
    assert found.pop("join-verified") == (1 if most else 0) and not any(found.values()), found
    assert sum(p.count("SortMergeJoin") for p in plans["cc-round"]) >= 4


def test_salted_nodes_are_dealt_out(spark):
    edges = spark.range(1, 51).selectExpr("id AS u", "0L AS v")  # ranges: Spark knows how small they are
    least = spark.range(1, 51).selectExpr("id AS _u", "0L AS m")
    met = components._with_least(edges, least)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["u"], r["v"], r["m"]) for r in met.collect()) == [(i + 1, 0, 0) for i in range(50)]


def test_members_of_a_large_group_are_dealt_out(spark):
    nodes = spark.range(64).selectExpr("id AS node", "0L AS label").union(spark.range(100, 101).selectExpr("id", "99L"))
    labels = spark.range(3).selectExpr("element_at(array(0L, 99L, 7L), int(id) + 1) AS _l", "element_at(array('a', 'b', 'c'), int(id) + 1) AS m")
    met = ngram_join._with_label(nodes, labels)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    rows = met.collect()
    assert sorted((r["node"], r["m"]) for r in rows) == [(i, "a") for i in range(64)] + [(100, "b")]
    assert len({r["salt"] for r in rows if r["m"] == "a"}) > components.SALTS // 2
