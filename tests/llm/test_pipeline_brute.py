"""The pipeline's stages after language ID against plain Python, with repeated rows, null ids and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers import CLASHING, frame, prose, words
from test_corpus_operators import brute_links
from tokenizers import Tokenizer

import corpus_pipeline
from sparkclust.llm import quality


def plain_quality(text):
    """The cleaned text, None if the document is rejected."""
    w = words(text)
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    repeated = len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)})
    lines, lost, kept = text.split("\n"), 0, []
    for line in lines:
        n = len(words(line))
        marks = len(re.findall(r"[#*$%&|<>]", line)) + line.count("!!")
        menu = line.count("|") >= 3 or (n <= 2 and len(lines) > 1 and not re.search(r"[.!?:;…。！？\"'”»)\]]\s*\Z", line))
        boiler = n <= 20 and re.search(quality.BOILERPLATE, line)
        if n and ((marks and marks >= 0.3 * n) or menu or boiler):
            lost += n
        else:
            kept.append(line)
    rejected = len(w) < 50 or 100 * repeated > 50 * len(w) or lost > 0.3 * len(w)
    return None if rejected else "\n".join(kept)


def plain_one_of_each(rows):
    _, groups = brute_links(rows)
    return [min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_mix(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is None, s))
    size = {s: sum(len(words(r[1])) for r in by_source[s]) for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = float(sum(size.values())), set()
    while True:
        level = (total - sum(3.0 * size[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and weight[s] * level > 3.0 * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s in order:
        target = 3.0 * size[s] if s in full else weight[s] * level
        times = int(target // size[s]) if size[s] else 0
        rest, upto = target - times * size[s], 0

        def key(r):
            name = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
            return int(hashlib.md5(f"0|{name}".encode()).hexdigest()[:15], 16)

        for r in sorted(by_source[s], key=key):
            n = len(words(r[1]))
            once_more = upto + n <= rest or (upto <= rest and n > 0 and 2 * (rest - upto) >= n)
            upto += n
            out += [r] * (times + once_more)
    return out


def plain_pieces(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            out[r[0], piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    return out


def first_fit(lengths):
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(2048 - n)
        else:
            room[at] -= n
    return len(room)


def document_rows():
    langs = ("en", "de", "fr")
    rows = [(i, prose(300 + i, 70 + 9 * (i % 11), i % 3), langs[i % 3] if i % 5 else None, (None, "a", "b", "c", "d")[i % 5], i) for i in range(60)]
    rows += [(1000, prose(900, 9_000), "en", "a", 1), (1001, prose(901, 30), "en", "a", 1), (1002, None, "en", "a", 1), (1003, "", None, None, 1), (1004, "12 34", "en", "b", 1)]
    rows += [rows[3]] * 4 + [(None, *rows[4][1:])] * 2 + [(2000, *rows[5][1:]), (-1, *rows[6][1:])]  # repeated rows and copies
    near = rows[7][1].split(" ")
    near[20] = "changed"
    rows += [(3000, " ".join(near), "de", "b", 1)]
    noisy = rows[9][1]
    rows += [(4000 + k, noisy.replace("\n", f"\n{line}\n", 2) + f"\nown words of document {k} make it differ " + prose(950 + k, 80), "en", "c", 1) for k, line in enumerate(("Home | News | Shop | About", "# * # *", "Subscribe to our letter", "Menu", "fine words stay here."))]
    return rows


def test_stages_after_language_id(spark, tmp_path):
    rows = document_rows()
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).write.parquet(path)
    docs = spark.read.parquet(path)
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert sorted(first.columns) == sorted(docs.columns)
    first.write.parquet(str(tmp_path / "first"))
    docs = spark.read.parquet(str(tmp_path / "first"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    now = [tuple(r) for r in docs.select(*names).collect()]
    assert not {1002, 1003, 1004} & {r[0] for r in now} and len(now) > 60

    wanted = {
        "quality_rules": lambda rows: [(r[0], t, r[2], r[3], len(t)) for r in rows if (t := plain_quality(r[1])) is not None],
        "ngram_jaccard": plain_one_of_each,
        "mix_sources": plain_mix,
    }
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert sorted(after.columns) == sorted(docs.columns), name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = wanted[name](now)
        assert Counter(tuple(r) for r in docs.select(*names).collect()) == Counter(now), name
        assert {tuple(r) for r in docs.select(*CLASHING).distinct().collect()} == {tuple(range(len(CLASHING)))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    pieces = plain_pieces(now)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= first_fit([p[3] for p in pieces.elements()])
    # the whole run gives the same pieces
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces


@pytest.mark.parametrize("clash", [False, True])
def test_an_empty_table_passes_all_stages(spark, tmp_path, clash):
    frame(spark, [], clash).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_decision_from_given_weights():
    import numpy as np

    from sparkclust.llm import langid

    rng = np.random.default_rng(3)
    model = langid.Model(["en", "de", "nl", "fr", "es", "xx"])
    n = (len(model.families) if len(model.families) > 1 else 0) + len(model.pairs)
    model.w, model.b = rng.normal(0, 3, (langid.DIM, n)).astype(np.float32), rng.normal(0, 0.1, n)
    texts = [prose(i, 20 + i, i % 3) for i in range(40)] + ["a", "Éa ßø", "x" * 3000, prose(77, 9000)]

    def grams(text):
        letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in f" {text.lower()} ".encode())
        return [letters[i : i + k] for k in (1, 2, 3) for i in range(len(letters) - k + 1) if b"  " not in letters[i : i + k] and letters[i : i + k] != b" "]

    def bucket(g):
        number = int.from_bytes(g, "big")
        return ((number + 1) * 2654435761 % 2**32) >> (32 - langid.DIM.bit_length() + 1)

    def decide(text):
        x = np.zeros(langid.DIM)
        for g in grams(text):
            x[bucket(g)] += 1
        x[bucket(b" ")] = 0
        x = np.sqrt(x)
        x /= np.sqrt((x * x).sum())
        margin = {name: float(x @ model.w[:, k] + model.b[k]) for k, name in enumerate([*model.families, *model.pairs])}
        family = max(model.families, key=lambda f: margin[f])
        sure = lambda m: 1 / (1 + np.exp(-2 * m))
        members = model.members[model.families.index(family)]
        votes, trust = Counter(), Counter()
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                s = sure(margin[a, b])
                votes[a if s >= 0.5 else b] += 1
                trust[a] += s
                trust[b] += 1 - s
        best = max(members, key=lambda m: (votes[m] + trust[m] / (len(members) + 1), -members.index(m)))
        score = sure(margin[family]) * (trust[best] / (len(members) - 1) if len(members) > 1 else 1)
        return best, score

    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        want, sure = decide(text)
        assert lang == want and abs(score - sure) < 1e-3, text[:40]
