"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Each text becomes its set of ``n``-word shingles (64-bit hashes) and a signature of
   ``trees`` labels, each a string of ``depth`` minimum hashes. Texts of one shingle set form a
   class; one representative of each goes on.
2. A tree is a prefix trie over its labels. A link of similarity s shares a prefix of length k in some tree
   with probability ``1 - (1 - s**k)**trees``; the shortest length needed is the longest one at which this bound
   reaches the target at the threshold itself. Representatives that share a prefix of that length meet in a bucket,
   sorted by label, which is a branch of the trie. From there the walk starts with whole labels and shortens the
   prefix step by step: at each length, members under one node that are not connected yet are compared, and those
   whose signatures agree closely (far below the threshold, so borderline pairs pass) are connected.
3. Connected members give candidate components. All pairs of a component are verified on their
   exact shingle sets, in blocks of bounded size, and counted once.
4. Components of the verified links are the groups.

Words are runs of characters outside ASCII white space. A link joins two documents whose
sets have Jaccard similarity >= ``threshold``.

Defined results
* null text or text without a word: no set, group of its own, 0 links.
* fewer than ``n`` words: the whole word sequence is the only shingle.
* very long texts are read whole; equal sets (copies, repeated rows) are linked to each other.
* the group id is the smallest id of the group; rows without an id get a negative number of their own as group id
  unless they are linked to a row with an id. An empty table gives an empty result.
* extra columns are carried by ``keep_one_of_each``, which keeps one row of each group, repeated rows and null ids included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled, stream_groups, table
from .components import SALTS, components
from .encoding import text_bytes, text_slices

N, THRESHOLD = 5, (4, 5)
TREES, DEPTH, TARGET = 24, 7, 0.9995
#: Signature agreement that connects two members of a bucket: five standard deviations under the threshold.
LOOSE = 0.65
#: Members of a bucket compared by one task, and representatives of a component verified by one task and side.
BUCKET_BLOCK, VERIFY_BLOCK = 20_000, 500
#: Up to this many candidate texts are marked by a broadcast of their hashes (182 bytes each on the driver); more by a shuffle join.
#: No other join broadcasts what grows with the input.
MAX_BROADCAST = 500_000
#: Bytes of text whose shingles are worked on at once.
SLICE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the texts, text after text (ascending), and their number per text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = ends - starts
    weights = np.random.default_rng(11).integers(0, 2**63, max(256, int(size.max())), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = int(size.sum())
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    letters = buf[~space].astype(np.uint64) + np.uint64(1)
    words = _mix(np.add.reduceat(letters * weights[place], np.cumsum(size) - size) + size.astype(np.uint64))
    text_end = np.cumsum(lens + 1)
    owner = np.searchsorted(text_end, starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    # a shingle at each word that has n - 1 more behind it in its text; short texts give one from what they have
    last = np.cumsum(n_words)
    at = np.arange(len(words))
    room = last[owner] - at
    first = (last - n_words)[owner] == at
    keep = (room >= n) | (first & (room < n))
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = padded[k : k + len(words)] * np.uint64(2 * (k * 0x5851F42D4C957F2D % 2**62) + 1)
        h += np.where(room > k, part, np.uint64(0))
    h, owner = _mix(h[keep]), owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=len(texts))


def signatures(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """``width`` minimum hashes (16 bits kept of each) of every nonempty set."""
    rng = np.random.default_rng(23)
    flips = rng.integers(0, 2**32, width, dtype=np.uint64).astype(np.uint32)
    odds = (rng.integers(0, 2**31, width, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    full = counts[counts > 0]
    out = np.empty((len(full), width), np.uint16)
    ends = np.cumsum(full)
    lo, hi = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    row = 0
    while row < len(full):  # stretches of sets that fit the processor's cache
        a = ends[row] - full[row]
        stop = max(row + 1, int(np.searchsorted(ends, a + 50_000, "right")))
        cut = (ends[row:stop] - full[row:stop]) - a
        x, y = lo[a : ends[stop - 1]], hi[a : ends[stop - 1]]
        for k in range(width):
            low = np.minimum.reduceat(((x ^ flips[k]) * odds[k]) ^ y, cut)
            out[row:stop, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
        row = stop
    return out


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: uid, id, th (text hash), class key c1 c2, n (set size), sig, near (the low byte of each number of sig)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))

    def run(frames):
        import pyarrow as pa

        for f in text_slices(frames, "text", SLICE):
            texts = text_bytes(f.column("text"))
            if texts:
                h, n = shingle_sets(texts)
                sig = signatures(h, n, TREES * DEPTH)
                cut = np.concatenate([[0], np.cumsum(n)])
                run_sum = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
                run_sq = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h + np.uint64(1)), dtype=np.uint64)])
                c1, c2 = (run_sum[cut[1:]] - run_sum[cut[:-1]]).view(np.int64), (run_sq[cut[1:]] - run_sq[cut[:-1]]).view(np.int64)
                packed, near = np.full(len(texts), None, object), np.full(len(texts), None, object)
                packed[n > 0] = [s.tobytes() for s in sig]
                near[n > 0] = [s.tobytes() for s in sig.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [f.column("id"), f.column("th"), pa.array(c1), pa.array(c2), pa.array(n, pa.int32()), pa.array(packed, pa.binary()), pa.array(near, pa.binary())],
                    ["id", "th", "c1", "c2", "n", "sig", "near"],
                )

    sketched = rows.mapInArrow(run, "id long, th long, c1 long, c2 long, n int, sig binary, near binary")
    return materialize(sketched.withColumn("uid", F.monotonically_increasing_id()), "join-sketch")


def prefix_length(target: float = TARGET, s: float = THRESHOLD[0] / THRESHOLD[1]) -> int:
    """The longest prefix by which links of similarity ``s`` are found with probability ``target``."""
    return max((k for k in range(1, DEPTH + 1) if 1 - (1 - s**k) ** TREES >= target), default=1)


def walk(sig: np.ndarray, label: np.ndarray, longest: int, shortest: int, need: int) -> list[tuple[int, int]]:
    """Edges that connect close members of a branch, from prefixes of length ``longest`` down to ``shortest``.

    ``label`` (rows sorted) has the labels of the branch's tree; members are close if ``need`` numbers of ``sig`` agree.
    """
    group = np.arange(len(sig))  # what is connected so far
    edges = []
    for length in range(longest, shortest - 1, -1):
        turns = np.flatnonzero((label[1:, :length] != label[:-1, :length]).any(1)) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(sig)]):
            if b - a < 2 or (group[a:b] == group[a]).all():
                continue
            left = np.arange(a, b)
            while len(left) > 1:
                mine = group[left] == group[left[0]]
                queue, left = left[mine].tolist(), left[~mine]
                root = queue[0]
                while queue and len(left):
                    at = queue.pop()
                    near = (sig[left] == sig[at]).sum(1) >= need
                    if near.any():
                        # with a close member comes all that it is connected with
                        for g in np.unique(group[left[near]]).tolist():
                            of = group[left] == g
                            reached, left = left[of], left[~of]
                            edges.append((root, int(reached[0])))
                            queue.extend(reached.tolist())
                            group[group == g] = group[root]
    return edges


def _bucket_edges(reps: DataFrame, depth: int, target: float = TARGET) -> DataFrame:
    """Edges (a, b) that connect close members under the nodes of all trees, from labels of ``depth`` numbers on."""
    shortest = min(depth, prefix_length(target))

    def prefixes(frames):
        import pyarrow as pa

        salt = np.random.default_rng(5).integers(0, 2**63, (TREES, shortest + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tree = np.arange(TREES, dtype=np.int32)
        for f in frames:
            sig = np.frombuffer(b"".join(f.column("sig").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)[:, :, :shortest].astype(np.uint64)
            key = _mix((sig * salt[None, :, :shortest]).sum(2, dtype=np.uint64) + salt[None, :, shortest]).view(np.int64)
            uid = np.repeat(f.column("uid").to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.tile(tree, f.num_rows)), pa.array(uid)], ["key", "tree", "uid"])

    keyed = materialize(reps.select("uid", "sig").mapInArrow(prefixes, "key long, tree int, uid long"), "join-prefixes")
    shared = materialize(keyed.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "join-nodes")
    # nodes of very many members are broadcast or salted, so their members stay where they are
    large = shared.where(F.col("m") > BUCKET_BLOCK)
    on = F.col("key") == F.col("_key")
    n_large = large.count()
    if not n_large:
        met = keyed.join(shuffled(shared), on)
    elif n_large <= MAX_BROADCAST:
        met = keyed.join(F.broadcast(large), on).union(keyed.join(F.broadcast(large), on, "left_anti").join(shuffled(shared.where(F.col("m") <= BUCKET_BLOCK)), on))
    else:
        salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(16)).cast("int")).join(shuffled(salted), on & (F.col("salt") == F.col("_salt")))
    members = met.select("key", "tree", "uid", "m").join(shuffled(reps.select("uid", F.col("near").alias("sig"))), "uid")  # one byte a number is enough to tell who is close
    # a bucket beyond the block size is compared block against block
    n_blocks = F.ceil(F.col("m") / BUCKET_BLOCK).cast("int")
    block = F.pmod(F.xxhash64("uid"), n_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    dealt = members.select("key", "tree", "uid", "sig", block.alias("blk"), other.alias("oth")).select("key", "tree", F.least("blk", "oth").alias("i"), F.greatest("blk", "oth").alias("j"), "uid", "sig")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "uid")

    def connect(frames):
        import pyarrow as pa

        need = int(np.ceil(LOOSE * TREES * DEPTH))
        a, b = [], []
        for _, group in stream_groups(frames, ["key", "i", "j"]):
            uid, tree = group.column("uid").to_numpy(), group.column("tree")[0].as_py()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(uid), -1)
            label = sig[:, tree * DEPTH : (tree + 1) * DEPTH]
            order = np.lexsort(label.T[::-1])
            uid, sig, label = uid[order], sig[order], label[order]
            for x, y in walk(sig, label, depth, shortest, need):
                a.append(int(uid[x]))
                b.append(int(uid[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(connect, "a long, b long")


def _similar(sets: list[np.ndarray], weight: np.ndarray, split: int | None):
    """Pairs (i < j) of linked sets with their similarity; with ``split``, pairs across it only."""
    p, q = THRESHOLD
    size = np.array([len(s) for s in sets], np.int64)
    code, uniques = pd.factorize(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(code, minlength=len(uniques)) > 1
    column = np.cumsum(often) - 1
    code, owner = column[code[often[code]]], owner[often[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    split = split or 0
    rows, cols = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = np.zeros((len(size[rows]), len(size[cols])), np.float32)
    step = 4096
    for first in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(code, [first, first + step])
        dense = np.zeros((len(sets), step), np.float32)
        dense[owner[lo:hi], code[lo:hi] - first] = 1
        both += dense[rows] @ dense[cols].T
    both = np.rint(both).astype(np.int64)
    union = size[rows][:, None] + size[cols][None, :] - both
    linked = q * both >= p * union
    if not split:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    return i, j + split, both[i, j] / union[i, j]


def _with_label(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (node, label) with the columns of their label in ``labels`` (_l, ...): its row is dealt out to SALTS parts of the nodes."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(shuffled(labels.select("*", salts)), (F.col("label") == F.col("_l")) & (F.col("salt") == F.col("_salt")))


def _verify(docs: DataFrame, reps: DataFrame, comp: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (kind, a, b, links): kind 0 counts links of a, kind 1 is a tree edge."""
    sizes = comp.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("m"))
    cand = _with_label(comp, sizes).join(shuffled(reps.select("uid", "id", "th", "copies")), F.col("node") == F.col("uid"))
    cand = materialize(cand.select("label", "m", "uid", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("rid"), F.col("th").alias("rth"), "copies"), "join-candidates")
    marked = F.broadcast(cand) if cand.count() <= MAX_BROADCAST else shuffled(cand)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("tid"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    picked = texts.join(marked, (F.col("th") == F.col("rth")) & (F.col("tid") == F.col("rid"))).select("label", "m", "uid", "copies", "text")

    def to_sets(frames):
        import pyarrow as pa

        for f in text_slices(frames, "text", SLICE):
            h, n = shingle_sets(text_bytes(f.column("text")))
            cut = np.concatenate([[0], np.cumsum(n)])
            sets = pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in ("label", "m", "uid", "copies")], sets], ["label", "m", "uid", "copies", "shingles"])

    sets = picked.mapInArrow(to_sets, "label long, m long, uid long, copies long, shingles binary")
    n_blocks = F.ceil(F.col("m") / VERIFY_BLOCK).cast("int")
    block = F.pmod(F.xxhash64("uid"), n_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    dealt = sets.select("label", "uid", "copies", "shingles", block.alias("blk"), other.alias("oth"))
    dealt = dealt.select("label", F.least("blk", "oth").alias("i"), F.greatest("blk", "oth").alias("j"), "blk", "uid", "copies", "shingles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j", "blk", "uid")

    def verify(frames):
        import pyarrow as pa

        rows: list[tuple] = []

        def batch():
            cols = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "a", "b", "links"])

        for (_, i, j), group in stream_groups(frames, ["label", "i", "j"]):
            uid = group.column("uid").to_numpy()
            fresh = np.concatenate([[True], uid[1:] != uid[:-1]])  # repeated rows of a representative
            at = np.flatnonzero(fresh)
            uid, copies, blk = uid[at], group.column("copies").to_numpy()[at], group.column("blk").to_numpy()[at]
            raw = group.column("shingles")
            sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in at]
            split = None if i == j else int((blk == i).sum())
            if len(sets) < 2 or split == 0 or split == len(sets):
                continue
            x, y, _ = _similar(sets, copies, split)
            links = np.bincount(x, copies[y], len(uid)) + np.bincount(y, copies[x], len(uid))
            for k in np.flatnonzero(links):
                rows.append((0, int(uid[k]), 0, int(links[k])))
            parent = list(range(len(uid)))

            def top(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for u, v in zip(x.tolist(), y.tolist()):
                u, v = top(u), top(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    rows.append((1, int(uid[u]), int(uid[v]), 0))
            if len(rows) > 50_000:
                yield batch()
                rows = []
        yield batch()

    return materialize(dealt.mapInArrow(verify, "kind int, a long, b long, links long"), "join-verified")


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: uid, id, th (text hash), group_id, n_links, first_uid.

    ``first_uid`` is the uid of the group's first row (smallest id, null ids last); null for rows without a word.
    """
    sketch = _sketch(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid", "th", "sig", "near")).alias("r")
    classes = sketch.where("n > 0").groupBy("c1", "c2", "n").agg(first, F.count(F.lit(1)).alias("copies"))
    reps = materialize(classes.select("c1", "c2", "n", "copies", "r.id", "r.uid", "r.th", "r.sig", "r.near"), "join-classes")
    verified = _verify(docs, reps, components(_bucket_edges(reps, DEPTH)), id_col, text_col)
    links = verified.where("kind = 0").groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("others"))
    groups = components(verified.where("kind = 1").select("a", "b"))
    with_ids = groups.join(shuffled(reps.select("uid", "id")), F.col("node") == F.col("uid"))
    names = with_ids.groupBy(F.col("label").alias("_l")).agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("f"))
    named = _with_label(groups, names).select("node", "label", "least", F.col("f.uid").alias("first"))
    per_class = (
        reps.join(shuffled(named), F.col("uid") == F.col("node"), "left").join(shuffled(links), F.col("uid") == F.col("_a"), "left")
        .select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("n").alias("_n"),
                F.coalesce("least", "id", -1 - F.coalesce("label", "uid")).alias("group_id"),
                (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first", "uid").alias("first_uid"))
    )
    same = (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")) & (F.col("n") == F.col("_n"))
    worded = sketch.where("n > 0").select("uid", "id", "th", "c1", "c2", "n").join(shuffled(per_class), same).select("uid", "id", "th", "group_id", "n_links", "first_uid")
    empty = sketch.where("n = 0").select("uid", "id", "th", F.coalesce("id", -1 - F.col("uid")).alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("first_uid"))
    return worded.union(empty)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of ``docs``, that of its smallest id (null ids last); all columns stay.

    Rows of one id and text are repeated rows, told apart by nothing but their other columns: of the survivor's, the one
    whose row has the smallest hash stays. Rows without a word are groups of their own and stay.
    """
    groups = join_groups(docs, id_col=id_col, text_col=text_col, **options).where("first_uid is not null and n_links > 0")
    keys = groups.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.max(F.col("uid") == F.col("first_uid")).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    keys = materialize(keys.where("not _stays or _n > 1").select("_id", "_th", "_stays"), "join-lost")
    n = {r["_stays"]: r["n"] for r in keys.groupBy("_stays").agg(F.count(F.lit(1)).alias("n")).collect()}
    marked = F.broadcast(keys) if sum(n.values()) <= MAX_BROADCAST else shuffled(keys)  # keeps whole texts out of the shuffle
    rest = docs.withColumns({"_key": F.xxhash64(F.col(text_col)), "_no": F.col(id_col).cast("long")})
    on = F.col("_no").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th"))
    single = rest.join(marked, on, "left_anti").drop("_key", "_no")
    if not n.get(True):
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = rest.join(marked.where("_stays"), on, "left_semi").groupBy("_no", "_key").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return single.union(again.select("_row.*"))


def op1_forest(spark, sf_dir):
    out = join_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "n_links")
