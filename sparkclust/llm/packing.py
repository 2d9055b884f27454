"""Vector best-fit packing of token pieces into sequences.

Documents are encoded, get an end id, and are cut into pieces of at most
``capacity`` tokens. A sequence has three capacities: tokens, documents, and
attention cost (the sum of squared piece lengths). Pieces of one length are
alike, so bins are packed over the histogram of lengths: at most ``capacity``
rows reach the driver, whatever the corpus holds. Lengths go in descending
order; the bins that fit under every constraint compete by the weighted norm
of what they would have left (``rule="norm"``) or by the weighted dot product of
need and room (``rule="dot"``). Bins of equal room are handled together, so the
work depends on the number of different lengths, not of pieces. Then every
piece finds its place from its length and its rank among the pieces of that
length: a search in a table of at most a few runs per length.

Defined results
* null or empty text: the end id alone, a piece of 1 token; very long texts are encoded whole and cut.
* pieces of equal length are interchangeable; they are ranked by a hash of id, piece, ids and stored row number,
  so equal pieces spread over the ranking's buckets like any others.
* repeated rows and null ids are packed like any other; an empty table gives an empty result.
* extra columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, materialize, rank_in_group, table
from .encoding import encoder, text_bytes, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids`` on request)."""

    def run(frames):
        import pyarrow as pa

        enc = encoder(vocab)
        for frame in text_slices(frames, "text", encodes=True):
            ids, texts = frame.column("doc_id"), text_bytes(frame.column("text"))
            if texts:
                flat, counts = enc.encode(texts)
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                per_doc = -(-counts // capacity)
                doc = np.repeat(np.arange(len(texts)), per_doc)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                parts = [flat[x : x + n] for x, n in zip(at.tolist(), length.tolist())]
                cols = [
                    ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_lengths(counts: dict[int, int], capacity: int = 2048, max_docs: int = 2048, max_cost: int | None = None,
                 weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[list[tuple], int]:
    """Pack a histogram of lengths; returns runs and the number of bins.

    A run (length, first_rank, per_bin, bins, first_bin, offset) places the
    pieces of that length with ranks first_rank .. first_rank + per_bin * bins - 1:
    ``per_bin`` of them, one after another from ``offset``, into each of ``bins`` bins.
    """
    full = np.array([capacity, max_docs, max_cost or capacity * capacity], float)
    w = np.array(weights) / full**2
    # classes of bins: room left, number of bins, and the chain of what they hold
    room = np.empty((64, 3))
    mult = np.empty(64, np.int64)
    held: list = []
    where: dict[tuple, list[int]] = {}

    def add(left, n, chain):
        nonlocal room, mult
        if len(held) == len(mult):
            room, mult = np.concatenate([room, np.empty_like(room)]), np.concatenate([mult, np.empty_like(mult)])
        room[len(held)], mult[len(held)] = left, n
        held.append(chain)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        need = np.array([length, 1, length * length], float)
        if np.any(need > full):
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while left:
            r = room[: len(held)]
            fits = np.flatnonzero((mult[: len(held)] > 0) & np.all(r >= need, axis=1))
            if len(fits):
                after = r[fits] - need
                score = (after**2 @ w) if rule == "norm" else -(r[fits] * need) @ w
                best = int(fits[np.argmin(score)])
                have, base, chain = int(mult[best]), room[best].copy(), held[best]
            else:
                best, have, base, chain = -1, left, full, None
            per_bin = min(left, int(np.min(base // need)))
            bins = min(have, left // per_bin)
            if best >= 0:
                mult[best] -= bins
            add(base - per_bin * need, bins, (chain, length, per_bin))
            left -= per_bin * bins
    runs, next_rank, first_bin = [], {}, 0
    for k, chain in enumerate(held):
        n, steps = int(mult[k]), []
        if not n:
            continue
        while chain:
            chain, length, per_bin = chain
            steps.append((length, per_bin))
        offset = 0
        for length, per_bin in reversed(steps):
            rank = next_rank.get(length, 0)
            runs.append((length, rank, per_bin, n, first_bin, offset))
            next_rank[length] = rank + per_bin * n
            offset += length * per_bin
        first_bin += n
    return runs, first_bin


def pack(pieces: DataFrame, capacity: int = 2048, **rules) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ids_crc32, ...)."""
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = pack_lengths(histogram, capacity, **rules)
    runs.sort()
    bits = bucket_bits(sum(histogram.values()))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), 4)
    keyed = pieces.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 60 - bits))
    ranked = rank_in_group(keyed, ["length"], "_b", ["_h", "_row"], "_rank").drop("_h", "_b", "_row")
    # a few runs for each of at most `capacity` lengths
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(frames):
        import pyarrow as pa

        table_ = shared.value
        keys = (table_[:, 0] << 48) | table_[:, 1]
        for f in frames:
            length, rank = (f.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = table_[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            at = rank - run[:, 1]
            sequence = run[:, 4] + at // run[:, 2]
            offset = run[:, 5] + at % run[:, 2] * length
            f = f.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(sequence), pa.array(offset)], [*f.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def op10_pack(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
