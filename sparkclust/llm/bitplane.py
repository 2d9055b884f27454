"""Token ids in bit-plane files: fixed-size id blocks, transposed, compressed plane by plane.

File layout (little-endian):

    "BPLANE1\\n" | plane payloads, block after block | document table | index | footer

* A block holds ``block_ids`` unsigned 32-bit ids (the last one fewer). Its 4 byte planes (or 32 bit
  planes) are compressed with zstandard one by one; a plane of zeros shrinks to a few bytes.
* The document table (zstandard) has an id, a null flag and a token count for each document.
* The index has the offset, the id count and the plane lengths of each block, so any block can be read alone.
* The footer has the plane kind, the sizes of index and table, the counts of blocks and documents, and the magic again.

Documents are dealt into ranges of ascending id, one file for each range; the manifest (one row a file)
gives every file its first id position. Files are written under a temporary name and moved into place,
and have the same bytes each time, so a repeated task replaces like with like.

Defined results
* null or empty text: the end id alone; null ids come first, equal ids are ordered by a hash of the text.
* very long texts are encoded whole and may span many blocks; repeated rows are written as often as they occur.
* an empty table gives no file and an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialize, table
from .encoding import encoder, text_bytes, text_slices

MAGIC = b"BPLANE1\n"
_FOOTER = "<BIQQQQ"  # plane kind, block_ids, blocks, documents, table bytes, index bytes
BYTE, BIT = 0, 1


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Appends documents to a bit-plane file; holds one block and the document table in memory."""

    def __init__(self, sink, kind: int = BYTE, block_ids: int = 65536, level: int = 1):
        import zstandard

        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.sink.write(MAGIC)
        self.at, self.pending, self.held, self.n_ids = len(MAGIC), [], 0, 0
        self.index: list[tuple] = []
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []

    def append(self, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray):
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.counts.append(counts.astype("<i8"))
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block_ids:
            flat, done = np.concatenate(self.pending), 0
            while done + self.block_ids <= len(flat):
                self._block(flat[done : done + self.block_ids])
                done += self.block_ids
            self.pending, self.held = [flat[done:]], len(flat) - done

    def _block(self, ids: np.ndarray):
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append((self.at, len(ids), *map(len, packed)))
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self):
        if self.held:
            self._block(np.concatenate(self.pending))
        docs = [np.concatenate(x) if x else np.empty(0) for x in (self.doc_ids, self.counts, self.nulls)]
        tab = self.zstd.compress(docs[0].astype("<i8").tobytes() + docs[1].astype("<i8").tobytes() + docs[2].astype(np.uint8).tobytes())
        index = np.array(self.index, "<i8").tobytes()
        self.sink.write(tab)
        self.sink.write(index)
        self.sink.write(struct.pack(_FOOTER, self.kind, self.block_ids, len(self.index), len(docs[0]), len(tab), len(index)) + MAGIC)


class Reader:
    """Random access to the blocks of a bit-plane file."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        foot = struct.calcsize(_FOOTER) + len(MAGIC)
        tail = source.read_at(foot, end - foot)
        if tail[-len(MAGIC) :] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a bit-plane file")
        self.kind, self.block_ids, blocks, docs, tab_len, index_len = struct.unpack(_FOOTER, tail[: struct.calcsize(_FOOTER)])
        index_at = end - foot - index_len
        self.index = np.frombuffer(source.read_at(index_len, index_at), "<i8").reshape(blocks, -1)
        tab = self.zstd.decompress(source.read_at(tab_len, index_at - tab_len))
        self.doc_ids = np.frombuffer(tab, "<i8", docs)
        self.counts = np.frombuffer(tab, "<i8", docs, 8 * docs)
        self.nulls = np.frombuffer(tab, np.uint8, docs, 16 * docs).astype(bool)

    def block(self, k: int) -> np.ndarray:
        at, n, *lens = self.index[k].tolist()
        raw = self.source.read_at(sum(lens), at)
        cut = np.cumsum([0, *lens])
        return from_planes([self.zstd.decompress(raw[a:b]) for a, b in zip(cut, cut[1:])], n, self.kind)

    def documents(self):
        """(row in the document table, ids) of each stretch of a document, in order, block after block."""
        ends = np.cumsum(self.counts)
        doc, left = 0, int(self.counts[0]) if len(ends) else 0
        for k in range(len(self.index)):
            ids, at = self.block(k), 0
            while at < len(ids):
                step = min(left, len(ids) - at)
                yield doc, ids[at : at + step]
                at += step
                left -= step
                if not left:
                    doc += 1
                    left = int(self.counts[doc]) if doc < len(ends) else 0


def _filesystem(path: str):
    """pyarrow's filesystem for a shared path (file:, hdfs:, s3: ...)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_files(docs: DataFrame, path: str, vocab: str, end_id: int = 0, kind: int = BYTE, block_ids: int = 65536,
                n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the files under ``path``, return the manifest (file, name, n_docs, n_ids, start)."""
    n = n_files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the scan position as last key splits equal rows over files
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("text"))
    dealt = keyed.repartitionByRange(n, "id", "h", "at").sortWithinPartitions("id", "h", "at").select("id", "text")

    def run(frames):
        import pyarrow as pa

        from pyspark import TaskContext

        fs, base = _filesystem(path)
        fs.create_dir(base, recursive=True)
        file = TaskContext.get().partitionId()  # ranges are numbered in order of their keys
        name = f"{base.rstrip('/')}/ids-{file:06d}.bplane"
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        enc, out, sink = encoder(vocab), None, None
        for frame in text_slices(frames, "text", encodes=True):
            ids, texts = frame.column("id"), text_bytes(frame.column("text"))
            if not texts:
                continue
            if out is None:
                sink = fs.open_output_stream(tmp)
                out = Writer(sink, kind, block_ids)
            flat, counts = enc.encode(texts)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            out.append(np.insert(flat, np.cumsum(counts), end_id).astype(np.uint32), ids.fill_null(0).to_numpy(zero_copy_only=False), nulls, counts + 1)
        if out is not None:
            out.close()
            sink.close()
            fs.move(tmp, name)
            done = [file], [name.rsplit("/", 1)[1]], [sum(map(len, out.doc_ids))], [out.n_ids]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(done, kinds)], ["file", "name", "n_docs", "n_ids"])

    manifest = materialize(dealt.mapInArrow(run, "file int, name string, n_docs long, n_ids long"), "bitplane-manifest")
    # one row a file: the window is over at most n rows
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        import pyarrow as pa

        fs, base = _filesystem(path)
        for frame in frames:
            for name, start in zip(frame.column("name").to_pylist(), frame.column("start").to_pylist()):
                with fs.open_input_file(f"{base.rstrip('/')}/{name}") as source:
                    r = Reader(source)
                    crc = np.zeros(len(r.counts), np.int64)
                    for doc, ids in r.documents():
                        crc[doc] = zlib.crc32(np.ascontiguousarray(ids, "<u4"), int(crc[doc]))
                starts = start + np.cumsum(r.counts) - r.counts
                for a in range(0, len(crc), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[s], pa.int64(), mask=r.nulls[s]), pa.array(starts[s], pa.int64()), pa.array(r.counts[s], pa.int64()), pa.array(crc[s], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.select("file", "name", "start").repartitionById(n, F.col("file") % n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_bitplanes(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "bitplanes")
    manifest = write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(manifest, path)
