"""Token-id files: bit-plane shuffled, zstandard-compressed blocks with a chunk index.

A file holds the ids of a run of documents in ascending order of their key::

    b"LXTK" | version | planes "bit"/"byte"
    chunks                                        one for each block and plane, zstandard; between them, of each
                                                  BLOCK_DOCS documents, the keys and lengths (little-endian, 64 bits)
    footer: JSON, zstandard                       block_ids, width, blocks [[count, offset, sizes...]...],
                                                  docs [[count, offset, size]...]
    footer offset (8 bytes) | b"LXTK"

A block has ``block_ids`` ids (the last one fewer). Its ids are transposed: plane p holds bit (or byte) p
of every id, so planes of high bits are nearly constant and compress to nothing. The chunk index lets
a reader fetch any run of ids by range.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexlake.llm.pretokens import library_encoder
from lexlake.storage import materialize, scratch_path

MAGIC = b"LXTK"
#: Ids a block holds, documents whose keys and lengths form a chunk of the index, and ids after which a new file begins.
BLOCK_IDS, BLOCK_DOCS, FILE_IDS = 1 << 16, 1 << 16, 1 << 28
#: Bytes of text of a range of keys, which is one task's work.
RANGE_BYTES = 1 << 26
#: What stands for a null key in a file.
NO_KEY = -(2**63)


def shuffle_planes(ids: np.ndarray, planes: str, width: int) -> list[bytes]:
    """The planes of one block. width: planes kept, enough for the largest id of the file."""
    ids = np.ascontiguousarray(ids, "<u4")
    if planes == "byte":
        as_bytes = ids.view(np.uint8).reshape(-1, 4)
        return [as_bytes[:, p].tobytes() for p in range(width)]
    return [np.packbits(ids >> np.uint32(p) & np.uint32(1), bitorder="little").tobytes() for p in range(width)]


def join_planes(chunks: list[bytes], planes: str, count: int) -> np.ndarray:
    """The ids of one block from its planes."""
    if planes == "byte":
        out = np.zeros((count, 4), np.uint8)
        for p, x in enumerate(chunks):
            out[:, p] = np.frombuffer(x, np.uint8)
        return out.view("<u4").ravel()
    ids = np.zeros(count, "<u4")
    for p, x in enumerate(chunks):
        ids |= np.unpackbits(np.frombuffer(x, np.uint8), count=count, bitorder="little").astype("<u4") << np.uint32(p)
    return ids


class TokenFileWriter:
    """Writes one file as ids come; holds a block of ids, a block of documents' keys, and the indexes of both."""

    def __init__(self, out, planes: str = "bit", largest: int = 0xFFFFFFFF, block_ids: int = BLOCK_IDS, level: int = 1):
        self.out, self.planes, self.block_ids, self.largest = out, planes, block_ids, int(largest)
        bits = max(1, self.largest.bit_length())
        self.width = bits if planes == "bit" else (bits + 7) // 8
        self.press = zstandard.ZstdCompressor(level=level)
        self.blocks, self.docs = [], []
        self.held, self.n_held, self.held_docs, self.n_docs, self.n_ids = [], 0, [], 0, 0
        self.at = out.write(MAGIC + bytes([2]) + planes.ljust(4).encode())

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents by key, in order, with their ids one after the other. An id above largest is an error."""
        if len(ids) and int(ids.max()) > self.largest:
            raise ValueError(f"id {int(ids.max())} is above {self.largest}, the largest that this file has planes for")
        self.held_docs.append(np.stack([np.asarray(keys, "<i8"), np.asarray(lengths, "<i8")]))
        self.n_docs += len(keys)
        self.held.append(np.asarray(ids, "<u4"))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(self.block_ids)
        if self.n_docs >= BLOCK_DOCS:
            self._flush_docs()

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        k = 0
        while len(ids) - k >= least and k < len(ids):
            block = ids[k : k + self.block_ids]
            chunks = [self.press.compress(x) for x in shuffle_planes(block, self.planes, self.width)]
            self.blocks.append([len(block), self.at, *map(len, chunks)])
            self.at += self.out.write(b"".join(chunks))
            k += len(block)
        self.held, self.n_held = [ids[k:].copy()], len(ids) - k

    def _flush_docs(self) -> None:
        if self.n_docs:
            packed = self.press.compress(np.concatenate(self.held_docs, axis=1).tobytes())
            self.docs.append([self.n_docs, self.at, len(packed)])
            self.at += self.out.write(packed)
        self.held_docs, self.n_docs = [], 0

    def close(self) -> None:
        self._flush(1)
        self._flush_docs()
        footer = self.press.compress(json.dumps({"block_ids": self.block_ids, "width": self.width, "blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(footer + struct.pack("<QQ", self.at, len(footer)) + MAGIC)
        self.out.close()


class TokenFileReader:
    """Reads runs of ids of one file by range."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        head, tail = source.read_at(9, 0), source.read_at(20, size - 20)
        if head[:4] != MAGIC or tail[-4:] != MAGIC:
            raise ValueError("not a token-id file, or not written to its end")
        self.planes = head[5:9].decode().strip()
        self.open = zstandard.ZstdDecompressor()
        at, n = struct.unpack("<QQ", tail[:16])
        info = json.loads(self.open.decompress(source.read_at(n, at)))
        self.block_ids, self.width, self.blocks, self.docs = info["block_ids"], info["width"], info["blocks"], info["docs"]

    def block(self, k: int) -> np.ndarray:
        count, at, *sizes = self.blocks[k]
        data, chunks = self.source.read_at(sum(sizes), at), []
        for n in sizes:
            chunks.append(self.open.decompress(data[:n]))
            data = data[n:]
        return join_planes(chunks, self.planes, count)

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length of the file."""
        a, b = start // self.block_ids, -(-(start + length) // self.block_ids)
        parts = [self.block(k) for k in range(a, b)] if length else []
        return np.concatenate(parts)[start - a * self.block_ids :][:length] if parts else np.zeros(0, "<u4")

    def lengths(self) -> Iterator[tuple[int, int]]:
        """(key, number of ids) of each document, a block of them at a time."""
        for n, at, size in self.docs:
            both = np.frombuffer(self.open.decompress(self.source.read_at(size, at)), "<i8").reshape(2, n)
            yield from zip(both[0].tolist(), both[1].tolist(), strict=True)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(key, start in the file, ids) in order, holding a block and a document at a time."""
        k, at, held = 0, 0, np.zeros(0, "<u4")
        for key, n in self.lengths():
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield key, at, held[:n]
            held, at = held[n:], at + n


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", planes: str = "bit", partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode texts and write their ids to files in ascending order of the key.

    tokenizer: path of a byte-level tokenizer file; end_id: id put after each document. Planes are as many as the largest id of the
    vocabulary (or end_id) needs. Returns the manifest (file_no, path, n_docs, n_ids, start), start being the ids of all files before.
    Rows are dealt to tasks by ranges of the key of about RANGE_BYTES of text each (partitions of them, if given), and a task begins a
    new file at file_ids ids, so file order is key order, and tasks and files' indexes are bounded at any size. A file bears a name of its own and only those that successful tasks report are
    in the manifest, which is stored once: a lost executor or a second attempt leaves at most an unread file behind. Null texts
    count as empty; a null key is stored as -2**63, first, and read as null; equal keys lie side by side, ordered by a hash of the text,
    so that ranges divide them too. Other columns are not read.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "token-files")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text"))
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    schema = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, writer, path, n_docs = TaskContext.get().partitionId() << 32, None, "", 0
        encoder = library_encoder(tokenizer, "byte")
        largest = max(encoder.largest, end_id or 0)
        store, base = fs.FileSystem.from_uri(root)

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"file_no": [file_no], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, j, ids, at in encoder.encode_blocks(batch.column("text")):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    path, n_docs = f"{base}/{file_no:016x}-{uuid.uuid4().hex}.lxtk", 0
                    writer = TokenFileWriter(store.open_output_stream(path), planes, largest)
                lengths = np.diff(at)
                if end_id is not None:
                    ids, lengths = np.insert(ids, at[1:], np.uint32(end_id)), lengths + 1
                writer.add(keys[i:j], lengths, ids)
                n_docs += j - i
                if writer.n_ids >= file_ids:
                    yield done()
                    file_no, writer = file_no + 1, None
        if writer is not None:
            yield done()

    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, "key", tie).sortWithinPartitions("key", tie, "text")
    manifest = materialize(dealt.mapInArrow(write, schema), "token-manifest")
    # One row a file, so one task can hold the running sum at any size of the corpus.
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("root", F.lit(root))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(manifest.count(), 1)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["root"])
                with store.open_input_file(row["path"]) as source:
                    reader, out = TokenFileReader(source), []
                    for key, at, ids in reader.documents():
                        out.append((key, row["start"] + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        if len(out) == 8192:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    return manifest.select("file_no", "path", "start", "root").repartition(n, "file_no").mapInArrow(read, schema)


def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None if v == NO_KEY else v for v in x], pa.int64()) for x in zip(*rows, strict=True)], names=["key", "start", "n_tokens", "ids_crc32"])
