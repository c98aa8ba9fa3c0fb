"""Sorted string tables of token ids: documents keyed by id in prefix-compressed blocks.

A shard holds consecutive ids. Its file: zstd blocks of entries, an index with each block's last
key, a Bloom filter over the ids, and a footer of fixed size. An entry holds how many bytes its
key shares with the one before, the rest of the key, and the ids as little-endian integers of 2
bytes where the vocabulary allows it, else 4. A look-up reads the footer, asks the Bloom filter,
finds the block by binary search in the index, and reads that block alone.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, texts
from .tokenize import END, encoder, vocabulary_path

MAGIC = b"MRSST001"
#: index at, index bytes, bloom at, bloom bytes, entries, tokens, bytes of an id, magic
FOOTER = struct.Struct("<QQQQQQQ8s")
ENTRY = struct.Struct("<BBI")
#: Uncompressed bytes after which a block ends, Bloom bits and hashes for each key.
BLOCK, BITS, HASHES = 1 << 18, 10, 7


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    """Keys sort as the ids do, null first; copy tells rows with one id apart."""
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", copy)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _places(prefix: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(prefix), zlib.adler32(prefix) * 2654435761 | 1
    return [(a * 2246822519 + i * b & 0xFFFFFFFFFFFF) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes entries in ascending key order; `close` gives (entries, tokens)."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.block, self.last, self.index, self.prefixes = bytearray(), b"", [], []
        self.entries = self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids
        self.last = key
        if not self.prefixes or self.prefixes[-1] != key[:9]:
            self.prefixes.append(key[:9])
        self.entries += 1
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        packed = self.zstd.compress(bytes(self.block))
        self.index.append(self.last + struct.pack("<QI", self.at, len(packed)))
        self._write(packed)
        self.block = bytearray()

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.block:
            self._end_block()
        index_at, index = self.at, b"".join(self.index)
        self._write(index)
        bits = max(64, -(-len(self.prefixes) * BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for p in self.prefixes:
            bloom[_places(p, bits)] = 1
        bloom_at, packed = self.at, np.packbits(bloom).tobytes()
        self._write(packed)
        self._write(FOOTER.pack(index_at, len(index), bloom_at, len(packed), self.entries, self.tokens, self.width, MAGIC))
        self.stream.close()
        return self.entries, self.tokens


class Shard:
    """Reads a shard: `get` by id, `scan` all entries in order."""

    def __init__(self, file, size: int):
        self.file = file
        if size < FOOTER.size:
            raise ValueError("not a shard")
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, step = self._read(index_at, index_n), 13 + 12
        self.keys = [index[i : i + 13] for i in range(0, index_n, step)]
        self.blocks = [struct.unpack("<QI", index[i + 13 : i + step]) for i in range(0, index_n, step)]
        self.bloom = self._read(bloom_at, bloom_n)
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.zstd.decompress(self._read(*self.blocks[block])), 0, b""
        while at < len(data):
            shared, rest, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id, or an empty list."""
        first, prefix = key_of(doc_id), key_of(doc_id)[:9]
        if any(not self.bloom[p // 8] >> (7 - p % 8) & 1 for p in _places(prefix, 8 * len(self.bloom))):
            return []
        found = []
        for block in range(bisect_left(self.keys, first), len(self.blocks)):
            for key, ids in self._entries(block):
                if key[:9] == prefix:
                    found.append(np.frombuffer(ids, f"<u{self.width}"))
                elif key > first:
                    return found
        return found


def write_tables(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Shards of all documents' ids under path, in ascending doc_id order; returns the manifest.

    A document's ids are those of its whole text (null: empty) and the end id. Rows with a null
    doc_id come first; rows with the same id follow each other by a hash of their text. Each
    range partition becomes one shard, written under another name and then renamed, so that a
    task that runs twice leaves one whole file. Manifest: shard, file, entries, tokens.
    """
    voc = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        store, folder = fs.FileSystem.from_uri(path)
        encoded = encoder(voc, "<u2") if _fits(voc) else encoder(voc)
        width = np.dtype(encoded.dtype).itemsize
        end = np.array([END], dtype=encoded.dtype).tobytes()
        writer = part = None
        last, copy = object(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded.encode(batch.column(1).to_pylist()), strict=True):
                    if writer is None:
                        part = f"{folder}/_part-{shard:06d}-{task.taskAttemptId()}"
                        writer = ShardWriter(store.open_output_stream(part), width)
                    copy = copy + 1 if doc_id == last else 0
                    last = doc_id
                    writer.add(key_of(doc_id, copy), ids + end)
        if writer is not None:
            entries, tokens = writer.close()
            store.move(part, name := f"{folder}/part-{shard:06d}.sst")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name.rsplit("/", 1)[1]], "entries": pa.array([entries], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    by = ["doc_id", F.xxhash64("text")]
    sorted_docs = texts(docs).repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(sorted_docs.mapInArrow(write, "shard long, file string, entries long, tokens long"), "manifest")


def _fits(path: str) -> bool:
    return encoder(path).last.size <= 1 << 16


def read_tables(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start, n_tokens, ids_crc32 and the shard it is in.

    start counts the ids of all entries before it over all shards. The manifest has one row for
    each shard; the sums over it are the only work in one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['file']}"
                with store.open_input_file(name) as file:
                    shard, at = Shard(file, file.size()), row["first"]
                    out = ([], [], [], [])
                    for key, raw in shard.scan():
                        ids = np.frombuffer(raw, f"<u{shard.width}").astype("<u4")
                        for column, value in zip(out, (id_of(key), at, len(ids), zlib.crc32(ids)), strict=True):
                            column.append(value)
                        at += len(ids)
                        if len(out[0]) == 5000:
                            yield _rows(out, row["shard"])
                            out = ([], [], [], [])
                    yield _rows(out, row["shard"])

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _rows(out: tuple, shard: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pa.array([shard] * len(out[0]), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def token_tables(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards (under the shared folder by default) and reads them all back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-tables")
    return read_tables(spark, path, write_tables(docs, path, vocabulary))
