"""Token ids as sorted-string-table shards, written and read by the executors in the shared folder.

A shard holds documents in the order of their keys: data blocks of entries whose keys are cut by the prefix that they
share with the key before, a sparse index with the last key of each block, a Bloom filter over the keys, and a footer
that says where these are. A lookup reads the footer, asks the filter, finds the block by binary search in the index, and
reads that block alone.

Shards are ranges of doc_id. A task writes its shard under a name of its own and names it in its manifest row, so that
what a lost or repeated task leaves behind is never read.

Defined cases: a null text has only the end id; null ids come first, rows with equal ids lie side by side in the order of
their texts; an empty table gives no shard and an empty result; other columns aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, released, scratch, scratch_path, text_or_empty
from gramloom.llm.tokens import token_ids

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK_BYTES = 64 * 1024
#: Documents of a shard, about; and bits of the Bloom filter for each.
SHARD_DOCS = 8192
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Keys sort as their ids do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, n_bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * (b | 1)) % n_bits for k in range(BLOOM_HASHES)]


class Writer:
    """Entries are added in key order; close() writes what comes after the data blocks. width: bytes of an id."""

    def __init__(self, out, width: int):
        self.out, self.width, self.type = out, width, np.dtype(f"<u{width}")
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must be added in order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(self.type).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        n_bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bits = np.zeros(n_bits, np.uint8)
        bits[[b for k in self.keys for b in _bloom_bits(k, n_bits)]] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, MAGIC))


class Reader:
    """file: an open random-access file (pyarrow's)."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, width, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        self.type = np.dtype(f"<u{width}")
        data, at = file.read_at(index_n, index_at), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            start, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, start, length))
        self.bits = np.unpackbits(np.frombuffer(file.read_at(bloom_n, bloom_at), np.uint8))

    def _block(self, start: int, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.file.read_at(length, start), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, self.type, n // self.type.itemsize, at)
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, start, length in self.index:
            yield from self._block(start, length)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key; few reads where there is none."""
        if not all(self.bits[b] for b in _bloom_bits(key, len(self.bits))):
            return []
        found = []
        for last, start, length in self.index[bisect.bisect_left(self.index, key, key=lambda x: x[0]) :]:
            found += [ids for k, ids in self._block(start, length) if k == key]
            if last > key:
                break
        return found


MANIFEST = "shard int, path string, n_docs long, n_ids long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes the shards under path (a URI of a folder that all executors see) and returns their manifest, one row each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, out, shard = f"{folder}/{part:06d}-{uuid.uuid4().hex}.sst", None, None
        encode = token_ids(tokenizer)
        width = 2 if encode.n <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1).to_pylist()), strict=True):
                if shard is None:
                    out = store.open_output_stream(name)
                    shard = Writer(out, width)
                shard.add(key_of(doc), np.append(ids, np.uint32(end_id)))
        if shard is not None:
            shard.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": name, "n_docs": len(shard.keys), "n_ids": shard.n_ids}], schema=_MANIFEST)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    shards = max(1, math.ceil(rows.count() / shard_docs))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return scratch(rows.mapInArrow(released(write), MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32. The window orders shards, not documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch.to_pylist():
                rows, at = [], shard["base"]
                with store.open_input_file(shard["path"]) as f:
                    for key, ids in Reader(f).scan():
                        rows.append({"doc_id": id_of(key), "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                        at += len(ids)
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    placed = manifest.select("shard", "path", before)
    return placed.repartition(max(1, min(10_000, manifest.count())), "shard").mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_docs: int = SHARD_DOCS) -> DataFrame:
    path = scratch_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, tokenizer, path, end_id, shard_docs), path)
