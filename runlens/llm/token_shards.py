"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

File layout, all integers little-endian unless said otherwise:

    magic (8 bytes)
    blocks, each one Zstandard frame of:
        u32 entries, then per entry: varint bytes shared with the previous key, varint further key bytes, those
        bytes, varint ids; then the values one after another (ids of `width` bytes)
    index: per block: u8 key length, first key, u8 key length, last key, u64 offset, u32 length, u32 entries, u64 ids
    Bloom filter: bits
    footer (64 bytes): u64 index offset, u64 index length, u64 Bloom offset, u64 Bloom length, u32 hashes,
        u32 width, u64 documents, u64 ids, u32 crc32 of index and Bloom filter, 4 bytes magic

A key is a byte 0 for a null identifier, or a byte 1 and the identifier as 8 big-endian bytes with the sign bit
flipped, so byte order is identifier order.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Scratch, batches, filesystem, ids_and_texts
from .tokens import default_tokenizer, encoder, text_groups

MAGIC, TAIL = b"RLSST01\n", b"RLS1"
FOOTER = "<QQQQIIQQI4s"
BLOOM_BITS, BLOOM_HASHES = 10, 7
BLOCK_BYTES = 1 << 16

MANIFEST = "path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean"
#: Of the identifiers read, those divisible by this are looked up as well.
LOOKUP_EVERY = 100


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


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


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h1, h2 = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [((h1 + i * h2) & (2**64 - 1)) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes (doc_id, ids as little-endian u32 bytes) in ascending order of identifiers; equal ones are allowed."""

    def __init__(self, sink: Any, width: int = 2, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.at, self.index, self.keys = 0, [], []
        self.n_docs = self.n_tokens = 0
        self.block: list[tuple[bytes, bytes, int]] = []
        self.block_size = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import numpy as np

        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("identifiers must come in ascending order")
        n = len(ids) // 4
        if self.width == 2:
            wide = np.frombuffer(ids, dtype="<u4")
            if n and int(wide.max()) > 65535:
                raise ValueError("an id needs more than two bytes; write with width=4")
            ids = wide.astype("<u2").tobytes()
        self.keys.append(key)
        self.block.append((key, ids, n))
        self.block_size += len(ids) + 12
        self.n_docs += 1
        self.n_tokens += n
        if self.block_size >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        head, last = [struct.pack("<I", len(self.block))], b""
        for key, _, n in self.block:
            shared = next((i for i, (a, b) in enumerate(zip(key, last, strict=False)) if a != b), min(len(key), len(last)))
            head += [_varint(shared), _varint(len(key) - shared), key[shared:], _varint(n)]
            last = key
        data = self.packer.compress(b"".join(head) + b"".join(v for _, v, _ in self.block))
        first = self.block[0][0]
        self.index.append(bytes([len(first)]) + first + bytes([len(last)]) + last + struct.pack("<QIIQ", self.at, len(data), len(self.block), sum(n for _, _, n in self.block)))
        self._put(data)
        self.block, self.block_size = [], 0

    def close(self) -> None:
        if self.block:
            self._end_block()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        index, index_at = b"".join(self.index), self.at
        self._put(index)
        bloom_at = self.at
        self._put(tail)
        self._put(struct.pack(FOOTER, index_at, len(index), bloom_at, len(tail), BLOOM_HASHES, self.width, self.n_docs, self.n_tokens, zlib.crc32(index + tail), TAIL))


class ShardReader:
    """Reads one shard from a seekable source: scan() in order, get(doc_id) by Bloom filter and binary search."""

    def __init__(self, source: Any, size: int):
        self.source = source
        length = struct.calcsize(FOOTER)
        footer = struct.unpack(FOOTER, self._range(size - length, length))
        index_at, index_len, bloom_at, bloom_len, _, self.width, self.n_docs, self.n_tokens, crc, tail = footer
        index, bloom = self._range(index_at, index_len), self._range(bloom_at, bloom_len)
        if tail != TAIL or zlib.crc32(index + bloom) != crc or self._range(0, 8) != MAGIC:
            raise ValueError("not a whole shard")
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.blocks, at = [], 0
        while at < len(index):
            n = index[at]
            first = index[at + 1 : at + 1 + n]
            at += 1 + n
            n = index[at]
            last = index[at + 1 : at + 1 + n]
            at += 1 + n
            self.blocks.append((first, last, *struct.unpack_from("<QIIQ", index, at)))
            at += 24
        self.firsts = [b[0] for b in self.blocks]

    def _range(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._range(block[2], block[3]))
        (entries,), at, key, found = struct.unpack_from("<I", data), 4, b"", []
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            n, at = _read_varint(data, at + more)
            found.append((key, n * self.width))
        for key, n in found:
            yield key, data[at : at + n]
            at += n

    def _wide(self, value: bytes) -> bytes:
        import numpy as np

        return np.frombuffer(value, dtype="<u2").astype("<u4").tobytes() if self.width == 2 else value

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for block in self.blocks:
            for key, value in self._entries(block):
                yield id_of(key), self._wide(value)

    def get(self, doc_id: int | None) -> bytes | None:
        """The ids of the first document with this identifier, or None."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return None
        at = max(0, bisect_right(self.firsts, key) - 1)
        while at and self.blocks[at - 1][1] >= key:
            at -= 1
        for block in self.blocks[at:]:
            if block[0] > key:
                return None
            for k, value in self._entries(block):
                if k == key:
                    return self._wide(value)
        return None


def open_shard(uri: str) -> ShardReader:
    fs, path = filesystem(uri)
    return ShardReader(fs.open_input_file(path), fs.get_file_info(path).size)


def _writer(folder: str, path: str, end_id: int, width: int) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import uuid

        import pyarrow as pa

        made, end = encoder(path), int(end_id).to_bytes(4, "little")
        out = sink = None
        first = last = None
        for batch in source:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in text_groups(texts):
                for i, raw in zip(group, made.encode_many([texts[i] for i in group]), strict=True):
                    if out is None:  # a name of its own for each attempt: only what a finished task reports is read
                        fs, base = filesystem(folder)
                        fs.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.sst"
                        sink = fs.open_output_stream(f"{base}/{name}")
                        out, first = ShardWriter(sink, width), keys[i]
                    out.add(keys[i], raw + end)
                    last = keys[i]
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_id": first, "last_id": last, "n_docs": out.n_docs, "n_tokens": out.n_tokens, "n_bytes": out.at}], schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_tokens", "n_bytes"))]))

    return run


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, width: int = 2, folder: str | None = None) -> DataFrame:
    """Write the shards and return their manifest: path, first_id, last_id, n_docs, n_tokens, n_bytes.

    Documents are range-partitioned and sorted by identifier (a null one comes first), so the shards in order of
    first_id are all documents in order; equal identifiers lie in one shard, in no stated order. Each task streams
    one shard to the shared folder; memory holds one block and the keys of the shard, about fifty bytes each. Null text is the empty
    document, which has the end id alone. An empty table gives an empty manifest. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "shards")
    folder = folder or f"{scratch.path}/files"
    ordered = ids_and_texts(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.write(ordered.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id, width), MANIFEST), "manifest")


def _read(source: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("found", pa.bool_())])
    for batch in source:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cols: list[list[Any]] = [[], [], [], [], []]
            shard, by_id, last = open_shard(path), open_shard(path), ()
            for doc_id, ids in shard.scan():
                found = None
                if doc_id is not None and doc_id % LOOKUP_EVERY == 0:  # of rows that repeat an identifier the first is found
                    found = by_id.get(doc_id) == ids if last != (doc_id,) else by_id.get(doc_id) is not None
                last = (doc_id,)
                for c, v in zip(cols, (doc_id, start, len(ids) // 4, zlib.crc32(ids), found), strict=True):
                    c.append(v)
                start += len(ids) // 4
                if len(cols[0]) >= BATCH_ROWS:
                    yield from batches(schema, cols)
                    cols = [[], [], [], [], []]
            yield from batches(schema, cols)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; one task per shard. For identifiers
    divisible by LOOKUP_EVERY, found tells whether a lookup (Bloom filter, binary search) gave the document too.

    The running start of each shard comes from a window over the manifest, which has one row per shard.
    """
    shards = manifest.count()
    order = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    return placed.repartition(max(1, shards)).mapInArrow(_read, RESULT)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
