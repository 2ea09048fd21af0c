"""Sorted-string-table shards of token ids.

The rows are range-partitioned and sorted by key; each partition becomes one immutable shard:

    data block*   entries: shared key bytes, own key bytes, value bytes (varints), own key, value; zlib-compressed
    index block   of each data block: first key, offset, length, entries, tokens before it in the shard
    Bloom filter  over the keys
    footer        fixed size: offsets and lengths of index and filter, entries, tokens, magic

Keys are 8-byte big-endian with the sign bit flipped, so bytes sort as the numbers do. Values are ids as little-endian
unsigned 16- or 32-bit integers, whichever the vocabulary needs. A reader finds a key with a binary
search in the sparse index and reads one block. A shard is written under a name of its own for each attempt and named
by its manifest row, so an attempt that was lost or repeated leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import encoder
from quire.llm.common import fresh_path, small_batches, text_of

MAGIC = b"QSST0001"
_FOOTER = struct.Struct("<QQQQQQB7x8s")
_SIGN = 1 << 63


def key_bytes(key: int) -> bytes:
    return (key + _SIGN).to_bytes(8, "big")


def key_of(data: bytes) -> int:
    return int.from_bytes(data, "big") - _SIGN


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


class Bloom:
    """Ten bits a key and seven probes: about one false positive in a hundred."""

    def __init__(self, bits: np.ndarray, probes: int = 7):
        self.bits, self.probes = bits, probes

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        out = cls(np.zeros(max(8, (10 * len(keys) + 7) // 8), np.uint8))
        for k in keys:
            for p in out._places(k):
                out.bits[p >> 3] |= 1 << (p & 7)
        return out

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b, n = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1, 8 * len(self.bits)
        return [(a + i * b) % n for i in range(self.probes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard; keys must come in ascending order, and may repeat."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 18):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.n = self.tokens = 0
        self.block, self.size, self.entries, self.last, self.first, self.before = [], 0, 0, b"", b"", 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: int, ids: np.ndarray) -> None:
        k = key_bytes(key)
        if not self.entries:
            self.first, self.last, self.before = k, b"", self.tokens
        elif k < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < len(self.last) and k[shared] == self.last[shared]:
            shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += [_varint(shared), _varint(8 - shared), _varint(len(value)), k[shared:], value]
        self.size += len(value) + 8
        self.entries += 1
        self.n += 1
        self.tokens += len(ids)
        if not self.keys or self.keys[-1] != k:
            self.keys.append(k)
        self.last = k
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = zlib.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index.append(self.first + struct.pack("<QQQQ", self.at, len(data), self.entries, self.before))
            self.at += len(data)
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index, bloom = b"".join(self.index), Bloom.of(self.keys).bits.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n, self.tokens, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard from a seekable file: in order, or by key."""

    def __init__(self, f):
        self.f = f
        f.seek(f.size() - _FOOTER.size)
        i, ni, b, nb, self.n, self.tokens, self.width, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(i)
        raw = f.read(ni)
        self.blocks = [(raw[p : p + 8], *struct.unpack_from("<QQQQ", raw, p + 8)) for p in range(0, ni, 40)]
        f.seek(b)
        self.bloom = Bloom(np.frombuffer(f.read(nb), np.uint8))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, entries, _ = self.blocks[i]
        self.f.seek(at)
        data, p, key = zlib.decompress(self.f.read(size)), 0, b""
        for _ in range(entries):
            shared, p = _read_varint(data, p)
            own, p = _read_varint(data, p)
            n, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + own]
            p += own
            yield key, data[p : p + n]
            p += n

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(key, tokens of the shard before it, ids) in order; a block in memory at a time."""
        for i, b in enumerate(self.blocks):
            before = b[4]
            for key, value in self._block(i):
                ids = np.frombuffer(value, f"<u{self.width}")
                yield key_of(key), before, ids
                before += len(ids)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids under a key, of each of its rows."""
        k = key_bytes(key)
        if k not in self.bloom:
            return []
        i = max(0, bisect_right([b[0] for b in self.blocks], k) - 1)
        while i > 0 and self.blocks[i][0] == k:  # a repeated key may have begun in the block before
            i -= 1
        found = []
        while i < len(self.blocks) and self.blocks[i][0] <= k:
            found += [np.frombuffer(v, f"<u{self.width}") for kk, v in self._block(i) if kk == k]
            i += 1
        return found


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_shards(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """Encodes the texts and writes shards under ``path``; returns the manifest, a row for each shard, in ascending order of keys.

    The order is by key, then text; a null text has no ids beside ``end_id``, and a row whose key is null is left out of the files, which
    have no place for it. An empty table gives an empty manifest. The range partitions bound what a
    task holds: it streams, a block at a time.
    """
    spark = df.sparkSession
    small_batches(spark)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if len(enc.token_bytes) <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        writer = None
        first = last = None
        for b in batches:
            for k, t in zip(b[0].to_pylist(), b[1].to_pylist()):
                if writer is None:
                    where, name = opened(f"{path}/{uuid.uuid4().hex}.sst")
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    writer, first = Writer(where.open_output_stream(name), width), k
                writer.add(k, np.concatenate([np.frombuffer(enc.encode(t), "<u4"), tail]))
                last = k
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [name.rpartition("/")[2]], "first_key": [first], "last_key": [last], "n": [writer.n], "tokens": [writer.tokens], "bytes": [writer.at]})

    rows = df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t")).filter("k is not null")
    # the hash of the text breaks ties, so a key with very many rows still spreads
    ranged = rows.repartitionByRange(F.col("k"), F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    manifest = ranged.mapInArrow(write, "shard string, first_key long, last_key long, n long, tokens long, bytes long")
    # one row a shard: as many as partitions
    found = sorted(manifest.collect(), key=lambda r: (r.first_key, r.last_key))
    start, out = 0, []
    for r in found:
        out.append((f"{path}/{r.shard}", r.first_key, r.last_key, r.n, r.tokens, r.bytes, start))
        start += r.tokens
    return spark.createDataFrame(out, "shard string, first_key long, last_key long, n long, tokens long, bytes long, start long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(key, start, ids) of every entry: ``start`` counts the tokens of all shards before it and in its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            k, s, v = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(v, pa.binary())], names=["key", "start", "ids"])

        for b in batches:
            for path, start in zip(b["shard"].to_pylist(), b["start"].to_pylist()):
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    rows, size = [], 0
                    for key, before, ids in Reader(f):
                        rows.append((key, start + before, ids.astype("<u4").tobytes()))
                        size += len(rows[-1][2])
                        if size > 4 << 20 or len(rows) >= 1024:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    n = max(1, manifest.count())
    return manifest.select("shard", "start").repartition(n).mapInArrow(read, "key long, start long, ids binary")


def write_and_read(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """Writes shards to a fresh folder of the shared one and reads them back."""
    return read_shards(write_shards(df, tokenizer, fresh_path(df.sparkSession, "sst"), key, text, end_id))
