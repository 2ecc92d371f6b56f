"""Token ids in sorted-string-table shards.

A shard holds documents in the order of their ids. Its parts, all little-endian:

* magic "STRSST01";
* data blocks of about BLOCK bytes. An entry is shared u8, rest u8, n_ids u32, then the rest of the key and the ids as
  unsigned 16- or 32-bit integers; shared is how much of the key before it the key repeats, 0 at each RESTART-th entry.
  The block ends with the places of its restarts (u32 each), their number (u32) and the CRC-32 of all that (u32);
* the sparse index, for each block: first key (9 bytes), place u64, size u32, entries u32, ids u64;
* the Bloom filter's bits;
* the footer: places and sizes of index and filter, number of hashes, id width, entries, ids, CRC-32 of the index, magic.

A key is a byte 1 and the id as big-endian unsigned with its sign bit turned, so that bytes order as ids do; a null id
is a byte 0 and zeros, and comes first. A lookup reads the footer, asks the filter, searches the index and a block's restarts by halves.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, text_of
from .files import open_read, open_write
from .tokens import encoder

MAGIC, BLOCK, RESTART, BITS_PER_KEY, HASHES = b"STRSST01", 64 << 10, 16, 10, 7
_FOOTER = struct.Struct("<QQQQIIQQI8s")
_INDEX = struct.Struct("<9sQIIQ")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bits(key: bytes, m: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % m for k in range(HASHES)]


class Writer:
    """add() in the order of keys, then close(); what is held in memory is a block, the index and the filter's keys."""

    def __init__(self, file, width: int = 2, block: int = BLOCK):
        self.file, self.width, self.limit = file, width, block
        self.file.write(MAGIC)
        self.at, self.index, self.keys = len(MAGIC), [], bytearray()
        self.entries = self.ids = 0
        self.last = b""
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.in_block, self.ids_in_block, self.first = bytearray(), [], 0, 0, b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit integers."""
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("keys come in order")
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // 4
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if n and wide.max() > 0xFFFF:
                raise ValueError(f"id {wide.max()} doesn't fit into two bytes")
            ids = wide.astype("<u2").tobytes()
        self.first = self.first or key
        self.block += struct.pack("<BBI", shared, 9 - shared, n) + key[shared:] + ids
        self.keys += key if key != self.last else b""
        self.last = key
        self.in_block, self.ids_in_block, self.entries, self.ids = self.in_block + 1, self.ids_in_block + n, self.entries + 1, self.ids + n
        if len(self.block) >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.file.write(body)
        self.index.append(_INDEX.pack(self.first, self.at, len(body), self.in_block, self.ids_in_block))
        self.at += len(body)
        self._start()

    def close(self) -> None:
        self._flush()
        index, n = b"".join(self.index), len(self.keys) // 9
        m = max(64, n * BITS_PER_KEY + 7 & ~7)
        bloom = bytearray(m // 8)
        for i in range(n):
            for b in _bits(bytes(self.keys[9 * i : 9 * i + 9]), m):
                bloom[b >> 3] |= 1 << (b & 7)
        self.file.write(index + bloom)
        self.file.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), HASHES, self.width, self.entries, self.ids, zlib.crc32(index), MAGIC))
        self.file.close()


class Reader:
    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - _FOOTER.size)
        at, size, self.bloom_at, self.bloom_size, _, self.width, self.entries, self.ids, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        file.seek(at)
        index = file.read(size)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("no whole shard")
        self.index = list(_INDEX.iter_unpack(index))
        self.bloom: bytes | None = None

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, size, _, _ = self.index[k]
        self.file.seek(at)
        body = self.file.read(size)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", body[-8:-4])[0]
        return body[: -8 - 4 * n], list(struct.unpack(f"<{n}I", body[-8 - 4 * n : -8]))

    def _entries(self, data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, rest, n = struct.unpack_from("<BBI", data, at)
            key = key[:shared] + data[at + 6 : at + 6 + rest]
            at += 6 + rest
            raw = data[at : at + n * self.width]
            at += n * self.width
            yield key, np.frombuffer(raw, "<u2").astype("<u4").tobytes() if self.width == 2 else raw

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, ids in self._entries(self._block(k)[0]):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.file.seek(self.bloom_at)
            self.bloom = self.file.read(self.bloom_size)
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key_of(doc_id), 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of all entries of that key."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        k = max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1)
        while k < len(self.index) and self.index[k][0] <= key:
            data, restarts = self._block(k)
            at = bisect.bisect_left(restarts, key, key=lambda r: data[r + 6 : r + 15])
            for found, ids in self._entries(data, restarts[max(0, at - 1)]):
                if found > key:
                    return out
                if found == key:
                    out.append(ids)
            k += 1
        return out


def write_shards(docs: DataFrame, tokenizer: str, path: str, kind: str = "word", end_id: int = 1, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Shards below path, in ascending id order, one a partition of the session's spark.sql.shuffle.partitions; the manifest: uri, docs, ids of each, in order.

    Texts are dealt by ranges of ids and sorted, then encoded as they are written, so ids are never shuffled. A task that
    runs again writes a file of its own; the manifest names those of the tasks that ended well. Null texts are empty.
    width is the bytes of an id; by default two where all ids of the tokenizer fit.
    """
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(kind, tokenizer), TaskContext.get().partitionId()
        bytes_per_id = width or (2 if len(enc.raw) <= 1 << 16 and end_id < 1 << 16 else 4)
        out = uri = None
        for b in batches:
            if out is None:
                uri = f"{path}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                out = Writer(open_write(uri), bytes_per_id)
            for has, i, ids in zip(b["has"].tolist(), b["id"].tolist(), enc.encode(b["text"].tolist()), strict=True):
                out.add(i if has else None, ids + end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [part], "uri": [uri], "docs": [out.entries], "ids": [out.ids]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), text_of(text_col).alias("text")).sort("key")
    rows = rows.select(F.coalesce("key", F.lit(0)).alias("id"), F.col("key").isNotNull().alias("has"), "text")
    return sorted((r.asDict() for r in rows.mapInPandas(work, "part int, uri string, docs long, ids long").collect()), key=lambda r: r["part"])


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, ids): start is the number of ids of all documents before; ids as little-endian unsigned 32-bit integers."""
    at, rows = 0, []
    for m in manifest:
        rows.append((m["uri"], at))
        at += m["ids"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, start in zip(b["uri"], b["start"], strict=True):
                out: list[tuple] = []
                held = 0
                with open_read(uri) as f:
                    for doc_id, ids in Reader(f):
                        out.append((doc_id, start, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 8_000_000:
                            yield _frame(out)
                            out, held = [], 0
                yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "start": [int(x[1]) for x in out], "ids": [x[2] for x in out]})

    shards = spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows)))
    return shards.mapInPandas(work, "doc_id long, start long, ids binary")


def tokenised_table(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into the shared folder and read them back: (id, start, n_tokens, ids_crc32). Repeated ids follow each other; a null id comes first; an empty table gives no shard and no row."""
    spark = docs.sparkSession
    manifest = write_shards(docs, tokenizer, scratch(spark, "shards"), kind, end_id, id_col=id_col, text_col=text_col)
    back = read_shards(spark, manifest)
    return back.select(F.col("doc_id").alias(id_col), "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
