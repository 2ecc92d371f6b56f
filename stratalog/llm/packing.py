"""Best-fit-decreasing packing of token sequences.

Pieces of one length are alike to a packer, so the whole corpus is packed from its histogram of lengths, at most
`capacity` numbers, whatever its size. A segment tree over remaining capacities holds the open bins; its query for the
tightest bin that still takes a length is logarithmic in the capacity. Equal lengths that meet equal bins are placed
together as one move, which gives the very bins that placing them one by one would. The moves then go back to the pieces
by their number within their length, counted in two levels so that no length meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_of
from .tokens import encoder

CAPACITY = 2048
#: So many bytes of text are tokenised and handed on at once.
PORTION = 1 << 20


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity; a leaf has the runs of open bins with so much room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.width)]

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        at = room + self.width
        while at and not self.full[at]:
            self.full[at] = True
            at >>= 1

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` bins of one run of that room."""
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
            count = most
        at = room + self.width
        if not self.runs[room]:
            self.full[at] = False
            at >>= 1
            while at and not (self.full[2 * at] or self.full[2 * at + 1]):
                self.full[at] = False
                at >>= 1
        return first, count

    def tightest(self, length: int) -> int | None:
        """The least room of an open bin that is `length` or more."""
        at = length + self.width
        if self.full[at]:
            return length
        while at > 1:
            if not at & 1 and self.full[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


@dataclass(frozen=True)
class Move:
    """Pieces lo, lo+1, ... (count of them) of a length go to bins first, first+1, ...; `each` to a bin, from `offset` on."""

    length: int
    lo: int
    count: int
    first: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Move], int]:
    """The moves of best fit decreasing, and the number of bins."""
    tree, moves, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        lo, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                tree.add(capacity, bins, -(-left // (capacity // length)))
                bins += -(-left // (capacity // length))
            # a bin that has just taken a piece and still has room for another is the tightest, so it goes on filling
            each = min(room // length, left)
            first, count = tree.take(room, left // each)
            moves.append(Move(length, lo, count * each, first, each, capacity - room))
            if room > each * length:
                tree.add(room - each * length, first, count)
            lo += count * each
            left -= count * each
    return moves, bins


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all have the full capacity but the first, which takes the rest."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)] if n else []


PIECE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
)
_ARROW = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def tokenised_pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) with ids as little-endian unsigned 32-bit integers; each document ends with end_id. Null texts are empty."""
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(kind, tokenizer)
        for part in portions(batches, "text"):
            rows: list[tuple] = []
            for i, ids in zip(part["id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                ids += end
                rows += [(i, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names=PIECE.names)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(work, PIECE)


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most so many bytes in the column, or of one row that has more: what is made of a run is all that a worker holds beside the batch."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b[column]).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, size + (ends[lo - 1] if lo else 0), side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("id", "piece"), length: str = "length", bucket_rows: int = 250_000) -> tuple[DataFrame, int]:
    """pieces (which is read twice; give a written table) with sequence_id and offset, and the number of sequences.

    Lengths lie from 1 to capacity; others raise an error in the task that meets them. Ties go by the keys, rows with
    equal keys being dealt in any order, each to a place of its own. An empty table gives no sequences. Pieces of one length
    are numbered in buckets, of which there are enough that even if all have that length a bucket gets about bucket_rows.
    """
    spark = pieces.sparkSession
    buckets = max(256, -(-pieces.count() // bucket_rows))
    checked = F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(F.raise_error(F.concat(F.lit("no sequence takes a piece of length "), F.coalesce(F.col(length).cast("string"), F.lit("null")))))
    rows = pieces.withColumn("len_", checked.cast("bigint")).withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = materialise(rows.groupBy("len_", "bucket_").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["len_"]: r["n"] for r in counts.groupBy("len_").agg(F.sum("n").alias("n")).collect()}
    moves, bins = plan(histogram, capacity)
    # the moves are bounded by the capacity, not by the input: a length adds as many as the runs it meets, and runs split only once a move
    moves_df = spark.createDataFrame(
        [(m.length, m.lo, m.lo + m.count, m.first, m.each, m.offset) for m in moves], "len_ bigint, lo bigint, hi bigint, first bigint, each bigint, offset_ bigint"
    )
    before = Window.partitionBy("len_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("len_", "bucket_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("len_", "bucket_").orderBy(*keys)
    numbered = rows.withColumn("rank_", F.row_number().over(within) - 1).join(base, ["len_", "bucket_"]).withColumn("no_", F.col("base") + F.col("rank_"))
    m = (F.broadcast(moves_df) if len(moves) <= 200_000 else moves_df).alias("m")
    placed = numbered.alias("p").join(m, (F.col("p.len_") == F.col("m.len_")) & (F.col("p.no_") >= F.col("m.lo")) & (F.col("p.no_") < F.col("m.hi")))
    k = F.col("p.no_") - F.col("m.lo")
    return (
        placed.select(
            *[F.col(f"p.{c}") for c in pieces.columns],
            (F.col("m.first") + F.floor(k / F.col("m.each"))).cast("bigint").alias("sequence_id"),
            (F.col("m.offset_") + F.pmod(k, F.col("m.each")) * F.col("p.len_")).cast("bigint").alias("offset"),
        ),
        bins,
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, kind: str = "byte", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their token ids and their places: (id, piece, start, length, ids_crc32, sequence_id, offset).

    The ids themselves stay in the written table of pieces; `sequences` puts them together. Null texts are empty and give
    the end id alone; repeated rows are packed each; an empty table gives an empty result; other columns are not read.
    """
    pieces = materialise(tokenised_pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col), "pieces")
    placed, _ = pack(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed sequences: the ids of their pieces in the order of their offsets. At most `capacity` pieces meet in a row."""
    joined = placed.select("id", "piece", "sequence_id", "offset").join(pieces.select("id", "piece", "ids"), ["id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"]))
    return joined.groupBy("sequence_id").agg(whole.alias("ids"))
