"""SimHash near duplicates by a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two; its image is the vector of their bit counts. Changing a bit moves
one count by one, so the Manhattan distance of images never exceeds the Hamming distance of fingerprints. Counts are
kept in unary (0 -> 00, 1 -> 01, 2 -> 11), which makes the Manhattan distance a popcount of an exclusive or.

The range join works on grids: the 32 axes fall into eight blocks of four. Within distance 4 at most four blocks differ,
so two images share a cell of at least one of the 70 grids that are laid over four of the blocks. In a cell the
Manhattan bound is tested first, the Hamming distance verifies. Cells give links that keep what is connected connected,
never all their pairs; equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, salt_bit, salt_of, salts_in, text_of, unused
from .components import connected_components

DISTANCE, BLOCKS, SALTS, SHINGLE = 4, 8, 32, 4
#: Rows of a cell that are compared pair by pair, if need be.
SPLIT = 4096

_BLANK = bytes(range(9, 14))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BLANK, b"abcdefghijklmnopqrstuvwxyz" + b" " * 5)
_LOW = np.uint64(0x5555555555555555)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words; of the whole sequence where there are fewer; nothing without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ")
    if not all(words):
        words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(whole[i:j], 42) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes."""
    h, counts = shingle_hashes(text, size), np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def image(f: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments in unary."""
    odd, even = (f >> np.uint64(1)) & _LOW, f & _LOW
    return (odd | even) | ((odd & even) << np.uint64(1))


def grids() -> np.ndarray:
    """A mask for each choice of half of the blocks."""
    block = (1 << (64 // BLOCKS)) - 1
    return np.array([sum(block << (64 // BLOCKS * b) for b in c) for c in combinations(range(BLOCKS), BLOCKS - DISTANCE)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp long) of each row; null texts are empty, and texts without words have fingerprint zero."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(work, T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())]))


def fingerprint_udf(size: int = SHINGLE):
    """The fingerprint of a text as a column."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(work, "bigint")


def _near(f: np.ndarray, t: np.ndarray, i, j) -> np.ndarray:
    near = np.bitwise_count(t[i] ^ t[j]) <= DISTANCE
    near[near] = np.bitwise_count(f[i][near] ^ f[j][near]) <= DISTANCE if np.ndim(i) else np.bitwise_count(f[i] ^ f[j][near]) <= DISTANCE
    return near


def cell_links(cell: np.ndarray, f: np.ndarray, wide: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one cell, enough to connect what is connected within it. Rows come sorted by cell.

    Cells of up to `wide` rows are compared by lags over the whole batch; larger ones by `_large_cell`.
    """
    t = image(f)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    left, right = [], []
    of = np.repeat(sizes, sizes)
    end = np.repeat(starts + sizes, sizes)
    small = np.flatnonzero((of > 1) & (of <= wide))
    for lag in range(1, wide):
        i = small[small + lag < end[small]]
        if not len(i):
            break
        i = i[_near(f, t, i, i + lag)]
        left.append(f[i])
        right.append(f[i + lag])
    for s, n in zip(starts[sizes > wide], sizes[sizes > wide], strict=True):
        for x, y in _large_cell(f[s : s + n]):
            left.append(x)
            right.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _large_cell(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A breadth-first search compares each row with those not reached yet, so a dense cell costs little more than its rows and gives a tree.

    Where little links, that would compare all pairs. Beyond a budget of comparisons the rows that are left are dealt out
    again, by finer blocks: see `_finer`.
    """
    t, rest = image(f), np.arange(len(f))
    budget = max(SPLIT * SPLIT, 64 * len(f))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            if budget < 0 and len(rest) > SPLIT:
                yield from _finer(f[np.concatenate((queue, rest))])  # rows taken from the queue have met all others
                return
            i = queue.pop()
            budget -= len(rest)
            hit = _near(f, t, i, rest)
            found = rest[hit]
            if len(found):
                yield np.repeat(f[i], len(found)), f[found]
                queue.extend(found.tolist())
                rest = rest[~hit]


def _finer(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bits of the images that still vary, in eight blocks: within distance 4 some four of them agree. Where the images don't vary any more, the bits of the fingerprints."""
    for x in (image(f), f):
        varying = int(np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x))
        bits = [b for b in range(64) if varying >> b & 1]
        if len(bits) > DISTANCE:
            break
    else:
        raise AssertionError("distinct fingerprints with four varying bits are sixteen at most")
    parts = [sum(1 << b for b in bits[k::BLOCKS]) for k in range(min(BLOCKS, len(bits)))]
    for chosen in combinations(parts, len(parts) - DISTANCE):
        key = x & np.uint64(sum(chosen))
        order = np.argsort(key, kind="stable")
        yield cell_links(key[order], f[order])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            keep.append(k)
    return a[keep], b[keep]


def link_fingerprints(distinct: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(a, b) links at Hamming distance 4 or less between the values of column fp, which are distinct; what such links connect, these connect."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = grids()
        number = np.arange(len(masks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            f = b["fp"].to_numpy(np.int64).view(np.uint64)
            t = image(f)
            cell = (t[:, None] & masks) * np.uint64(0xFF51AFD7ED558CCD)  # odd factor: cells of one grid stay apart
            cell = (cell ^ (cell >> np.uint64(32))) + number  # and the grids' numbers part the grids; a chance meeting costs a comparison
            yield pd.DataFrame({"cell": cell.reshape(-1).view(np.int64), "fp": np.repeat(f.view(np.int64), len(masks))})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_c, held_f = [], []
        a, b, waiting = [], [], 0

        def links(c: np.ndarray, f: np.ndarray) -> None:
            nonlocal waiting
            x, y = cell_links(c, f)
            if len(x):
                a.append(x)
                b.append(y)
                waiting += len(x)

        def out() -> pd.DataFrame:
            nonlocal waiting
            x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2
            a.clear()
            b.clear()
            waiting = 0
            return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

        for part in batches:
            held_c.append(part["cell"].to_numpy(np.int64))
            held_f.append(part["fp"].to_numpy(np.int64).view(np.uint64))
            if held_c[0][0] == held_c[-1][-1]:
                continue  # one cell so far
            c, f = np.concatenate(held_c), np.concatenate(held_f)
            cut = int(np.searchsorted(c, c[-1]))
            links(c[:cut], f[:cut])
            held_c, held_f = [c[cut:]], [f[cut:]]
            if waiting > flush:
                yield out()
        if held_c:
            links(np.concatenate(held_c), np.concatenate(held_f))
        yield out()

    pair = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    cells = distinct.select("fp").mapInPandas(spread, pair("cell", "fp"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(compare, pair("a", "b"))


def _components(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, fp) of each row as a written table; (fp, root, component_id, mask of the salts of its ids) of each fingerprint; the first with its salts."""
    prints = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    salted = prints.withColumn("salt", salt_of(F.col("id"), SALTS))
    nodes = materialise(salted.groupBy("fp").agg(F.min("id").alias("least"), F.bit_or(salt_bit(F.col("salt"))).alias("mask")), "nodes")
    roots = materialise(connected_components(link_fingerprints(nodes)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "mask", F.coalesce("root", "fp").alias("root"), salt_of(F.col("fp"), SALTS).alias("part"))
    # a component of many fingerprints meets its name in as many parts as it has salts
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.bit_or(salt_bit(F.col("part"))).alias("parts"))
    names = names.select("root", "component_id", F.explode(salts_in(F.col("parts"), SALTS)).alias("part"))
    return prints, placed.join(names, ["root", "part"]).select("fp", "root", "component_id", "mask"), salted


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links of 4 bits or fewer).

    Null texts are empty; texts without words have fingerprint zero and are linked like any other. Repeated rows stay
    rows; equal texts link at distance 0. A null id never names a component unless it is alone in it, which then is null.
    An empty table gives an empty result; other columns are not read.
    """
    _, labels, salted = _components(docs, id_col, text_col, size)
    labels = labels.select("fp", "component_id", F.explode(salts_in(F.col("mask"), SALTS)).alias("salt"))
    return salted.join(labels, ["fp", "salt"]).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows whose id names their component, with the columns of docs, whatever their names: one row of each component stays.

    Of rows that share the id which names their component one stays, the choice among them being free. A component of
    rows without ids keeps one as well; beside rows with ids they go. Null texts are empty and near each other. An empty
    table gives an empty result.
    """
    prints, labels, _ = _components(docs, id_col, text_col, size)
    known = "id IS NOT DISTINCT FROM component_id"
    winners = materialise(prints.distinct().join(labels.select("fp", "component_id"), "fp").filter(known).select("id", "fp"), "winners")
    # ids that stand for one row keep that row; for others, and for rows without one, the fingerprint tells which rows are meant
    often = prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").select("id")
    often = materialise(often, "repeated")
    columns = docs.columns
    key = unused("id", columns)
    rows = docs.withColumn(key, F.col(id_col).cast("bigint"))
    single = winners.join(often, "id", "left_anti").filter("id IS NOT NULL").select(F.col("id").alias(key))
    kept = rows.join(single, key, "left_semi").select(*columns)
    if not often.limit(1).count():
        return kept
    packed = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    few = packed.join(often.withColumnRenamed("id", "again"), F.col("id").eqNullSafe(F.col("again")), "left_semi")
    few = few.select("row", "id", fingerprint_udf(size)(text_of("text")).alias("fp"))
    one = few.groupBy("id", "fp").agg(F.first("row").alias("row"))
    named = one.join(winners.select(F.col("id").alias("winner"), F.col("fp").alias("print")), F.col("id").eqNullSafe(F.col("winner")) & (F.col("fp") == F.col("print")), "left_semi")
    named = named.join(labels.select(F.col("fp").alias("print"), "root"), F.col("fp") == F.col("print"))
    return kept.unionByName(named.groupBy("root").agg(F.first("row").alias("row")).select("row.*"))
