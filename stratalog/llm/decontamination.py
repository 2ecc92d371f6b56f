"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Shingles are runs of five words; words are maximal runs of letters and digits, lower-cased. An item is contained in a
document when at least `THRESHOLD` of the item's distinct shingles occur in it, however long the document is.

A symmetric sketch can't see a short item in a long document, so the sketch is one-sided and sized by the item. Items are
partitioned by their number of shingles n; those of a partition keep their k = n - ceil(t * n) + 1 smallest shingle
hashes (bottom-k MinHash). If t of the item's shingles are in a document, at most k - 1 are missing, so at least one of
the k is there: the candidate search loses nothing, and looks at a fifth of the items' shingles. The largest hash that
any partition's sketches hold bounds what has to be looked up; document shingles above it are dropped as they are made,
and one look-up by hash serves all partitions, for a row a partition would make the documents' shingles many. The
shingles of candidate pairs, and of no others, are then compared themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of, unused

WORDS, THRESHOLD = 5, 0.8

#: Bytes of a table that may be broadcast, as counted from its rows; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: What a row without text takes in a broadcast table, roughly.
_ROW_BYTES = 64


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array without empty strings."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _shingled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each run of five words of column w, with its words; shorter sequences that have words give themselves as one."""
    n = F.size("w")
    last = F.greatest(n - WORDS, F.lit(0))
    at = rows.filter(n > 0).select(*keep, "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return at.select(*keep, *[F.get("w", F.col("i") + k).alias(f"w{k}") for k in range(WORDS)])


def _hash() -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(WORDS)])


def _shingle() -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(WORDS)])


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def find_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, item id, item_shingles, matched, containment) for each pair whose containment reaches the threshold.

    An item of fewer than five words has its whole sequence as its one shingle, and so is found in documents that are
    that sequence; items and documents without words (null, empty, punctuation) match nothing. Repeated items are reported
    by each id, repeated rows of a document id count as one document holding the shingles of all. Rows with a null id are
    not reported. Empty tables give an empty result. Columns other than the four named are not read.
    """
    bench = items.select(F.col(item_id_col).cast("bigint").alias("item"), words_of(text_of(item_text_col)).alias("w")).filter("item IS NOT NULL")
    shingles = _shingled(bench, ["item"]).select("item", _hash().alias("h"), _shingle().alias("shingle")).distinct()
    by_item = Window.partitionBy("item")
    ranked = shingles.withColumn("n", F.count(F.lit(1)).over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("h", "shingle")))
    need = F.ceil(F.col("n") * F.lit(float(threshold)) - F.lit(1e-9))
    ranked = materialise(ranked.withColumn("need", need).withColumn("sketch", F.col("rank") <= F.col("n") - need + 1), "items")
    # partitions by size: powers of two of n; each has its own sketches, and the largest hash that they hold
    sketches = ranked.filter("sketch").select("h", "item", F.floor(F.log2("n")).alias("size_class"))
    parts = sketches.groupBy("size_class").agg(F.max("h").alias("top"), F.count(F.lit(1)).alias("rows")).collect()  # a row for each power of two
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{id_col} bigint, {item_id_col} bigint, item_shingles bigint, matched bigint, containment double")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), words_of(text_of(text_col)).alias("w")).filter("doc IS NOT NULL")
    low = _shingled(rows, ["doc"]).select("doc", _hash().alias("h")).filter(F.col("h") <= max(p["top"] for p in parts))
    hits = low.join(_small(sketches.select("h", "item").distinct(), _ROW_BYTES * sum(p["rows"] for p in parts)), "h").select("doc", "item").distinct()
    hits = materialise(hits, "candidates")
    # verification: the whole shingles of the candidate documents against those of their own candidate items, and of no others
    asked = hits.groupBy("doc").agg(F.collect_set("item").alias("asked"))
    asked_size = hits.agg((F.count(F.lit(1)) * 8 + F.count_distinct("doc") * _ROW_BYTES).alias("b")).first()["b"]
    items_size = ranked.agg(F.coalesce(F.sum(F.octet_length("shingle") + _ROW_BYTES), F.lit(0)).alias("b")).first()["b"]
    whole = _shingled(rows.join(_small(asked, asked_size), "doc"), ["doc", "asked"]).select("doc", "asked", _hash().alias("h"), _shingle().alias("shingle"))
    found = whole.join(_small(ranked.select("h", "shingle", "item", "n", "need"), items_size), ["h", "shingle"]).filter(F.array_contains("asked", F.col("item")))
    sure = found.select("doc", "item", "n", "need", "shingle").distinct().groupBy("doc", "item", "n", "need").agg(F.count(F.lit(1)).alias("matched")).filter("matched >= need")
    return sure.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), F.col("n").alias("item_shingles"), "matched", (F.col("matched") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item is contained, with their columns, whatever their names. All rows of a contaminated id go; rows with a null id stay."""
    key = unused("bad_id", docs.columns)
    bad = materialise(find_contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias(key)).distinct(), "contaminated")
    return docs.join(_small(bad, _ROW_BYTES * bad.count()), docs[id_col] == F.col(key), "left_anti")
