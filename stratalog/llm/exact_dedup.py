"""Exact duplicates, safe under skew.

Texts are equal when they are identical after every blank is deleted. Three combines find the groups, and each compares
whole normalised texts, the digest only being the part of the key that deals rows out. The winners then go back to the
rows by SHA-256, a 64-bit hash and the length, which name a class whose texts were compared whole:

1. each task merges the rows it holds (the map side of the first aggregate, keyed by digest, salt and whole text);
2. the salted groups merge: a text that a third of all rows share is dealt to `SALTS` tasks, each getting a row per task and salt;
3. the salt winners combine globally, at most `SALTS` rows a text.

The winner goes back to the rows by (class, salt), so the hot group is split in the same way there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, salt_bit, salt_of, salts_in, text_of

#: Hot groups are dealt to so many tasks; at most 63, for the salts are kept as bits of a long.
SALTS = 32

_TOP = "100000000000000000000BD"  # 10 ** 20, beyond any id


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS + "+", "")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Larger is better: more code points, then the smaller doc_id, rows without one last. A decimal, so that max() stays a hash aggregate."""
    small_first = F.coalesce(F.expr("9223372036854775808BD") - doc_id.cast("decimal(20,0)"), F.expr("0BD"))
    return (n_chars.cast("decimal(11,0)") * F.expr(_TOP) + small_first).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    rest = rank % F.expr(_TOP)
    return F.when(rest > 0, F.expr("9223372036854775808BD") - rest).cast("bigint")


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and the columns named in carry.

    Of equal texts the row with the most code points in its original text stays, then the smallest id. Null texts are
    empty; empty and all-blank texts are one group. A null id loses against any other. Of rows repeated with the same id
    and text exactly one is kept, all count in group_size. An empty table gives an empty result. Columns of docs other
    than the two named are read only if carried, so clashing names do no harm.
    """
    text = text_of(text_col)
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("raw"), *carried)
        .withColumn("norm", normalised(F.col("raw")))
        .select(
            "id",
            *[f"carried_{i}" for i in range(len(carried))],
            F.char_length("raw").alias("n"),
            "norm",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            salt_of(F.col("id"), salts).alias("salt"),
        )
    )
    merged = rows.groupBy("sha", "salt", "norm").agg(F.max(_rank(F.col("n"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
    winners = merged.groupBy("sha", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"), F.bit_or(salt_bit(F.col("salt"))).alias("mask"))
    same = lambda: (F.xxhash64("norm").alias("xx"), F.octet_length("norm").alias("octets"))  # noqa: E731  with the digest, they name a class whose texts were compared whole
    classes = winners.select("sha", *same(), _ranked_id(F.col("best")).alias("keep_id"), F.col("size").alias("group_size"), F.explode(salts_in(F.col("mask"), salts)).alias("salt"))
    slim = rows.select("id", *[f"carried_{i}" for i in range(len(carried))], "sha", "salt", *same())
    joined = slim.join(classes, ["sha", "xx", "octets", "salt"])
    first = F.row_number().over(Window.partitionBy("id", "sha", "xx").orderBy(F.lit(1)))
    return joined.withColumn("nth", first).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("id").eqNullSafe(F.col("keep_id"))) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry) if c != id_col],
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs, whatever their names: of each group of equal texts one, also of repeated rows and of rows without an id or text. An empty table gives an empty one."""
    columns = docs.columns
    packed = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(c) for c in columns]).alias("whole_row"))
    return mark_exact_duplicates(packed, id_col, text_col, carry=["whole_row"]).filter("kept").select("whole_row.*")
