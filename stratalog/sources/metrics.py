"""The text form of metrics: one sample a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
_LINE = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(\{{\s*(?:{_PAIR}\s*(?:,\s*|(?=\}})))*\}})?\s*([^\s{{}}]+)(?:\s+(-?[0-9]+))?$"


def _unescaped(c: Column) -> Column:
    """\\n, \\" and \\\\ as what they stand for; a NUL holds the place of a backslash meanwhile."""
    held = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))


def samples(lines: DataFrame) -> DataFrame:
    """(name, labels, value, timestamp) of the lines in column value. Comments, blank and malformed lines give nothing; of a repeated label the last counts."""
    line = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    names = F.regexp_extract_all("labels_", F.lit(_PAIR), F.lit(1))
    texts = F.regexp_extract_all("labels_", F.lit(_PAIR), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), texts.alias("v"))
    last = F.transform(F.array_distinct(F.col("names_")), lambda k: F.element_at(F.filter(F.col("pairs_"), lambda p: p["k"] == k), -1)["v"])
    return (
        lines.select(line.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").rlike(_LINE))
        .select(F.regexp_extract("line", _LINE, 1).alias("name"), F.regexp_extract("line", _LINE, 2).alias("labels_"), F.regexp_extract("line", _LINE, 5).try_cast("double").alias("value"), F.regexp_extract("line", _LINE, 6).try_cast("bigint").alias("timestamp"))
        .filter(F.col("value").isNotNull())
        .select("*", names.alias("names_"), pairs.alias("pairs_"))
        .select("name", F.map_from_arrays(F.array_distinct("names_"), F.transform(last, _unescaped)).alias("labels"), "value", "timestamp")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return samples(spark.read.text(path))


def exposition(rows: DataFrame) -> DataFrame:
    """(value): the line of each (name, labels, value); labels in the order of their names."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    shown = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    number = F.when(F.isnan("value"), "NaN").when(F.col("value") == float("inf"), "+Inf").when(F.col("value") == float("-inf"), "-Inf").otherwise(F.col("value").cast("string"))
    return rows.select(F.concat("name", shown, F.lit(" "), number).alias("value"))
