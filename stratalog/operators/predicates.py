"""LogQuery -> Column. Core columns are compared as they are stored, so their predicates reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.attributes import matches, parsed
from stratalog.plans.cursor import Position
from stratalog.plans.query import LogQuery


def long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def in_range(start: int, end: int) -> Column:
    return (F.col("event_time") >= long(start)) & (F.col("event_time") < long(end))


def attribute_conditions(query: LogQuery, promoted: tuple[str, ...] = ()) -> Column | None:
    """Strings under promoted keys compare with their slot where the row is covered, with the JSON elsewhere; the JSON is parsed once."""
    hit: Column | None = None
    m = parsed(F.col("attributes"))
    for c in query.attributes:
        one = matches(m, c)
        if c.key in promoted and isinstance(c.value, str):
            covered = F.coalesce(F.col("pa_covered"), F.lit(False))
            one = (covered & F.coalesce(F.col(f"pa_{promoted.index(c.key)}") == F.lit(c.value), F.lit(False))) | (~covered & one)
        hit = one if hit is None else hit & one
    return hit


def may_hold(query: LogQuery) -> list[Column]:
    """Cheap tests on the JSON's text that whatever matches passes: a key stands there between quotation marks, unless the text has escapes."""
    a = F.col("attributes")
    plain = [c.key for c in query.attributes if all(ch >= " " and ch not in '"\\' for ch in c.key)]
    return [F.contains(a, F.lit(f'"{k}"')) | F.contains(a, F.lit("\\")) for k in plain]


def selection(query: LogQuery, high: int | None = None, promoted: tuple[str, ...] = ()) -> Column:
    where = in_range(query.start, query.end)
    if high is not None:
        where &= F.col("id") <= long(high)
    if query.sources:
        where &= F.col("source").isin(*query.sources)
    for name in ("service", "logger", "host"):
        if (v := getattr(query, name)) is not None:
            where &= F.col(name) == F.lit(v)
    if query.min_level is not None:
        where &= F.col("level") >= F.lit(query.min_level)
    if query.message is not None:
        where &= F.contains(F.col("message"), F.lit(query.message))
    for cheap in may_hold(query):  # before the JSON is parsed
        where &= cheap
    if (attrs := attribute_conditions(query, promoted)) is not None:
        where &= attrs
    return where


def after(at: Position) -> Column:
    """What follows a position, newest first."""
    t, i = long(at.time), long(at.id)
    return (F.col("event_time") < t) | ((F.col("event_time") == t) & (F.col("id") < i))
