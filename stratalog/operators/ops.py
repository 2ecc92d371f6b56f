"""The read operations, each a lazy DataFrame over any event-shaped DataFrame."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from stratalog.operators.predicates import after, long, selection
from stratalog.plans.cursor import Position, check_position, decode_search, encode_search
from stratalog.plans.query import LogQuery, QueryError, check_buckets, default_interval
from stratalog.schema import COLUMNS, FACETS

TOP = 100


def count(events: DataFrame, query: LogQuery, **kw) -> DataFrame:
    return events.filter(selection(query, **kw)).agg(F.count(F.lit(1)).alias("count"))


def facets(events: DataFrame, query: LogQuery, top: int = TOP, names: tuple[str, ...] = FACETS, **kw) -> DataFrame:
    """(facet, value, count, rank): the `top` values of each facet by count, then value; levels tie as numbers; nulls are no values.

    One pass: grouping sets expand each row once per facet and combine map-side, so the shuffle carries distinct values.
    """
    rows = events.filter(selection(query, **kw)).select(*names)
    sets = ", ".join(f"({n})" for n in names)
    bits = {n: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i, n in enumerate(names)}
    listed = ", ".join(names)
    grouped = rows.sparkSession.sql(f"SELECT {listed}, grouping_id({listed}) AS g, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)
    which = F.coalesce(*[F.when(F.col("g") == bits[n], F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col("g") == bits[n], F.col(n).cast("string")) for n in names])
    order = F.when(F.col("g") == bits["level"], F.col("level")) if "level" in names else F.lit(0)
    named = grouped.select(which.alias("facet"), value.alias("value"), "n", order.alias("o")).filter("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "o", "value"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).select("facet", "value", F.col("n").alias("count"), F.col("rank").cast("bigint").alias("rank"))


def bucket(anchor: int, interval: int) -> Column:
    """Start of an event's bucket. Times far from the anchor need more than 64 bits between."""
    t = F.col("event_time")
    if abs(anchor) <= 1 << 61 and interval <= 1 << 61:
        return F.expr(f"(event_time - {anchor}L) div {interval}L * {interval}L + {anchor}L")
    d = "decimal(38,0)"
    return (F.floor((t.cast(d) - F.lit(anchor).cast(d)) / F.lit(interval).cast(d)) * F.lit(interval).cast(d) + F.lit(anchor).cast(d)).cast("bigint")


def histogram(events: DataFrame, query: LogQuery, interval: int | None = None, cutoff: int | None = None, error_level: int | None = None, **kw) -> DataFrame:
    """(time, count) of non-empty buckets, ascending. Anchored at the requested start, though retention may clip the rows; with error_level also (errors)."""
    interval = interval or default_interval(query.start, query.end)
    clipped = query.clipped(cutoff)
    check_buckets(clipped.start, clipped.end, interval)
    more = [F.count_if(F.col("level") >= max(error_level, query.min_level or 0)).alias("errors")] if error_level is not None else []
    rows = events.filter(selection(clipped, **kw)).select(bucket(query.start, interval).alias("time"), "level")
    return rows.groupBy("time").agg(F.count(F.lit(1)).alias("count"), *more).orderBy("time")


def zero_filled(found: DataFrame, query: LogQuery, interval: int) -> DataFrame:
    """All buckets of the range, empty ones with count 0. There are at most 2,000."""
    check_buckets(query.start, query.end, interval)
    spark = found.sparkSession
    times = spark.range(1).select(F.explode(F.sequence(long(query.start), long(query.end - 1), long(interval))).alias("time"))
    return times.join(found, "time", "left").select("time", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def error_share(events: DataFrame, query: LogQuery, level: int = 50, **kw) -> DataFrame:
    """Percentage of events of that level or more; null without events."""
    n = F.count(F.lit(1))
    return events.filter(selection(query, **kw)).agg(n.alias("count"), F.count_if(F.col("level") >= level).alias("errors"), F.try_divide(100.0 * F.count_if(F.col("level") >= level), n).alias("share"))


def search(events: DataFrame, query: LogQuery, high: int | None = None, at: Position | None = None, limit: int | None = None, promoted: tuple[str, ...] = ()) -> DataFrame:
    """A page, newest first, plus one row that tells whether there is more: a TakeOrdered, never a full sort."""
    where = selection(query, high, promoted)
    if at is not None:
        where &= after(at)
    return events.filter(where).select(*COLUMNS).orderBy(F.desc("event_time"), F.desc("id")).limit((limit or query.limit) + 1)


def api_row(events: DataFrame) -> DataFrame:
    """Events as callers see them: ids are strings, attributes parsed."""
    return events.withColumns({"id": F.col("id").cast("string"), "attributes": F.try_parse_json("attributes")})


@dataclass(frozen=True)
class Page:
    events: list[Row]
    next_cursor: str | None


def search_page(events: DataFrame, query: LogQuery, newest: int, cursor: str | None = None, cutoff: int | None = None, promoted: tuple[str, ...] = ()) -> Page:
    """At most 1,001 rows come to the driver. Later pages stay pinned to what was committed when the first was read."""
    at = decode_search(query, cursor) if cursor else None
    if at is not None:
        check_position(query, at, newest, cutoff)
    high = at.high if at is not None else newest
    rows = search(events, query.clipped(cutoff), high, at, query.limit, promoted).collect()
    page = rows[: query.limit]
    more = len(rows) > query.limit
    return Page(page, encode_search(query, Position(high, page[-1]["event_time"], page[-1]["id"])) if more else None)


def tail_page(events: DataFrame, query: LogQuery, resume: int, limit: int | None = None, max_bytes: int | None = None, promoted: tuple[str, ...] = ()) -> DataFrame:
    """Events after an id in the order they came in. The byte budget cuts a page of at most `limit` rows further, so its window is as small."""
    rows = events.filter(selection(query, None, promoted) & (F.col("id") > long(resume))).select(*COLUMNS).orderBy("id").limit(limit or query.limit)
    if max_bytes is None:
        return rows
    size = F.octet_length(F.to_json(F.struct(*COLUMNS)))
    total = F.sum(size).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("bytes_", total).filter(F.col("bytes_") <= max_bytes).drop("bytes_")


def first_expired(events: DataFrame, before: int, most: int) -> DataFrame:
    """Ids of at most so many events older than `before`, the smallest first: a TakeOrdered."""
    return events.filter(F.col("event_time") < long(before)).select("id").orderBy("id").limit(most)


def oldest_batch(events: DataFrame, rows: int) -> DataFrame:
    """(last): the latest time among the so many oldest events; null without events."""
    return events.select("event_time", "id").orderBy("event_time", "id").limit(rows).agg(F.max("event_time").alias("last"))


def estimated_bytes(events: DataFrame, fixed: int = 128) -> DataFrame:
    """(bytes): what events would take in an export, roughly: their texts, and so many bytes a row for the rest."""
    return events.agg(F.sum(F.octet_length("message") + F.octet_length("attributes") + F.octet_length("source") + fixed).alias("bytes"))


def projection_status(stored: DataFrame, tier: str = "tier") -> DataFrame:
    """Rows and covered rows of hot and archived data."""
    return stored.groupBy(tier).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("pa_covered"), F.lit(False))).alias("covered"))


def counter_rate(samples: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Increase per second between two scrapes of a counter; null at the first and after a reset."""
    w = Window.partitionBy(key).orderBy(time)
    dv, dt = F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w)
    return samples.withColumn("rate", F.when((dv >= 0) & (dt > 0), dv * 1000.0 / dt))


#: Relative error of the latency sketch, and the least value that it tells apart, in milliseconds.
SKETCH_ERROR, SKETCH_LEAST = 0.02, 0.002


def latency_sketch(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, bucket, count): values counted in buckets whose bounds grow by the relative error, so sketches add up by bucket. Values up to the least share bucket 0; nulls and NaN count nowhere."""
    v = F.col(value).cast("double")
    bucket = F.when(v <= SKETCH_LEAST, 0).otherwise(F.ceil(F.log(v / SKETCH_LEAST) / math.log1p(SKETCH_ERROR) - 1e-9)).cast("int")
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def sketch_quantile(sketch: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, bound): an upper bound of the quantile, at most the error above it."""
    w = Window.partitionBy(*by).orderBy("bucket")
    total = F.sum("count").over(Window.partitionBy(*by))
    reached = sketch.withColumn("below", F.sum("count").over(w)).withColumn("need", F.greatest(F.ceil(total * q - 1e-9), F.lit(1)))
    return reached.filter("below >= need").groupBy(*by).agg((F.lit(SKETCH_LEAST) * F.pow(F.lit(1 + SKETCH_ERROR), F.min("bucket"))).alias("bound"))


def highlighted(events: DataFrame, needle: str, column: str = "message") -> DataFrame:
    """With column parts: the text parted at each plain occurrence of the needle, as (text, hit) in order; the parts give the text back. An empty needle hits nothing."""
    if not needle:
        parts = F.array(F.struct(F.col(column).alias("text"), F.lit(False).alias("hit")))
    else:
        between = F.split(F.col(column), "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
        pair = lambda x, i: F.when(i == 0, F.array(F.struct(x.alias("text"), F.lit(False).alias("hit")))).otherwise(F.array(F.struct(F.lit(needle).alias("text"), F.lit(True).alias("hit")), F.struct(x.alias("text"), F.lit(False).alias("hit"))))
        parts = F.filter(F.flatten(F.transform(between, pair)), lambda p: p["text"] != "")
    return events.withColumn("parts", parts)


def cumulative_buckets(rows: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Per group and bound the rows at or below it, in one aggregate."""
    counts = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.count_if(F.col(value) <= b).alias("count")) for b in bounds])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), counts.alias("c")).select(*by, "total", F.explode("c").alias("b")).select(*by, "total", "b.bound", "b.count")


def percentile_bound(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The least bound that holds the share q."""
    return buckets.groupBy(*by).agg(F.min(F.when(F.col("count") >= F.col("total") * q, F.col("bound"))).alias("bound"))


def export(events: DataFrame, query: LogQuery, path: str, fmt: str = "json") -> None:
    """The whole selection, newest first, as NDJSON (every member, nulls too) or CSV (quotes doubled, blanks kept, a header in each file; null is an empty field, an empty text is "")."""
    if fmt not in ("json", "csv"):
        raise QueryError("json or csv")
    out = events.filter(selection(query)).select(*COLUMNS).orderBy(F.desc("event_time"), F.desc("id"))
    if fmt == "json":
        out.write.json(path, ignoreNullFields=False)
    else:
        out.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
