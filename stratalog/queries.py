"""The registered queries over the log engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.attributes import as_integer, coverage_holds, parsed, promoted_columns
from stratalog.operators import ops
from stratalog.operators.predicates import long
from stratalog.operators.store import Index, planned_compactions
from stratalog.plans.cursor import Position
from stratalog.plans.query import LogQuery, nice_interval, parse_filter
from stratalog.schema import FACETS
from stratalog.shared import shared_dir
from stratalog.sources.adapters import CONVERSATIONS_SQL, EVENTS_SQL, conversations, events

#: The events begin on 2024-01-01; ranges of the queries below.
DAY, HOUR, T0 = 86_400_000, 3_600_000, 1_704_067_200_000
WIDE = LogQuery(T0 - 365 * DAY, T0 + 730 * DAY)
FIRST = {"start": T0, "end": T0 + 20 * DAY}
_RANGE = f"event_time >= {T0} AND event_time < {T0 + 20 * DAY}"

#: The events as an index gives them numbers: in the order of their ids, from 1.
_STORED = f"{EVENTS_SQL}, s AS (SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id) FROM e)"


def _stored(spark: SparkSession, d: str) -> Index:
    """A new index in the shared folder that holds all events, appended in two batches."""
    index = Index(spark, f"{shared_dir(spark)}/stratalog-index-{uuid.uuid4().hex}")
    e = events(spark, d).withColumn("position", F.col("id"))
    middle = e.agg(((F.min("id") + F.max("id")) / 2).cast("bigint")).first()[0]
    for part in (e.filter(F.col("id") <= long(middle)), e.filter(F.col("id") > long(middle))):
        index.append(part, None, received_at=T0)
    return index


def _row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None, view: str = EVENTS_SQL):
    def register(f):
        _found[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            _sql[f.__name__] = f"WITH {view}, {text[4:].lstrip()}" if text[:5] == "WITH " else f"WITH {view} {text}"
        return f

    return register


def _where(**kw) -> LogQuery:
    return LogQuery(**{**FIRST, **kw})


@_query("SELECT count(*) AS count FROM e")
def count_all(spark, d):
    return ops.count(events(spark, d), WIDE)


@_query(f"SELECT count(*) AS count FROM e WHERE {_RANGE} AND service = 'purchase' AND host = 'u3' AND source IN ('src-0', 'src-2') AND level >= 30 AND contains(message, 'user 1')")
def count_filtered(spark, d):
    return ops.count(events(spark, d), _where(service="purchase", host="u3", sources=("src-0", "src-2"), min_level=30, message="user 1"))


@_query("SELECT count(*) AS count FROM e WHERE contains(message, '100%') OR contains(message, 'en')", CONVERSATIONS_SQL)
def count_message_contains(spark, d):
    e = conversations(spark, d)
    return e.filter(F.contains("message", F.lit("100%")) | F.contains("message", F.lit("en"))).agg(F.count(F.lit(1)).alias("count"))


@_query(f"SELECT value, count(*) AS count FROM (SELECT source AS value FROM e WHERE {_RANGE} AND source IN ('src-1', 'src-2')) GROUP BY value")
def count_source_in(spark, d):
    return ops.facets(events(spark, d), _where(sources=("src-1", "src-2")), names=("source",)).select("value", "count")


@_query("SELECT count(*) AS count FROM e WHERE level >= 3 AND logger = 'assistant'", CONVERSATIONS_SQL)
def count_min_level(spark, d):
    return ops.count(conversations(spark, d), LogQuery(min_level=3, logger="assistant"))


_PAGE = "id, source, event_time, received_at, level, service, logger, host, pid, message, attributes"


@_query(f"SELECT {_PAGE} FROM e WHERE {_RANGE} AND level >= 40 ORDER BY event_time DESC, id DESC LIMIT 51")
def search_page1(spark, d):
    return ops.search(events(spark, d), _where(min_level=40, limit=50))


@_query(f"SELECT {_PAGE} FROM e WHERE {_RANGE} AND (event_time < {T0 + 9 * DAY} OR event_time = {T0 + 9 * DAY} AND id < 500) ORDER BY event_time DESC, id DESC LIMIT 101")
def search_page_keyset(spark, d):
    return ops.search(events(spark, d), _where(), at=Position(1 << 60, T0 + 9 * DAY, 500))


@_query("WITH h AS (SELECT max(id) // 2 AS high FROM e) SELECT " + _PAGE + " FROM e, h WHERE id <= high ORDER BY event_time DESC, id DESC LIMIT 21")
def search_highwater(spark, d):
    e = events(spark, d)
    high = e.agg((F.max("id") / 2).cast("bigint")).first()[0]
    return ops.search(e, LogQuery(WIDE.start, WIDE.end, limit=20), high=high)


@_query("SELECT CAST(id AS VARCHAR) AS id, level, message FROM e ORDER BY event_time DESC, id DESC LIMIT 11")
def api_rows(spark, d):
    return ops.api_row(ops.search(events(spark, d), LogQuery(WIDE.start, WIDE.end, limit=10))).select("id", "level", "message")


@_query(f"SELECT {_PAGE} FROM e WHERE id > 200 AND service = 'click' ORDER BY id LIMIT 100")
def tail_after(spark, d):
    return ops.tail_page(events(spark, d), LogQuery(WIDE.start, WIDE.end, service="click"), 200)


def _json_size(numbers: str, texts: str) -> str:
    """Bytes of a row as JSON: members that are null are left out; the texts here need escapes for quotation marks only."""
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) + {len(c) + 4}, 0)" for c in numbers.split()]
    parts += [f"coalesce(octet_length(encode({c})) + length({c}) - length(replace({c}, chr(34), '')) + {len(c) + 6}, 0)" for c in texts.split()]
    return " + ".join(parts) + " + 1"


@_query(f"WITH p AS (SELECT * FROM e WHERE id > 50 ORDER BY id LIMIT 80), t AS (SELECT id, sum({_json_size('id event_time received_at level pid', 'source service logger host message attributes')}) OVER (ORDER BY id) AS total FROM p) SELECT id FROM t WHERE total <= 9000")
def tail_byte_budget(spark, d):
    return ops.tail_page(events(spark, d), LogQuery(WIDE.start, WIDE.end), 50, 80, max_bytes=9_000).select("id")


def _facets_sql(where: str, top: int = 100) -> str:
    one = "SELECT '{0}' AS facet, CAST({0} AS VARCHAR) AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {0}) AS rank FROM e WHERE ({1}) AND {0} IS NOT NULL GROUP BY {0}"
    return f"SELECT * FROM ({' UNION ALL '.join(one.format(n, where) for n in FACETS)}) WHERE rank <= {top}"


@_query(_facets_sql("true"))
def facets_all(spark, d):
    return ops.facets(events(spark, d), WIDE)


@_query(_facets_sql(f"{_RANGE} AND level >= 20 AND source IN ('src-0', 'src-1')"))
def facets_filtered(spark, d):
    return ops.facets(events(spark, d), _where(min_level=20, sources=("src-0", "src-1")))


@_query(_facets_sql("true", 3), CONVERSATIONS_SQL)
def facets_top(spark, d):
    return ops.facets(conversations(spark, d), LogQuery(), top=3)


@_query("WITH u AS (SELECT 'user-' || pid AS value, count(*) AS count FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank FROM u) SELECT 'logger' AS facet, value, count, rank FROM r WHERE rank <= 100")
def facets_top100(spark, d):
    e = events(spark, d).withColumn("logger", F.concat(F.lit("user-"), F.col("pid").cast("string")))
    return ops.facets(e, WIDE, names=("logger",))


def _histogram_sql(anchor: int, interval: int, where: str, more: str = "") -> str:
    return f"SELECT (event_time - {anchor}) // {interval} * {interval} + {anchor} AS time, count(*) AS count{more} FROM e WHERE {where} GROUP BY 1"


@_query(_histogram_sql(T0, HOUR, _RANGE))
def histogram_1h(spark, d):
    return ops.histogram(events(spark, d), _where(), HOUR)


@_query(_histogram_sql(T0 + 12_345, 7_777_777, f"event_time >= {T0 + 12_345} AND event_time < {T0 + 20 * DAY}"))
def histogram_anchor_unaligned(spark, d):
    return ops.histogram(events(spark, d), _where(start=T0 + 12_345), 7_777_777)


@_query(f"SELECT t AS time, coalesce(count, 0) AS count FROM (SELECT unnest(range({T0}, {T0 + 20 * DAY}, {6 * HOUR})) AS t) LEFT JOIN ({_histogram_sql(T0, 6 * HOUR, _RANGE)}) h ON t = time")
def histogram_zero_filled(spark, d):
    return ops.zero_filled(ops.histogram(events(spark, d), _where(), 6 * HOUR), _where(), 6 * HOUR)


@_query(_histogram_sql(T0, DAY, _RANGE, ", count(*) FILTER (level >= 50) AS errors"))
def histogram_errors(spark, d):
    return ops.histogram(events(spark, d), _where(), DAY, error_level=50)


@_query(_histogram_sql(T0, nice_interval(T0, T0 + 20 * DAY), _RANGE))
def histogram_nice_interval(spark, d):
    return ops.histogram(events(spark, d), _where(), nice_interval(T0, T0 + 20 * DAY))


@_query(f"SELECT sum(count)::BIGINT AS count FROM ({_histogram_sql(T0, HOUR, _RANGE)})")
def bucket_sum(spark, d):
    return ops.histogram(events(spark, d), _where(), HOUR).agg(F.sum("count").alias("count"))


@_query("SELECT count(*) AS count, count(*) FILTER (level >= 50) AS errors, 100.0::DOUBLE * count(*) FILTER (level >= 50) / count(*) AS share FROM e")
def error_share(spark, d):
    return ops.error_share(events(spark, d), WIDE)


#: Rows with attributes of all kinds.
_MIXED = """m AS (
  SELECT o_orderkey AS id, o_custkey AS c,
    CASE o_orderkey % 8 WHEN 0 THEN '{"k":1,"s":"a"}' WHEN 1 THEN '{"k":1.0,"s":"b"}' WHEN 2 THEN '{"k":"1","s":"a"}' WHEN 3 THEN '{"k":true,"s":"a"}'
      WHEN 4 THEN '{"k":1.5}' WHEN 5 THEN '{"k":null,"a.b":"x","s":"a"}' WHEN 6 THEN '["s",1]' ELSE '{"k":10e-1,"s":{"s":"a"}}' END AS attributes
  FROM orders)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    forms = ['{"k":1,"s":"a"}', '{"k":1.0,"s":"b"}', '{"k":"1","s":"a"}', '{"k":true,"s":"a"}', '{"k":1.5}', '{"k":null,"a.b":"x","s":"a"}', '["s",1]', '{"k":10e-1,"s":{"s":"a"}}']
    a = F.lit(forms[7])
    for i in reversed(range(7)):
        a = F.when(F.col("id") % 8 == i, F.lit(forms[i])).otherwise(a)
    m = o.select("id", a.alias("attributes"))
    return m.select(F.col("id").cast("bigint").alias("id"), F.lit("s").alias("source"), long(T0).alias("event_time"), F.lit(30).alias("level"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("logger"), F.lit(None).cast("string").alias("host"), F.lit("m").alias("message"), "attributes")


def _attr(name: str, filter_: str, where: str) -> None:
    def run(spark, d):
        return _mixed(spark, d).filter(ops.selection(LogQuery(T0, T0 + 1, attributes=parse_filter(filter_)))).groupBy((F.col("id") % 8).cast("bigint").alias("form")).agg(F.count(F.lit(1)).alias("count"))

    run.__name__ = name
    _query(f"SELECT id % 8 AS form, count(*) AS count FROM m WHERE {where} GROUP BY 1", _MIXED)(run)


_eq = '{"attributes":[{"key":"%s","op":"eq","value":%s}]}'
_attr("attr_string_eq", _eq % ("s", '"a"'), "json_type(attributes, '$.s') = 'VARCHAR' AND attributes ->> '$.s' = 'a'")
_attr("attr_int_eq", _eq % ("k", "1"), "json_type(attributes, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(attributes ->> '$.k' AS DOUBLE) = 1")
_attr("attr_float_eq", _eq % ("k", "1.5"), "json_type(attributes, '$.k') = 'DOUBLE' AND TRY_CAST(attributes ->> '$.k' AS DOUBLE) = 1.5")
_attr("attr_bool_eq", _eq % ("k", "true"), "json_type(attributes, '$.k') = 'BOOLEAN' AND attributes ->> '$.k' = 'true'")
_attr("attr_pair_and", '{"attributes":[{"key":"s","op":"eq","value":"a"},{"key":"a.b","op":"eq","value":"x"}]}', """json_type(attributes, '$.s') = 'VARCHAR' AND attributes ->> '$.s' = 'a' AND attributes ->> '$."a.b"' = 'x'""")
@_query("""SELECT id % 8 AS form, count(*) AS count, count(*) FILTER (json_type(attributes) = 'OBJECT' AND attributes ->> '$.s' = 'a' AND json_type(attributes, '$.s') = 'VARCHAR') AS hits, count(*) FILTER (json_type(attributes) = 'OBJECT' AND attributes ->> '/0' = 's') AS places FROM m GROUP BY 1""", _MIXED)
def attr_root_guard(spark, d):
    """Members of the root object match; places of a root array never do."""
    member, place = (ops.selection(LogQuery(T0, T0 + 1, attributes=parse_filter(_eq % x))) for x in (("s", '"a"'), ("0", '"s"')))
    return _mixed(spark, d).groupBy((F.col("id") % 8).cast("bigint").alias("form")).agg(F.count(F.lit(1)).alias("count"), F.count_if(member).alias("hits"), F.count_if(place).alias("places"))


@_query("SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS count FROM events WHERE CAST(props ->> '$.k' AS BIGINT) >= 50 GROUP BY 1")
def nested_attr_range(spark, d):
    k = F.try_variant_get(F.try_parse_json("attributes"), "$.k", "double")
    return events(spark, d).withColumn("d", k).filter("d >= 50").groupBy(F.col("d").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("count"))


@_query("SELECT service, count(*) AS count FROM e WHERE CAST(attributes ->> '$.k' AS DOUBLE) >= 10 GROUP BY 1")
def group_by_attribute_threshold(spark, d):
    hit = as_integer(parsed(F.col("attributes")).getItem("k")) >= 10
    return events(spark, d).filter(hit).groupBy("service").agg(F.count(F.lit(1)).alias("count"))


@_query("SELECT service, count(*) AS count FROM e WHERE regexp_matches(message, 'CLICK|Purchase', 'i') GROUP BY 1")
def regex_ci(spark, d):
    return events(spark, d).filter(F.col("message").rlike("(?i)CLICK|Purchase")).groupBy("service").agg(F.count(F.lit(1)).alias("count"))


@_query("SELECT service, count(*) AS count FROM e WHERE service = 'click' OR service = 'error' GROUP BY 1")
def or_filter(spark, d):
    return events(spark, d).filter((F.col("service") == "click") | (F.col("service") == "error")).groupBy("service").agg(F.count(F.lit(1)).alias("count"))


@_query("SELECT level, count(*) AS count FROM e WHERE NOT contains(message, 'click') AND level <> 50 GROUP BY 1")
def not_filter(spark, d):
    return events(spark, d).filter(~F.contains("message", F.lit("click")) & (F.col("level") != 50)).groupBy("level").agg(F.count(F.lit(1)).alias("count"))


@_query(_histogram_sql(T0, DAY, f"event_time >= {T0 + 5 * DAY + 77} AND event_time < {T0 + 20 * DAY}"))
def retention_clip(spark, d):
    return ops.histogram(events(spark, d), _where(), DAY, cutoff=T0 + 5 * DAY + 77)


@_query(f"SELECT coalesce(max(id), 0)::BIGINT AS expired_through, count(*) AS rows, (SELECT count(*) FROM s WHERE event_time >= {T0 + 5 * DAY}) AS kept FROM s WHERE event_time < {T0 + 5 * DAY}", _STORED)
def retention_expired_max_id(spark, d):
    index = _stored(spark, d)
    rows = index.retain(T0 + 5 * DAY)
    return _row(spark, "expired_through long, rows long, kept long", index.manifest().expired_through, rows, index.count(WIDE).first()[0])


@_query(f"SELECT max(id) AS last, count(*) AS rows FROM (SELECT id FROM s WHERE event_time < {T0 + 9 * DAY} ORDER BY id LIMIT 700)", _STORED)
def bounded_max_id(spark, d):
    index = _stored(spark, d)
    rows = index.delete_hot(T0 + 9 * DAY, 700)
    return _row(spark, "last long, rows long", index.manifest().expired_through, rows)


@_query("SELECT count(*) AS kept, min(event_time) AS first FROM s WHERE event_time > (SELECT max(event_time) FROM (SELECT event_time FROM s ORDER BY event_time, id LIMIT 700))", _STORED)
def oldest_hot_batch(spark, d):
    index = _stored(spark, d)
    index.enforce_size(0, rounds=1, batch=700)
    return index.read(WIDE).agg(F.count(F.lit(1)).alias("kept"), F.min("event_time").alias("first"))


def _parts(spark: SparkSession, parts: tuple[Part, ...]) -> DataFrame:
    return spark.createDataFrame([(p.path, p.rows, p.min_time, p.max_time, p.min_id, p.max_id, p.bytes) for p in parts], "path string, rows long, min_time long, max_time long, min_id long, max_id long, bytes long")


@_query(f"SELECT sum(n)::BIGINT AS rows, min(min_time) AS min_time, max(max_time) AS max_time, min(min_id) AS min_id, max(max_id) AS max_id FROM (SELECT count(*) AS n, min(event_time) AS min_time, max(event_time) AS max_time, min(id) AS min_id, max(id) AS max_id FROM s WHERE event_time < {T0 + 20 * DAY})", _STORED)
def archive_window_stats(spark, d):
    index = _stored(spark, d)
    index.archive(T0 + 20 * DAY)
    return _parts(spark, index.manifest().archives).agg(F.sum("rows").alias("rows"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))


@_query("SELECT sum(octet_length(encode(message)) + octet_length(encode(attributes)) + octet_length(encode(source)) + 128)::BIGINT AS bytes FROM s", _STORED)
def archive_byte_estimate(spark, d):
    return ops.estimated_bytes(_stored(spark, d).read(WIDE))


@_query(f"SELECT event_time - event_time % {HOUR} AS partition_start, count(*) AS rows, min(id) AS min_id, max(id) AS max_id FROM s WHERE event_time < {T0 + 20 * DAY} GROUP BY 1", _STORED)
def archive_partition_plan(spark, d):
    index = _stored(spark, d)
    index.archive(T0 + 20 * DAY)
    files = _parts(spark, index.manifest().archives).withColumn("partition_start", F.regexp_extract("path", r"part=(-?\d+)/", 1).cast("bigint"))
    return files.groupBy("partition_start").agg(F.sum("rows").alias("rows"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))


@_query(f"SELECT CASE WHEN event_time < {T0 + 10 * DAY} THEN 'archive' ELSE 'hot' END AS tier, count(*) AS rows, count(*) FILTER (event_time >= {T0 + 10 * DAY} AND id > (SELECT count(*) FROM s)) AS covered FROM s2 GROUP BY 1", f"{_STORED}, s2 AS (SELECT id, event_time FROM s UNION ALL SELECT id + (SELECT count(*) FROM s), event_time FROM s WHERE event_time >= {T0 + 10 * DAY})")
def archive_union_by_name(spark, d):
    """Files from before and after keys were promoted, hot and archived, read as one table."""
    index = _stored(spark, d)
    index.archive(T0 + 10 * DAY)
    index.promote(("k",))
    index.append(events(spark, d).filter(F.col("event_time") >= long(T0 + 10 * DAY)).withColumn("position", F.col("id")), None, received_at=T0)
    return index.projection_status()


_KEY = ("s",)


@_query("SELECT count(*) AS count FROM m WHERE json_type(attributes, '$.s') = 'VARCHAR' AND attributes ->> '$.s' = 'a'", _MIXED)
def promoted_eq(spark, d):
    rows = _mixed(spark, d).withColumns(promoted_columns(_KEY))
    return ops.count(rows, LogQuery(T0, T0 + 1, attributes=parse_filter(_eq % ("s", '"a"'))), promoted=_KEY)


@_query("SELECT count(*) AS count FROM m WHERE json_type(attributes, '$.s') = 'VARCHAR' AND attributes ->> '$.s' = 'a'", _MIXED)
def promoted_uncovered_union(spark, d):
    rows = _mixed(spark, d)
    both = rows.filter("id % 3 = 0").withColumns(promoted_columns(_KEY)).unionByName(rows.filter("id % 3 <> 0"), allowMissingColumns=True)
    return ops.count(both, LogQuery(T0, T0 + 1, attributes=parse_filter(_eq % ("s", '"a"'))), promoted=_KEY)


@_query("SELECT count(*) AS rows, 0::BIGINT AS invalid FROM m", _MIXED)
def promoted_coverage_check(spark, d):
    rows = _mixed(spark, d).withColumns(promoted_columns(_KEY))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~coverage_holds(_KEY)).alias("invalid"))


@_query("SELECT CASE WHEN id % 4 = 0 THEN 'hot' ELSE 'archive' END AS tier, count(*) AS rows, count(*) FILTER (id % 3 = 0) AS covered FROM e GROUP BY 1")
def projection_status(spark, d):
    rows = events(spark, d).withColumns({"tier": F.when(F.col("id") % 4 == 0, "hot").otherwise("archive"), "pa_covered": F.when(F.col("id") % 3 == 0, F.lit(True))})
    return ops.projection_status(rows)


@_query("""SELECT role, CASE lower(role) WHEN 'trace' THEN 10 WHEN 'debug' THEN 20 WHEN 'user' THEN 30 WHEN 'system' THEN 40 ELSE 50 END AS level, count(*) AS count FROM conversations GROUP BY 1, 2""", "z AS (SELECT 1)")
def level_mapping(spark, d):
    from stratalog.functions.levels import level_of

    c = spark.read.parquet(f"{d}/conversations.parquet")
    name = F.when(F.col("role") == "user", "INFO").when(F.col("role") == "system", "Warning").otherwise("error")
    return c.groupBy("role", level_of(name).alias("level")).agg(F.count(F.lit(1)).alias("count"))


@_query("SELECT event_type AS service, count(*) AS accepted, sum(user_id)::BIGINT AS pids, min(epoch_us(ts) // 1000) AS first_time, max('{\"extra\":' || user_id % 10 || '}') AS attributes FROM events GROUP BY 1", "z AS (SELECT 1)")
def import_pino_projection(spark, d):
    from stratalog.sources.ingest import project, reject_reason

    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.to_json(F.struct(F.expr("unix_micros(cast(ts as timestamp)) div 1000L").alias("time"), F.lit(30).alias("level"), F.lit("m").alias("msg"), F.col("event_type").alias("service"), F.col("user_id").alias("pid"), (F.col("user_id") % 10).alias("extra")))
    rows = project(e.select(line.alias("value")))
    return rows.filter(reject_reason().isNull()).groupBy("service").agg(F.count(F.lit(1)).alias("accepted"), F.sum("pid").alias("pids"), F.min("event_time").alias("first_time"), F.max("attributes").alias("attributes"))


@_query("WITH f AS (SELECT o_custkey AS part, o_orderkey AS path, cast(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), r AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS total FROM f WINDOW w AS (PARTITION BY part ORDER BY bytes, path)) SELECT part, count(*) AS files, max(total)::BIGINT AS bytes FROM r WHERE n <= 16 AND total <= 500000 GROUP BY part HAVING count(*) >= 2", "z AS (SELECT 1)")
def compaction_candidates(spark, d):
    """The plan for a listing whose files are the orders, a customer being a partition of time."""
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("bigint").alias("bytes"))
    return planned_compactions(files, size=500_000).groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@_query(f"SELECT count(*) AS rows, max(id) AS last, sum(event_time)::BIGINT AS times FROM s WHERE event_time < {T0 + 20 * DAY}", _STORED)
def compacted_rows(spark, d):
    index = _stored(spark, d)
    middle = index.manifest().hot[0].max_time
    index.archive(min(middle, T0 + 20 * DAY))
    index.archive(T0 + 20 * DAY)
    index.compact()
    index.verify()
    return index.read(WIDE).filter(F.col("event_time") < long(T0 + 20 * DAY)).agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("last"), F.sum("event_time").alias("times"))


@_query("SELECT event_type AS service, count(*) AS n, true AS within FROM events WHERE value > 0 GROUP BY 1", "z AS (SELECT 1)")
def latency_sketch_bounds(spark, d):
    """Whether the sketch's bound of the 95th percentile lies within its error above the exact one."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("service"), "value").filter("value > 0")
    bound = ops.sketch_quantile(ops.latency_sketch(e, "value", ["service"]), 0.95, ["service"])
    exact = e.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("exact"))
    return exact.join(bound, "service").select("service", "n", ((F.col("exact") <= F.col("bound") * (1 + 1e-9)) & (F.col("bound") <= F.col("exact") * (1 + ops.SKETCH_ERROR) + ops.SKETCH_LEAST)).alias("within"))


@_query("SELECT message, (length(message) - length(replace(message, 'er', ''))) // 2 AS hits, message AS back, count(*) AS n FROM e GROUP BY 1")
def highlight_split(spark, d):
    parts = ops.highlighted(events(spark, d).groupBy("message").agg(F.count(F.lit(1)).alias("n")), "er")
    return parts.select("message", F.size(F.filter("parts", lambda p: p["hit"])).cast("bigint").alias("hits"), F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("back"), "n")


@_query("WITH s AS (SELECT user_id AS key, event_id AS time, (event_id * 37) % 1000 AS value FROM events), r AS (SELECT *, value - lag(value) OVER w AS dv, time - lag(time) OVER w AS dt FROM s WINDOW w AS (PARTITION BY key ORDER BY time)) SELECT count(*) AS samples, count(*) FILTER (dv >= 0 AND dt > 0) AS rates, max(dv * 1000.0::DOUBLE / dt) FILTER (dv >= 0 AND dt > 0) AS top FROM r", "z AS (SELECT 1)")
def counter_rate(spark, d):
    s = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("time"), (F.col("event_id") * 37 % 1000).alias("value"))
    return ops.counter_rate(s, "key", "time", "value").agg(F.count(F.lit(1)).alias("samples"), F.count("rate").alias("rates"), F.max("rate").alias("top"))


_BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500, 1000]


@_query(f"WITH b AS (SELECT unnest({_BOUNDS}) AS bound), t AS (SELECT event_type, count(*) AS total FROM events GROUP BY 1), c AS (SELECT e.event_type, bound, count(*) FILTER (value <= bound) AS n FROM events e, b GROUP BY 1, 2) SELECT event_type AS service, min(bound)::DOUBLE AS bound FROM c JOIN t USING (event_type) WHERE n >= total * 0.95 GROUP BY 1", "z AS (SELECT 1)")
def latency_percentile_bound(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("service"), "value")
    return ops.percentile_bound(ops.cumulative_buckets(e, "value", _BOUNDS, ["service"]), 0.95, ["service"]).filter("bound IS NOT NULL")


@_query("SELECT id FROM s WHERE id NOT IN (SELECT id FROM s WHERE event_time < 1706000000000 ORDER BY id LIMIT 300)", _STORED)
def bounded_delete(spark, d):
    index = _stored(spark, d)
    index.delete_hot(1_706_000_000_000, 300)
    return index.read(WIDE).select("id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
