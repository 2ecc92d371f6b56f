"""Batches of JSON events: an array or one object a line. A batch is taken whole or not at all."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans.query import QueryError
from stratalog.schema import MAX_TIME

#: What a producer's event may name beside free attributes.
_OWN = ("time", "level", "msg", "service", "name", "hostname", "pid")


class Rejected(QueryError):
    """The batch has an event that can't be taken; its index is named."""


@dataclass(frozen=True)
class Limits:
    events: int = 10_000
    message: int = 65_536
    field: int = 1_024
    attributes: int = 65_536
    depth: int = 16
    skew_ms: int = 300_000
    retention_ms: int | None = 7 * 86_400_000


def body_format(content_type: str | None) -> str:
    kind = (content_type or "application/json").partition(";")[0].strip().lower()
    if kind == "application/json":
        return "json"
    if kind in ("application/x-ndjson", "application/ndjson"):
        return "ndjson"
    raise QueryError("Content-Type is application/json or application/x-ndjson")


def _finite(token: str) -> float:
    x = float(token)
    if not math.isfinite(x):
        raise ValueError(f"{token} is out of range")
    return x


def canonical(text: str) -> str:
    """JSON with one spelling for each number and the last of repeated members, refusing what isn't JSON."""

    def refuse(token):
        raise ValueError(f"{token} is no JSON")

    return json.dumps(json.loads(text, parse_constant=refuse, parse_float=_finite), separators=(",", ":"), ensure_ascii=False)


def depth_of(value, limit: int, field: int) -> bool:
    """Whether nesting and the lengths of member names stay within bounds."""
    todo = [(value, 1)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (dict, list)):
            if d > limit:
                return False
            if isinstance(v, dict) and any(len(k.encode()) > field for k in v):
                return False
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return True


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, position) of NDJSON files, blank lines skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select("value", F.monotonically_increasing_id().alias("position"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(value, position) of files that each hold one JSON array."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.from_json("value", "array<variant>", {"mode": "FAILFAST"})
    listed = F.when(F.trim("value").startswith("["), parts).otherwise(F.raise_error(F.lit("the top level is an array")))
    return whole.select(F.posexplode(listed).alias("position", "v")).select(F.to_json("v").alias("value"), F.col("position").cast("bigint").alias("position"))


def too_deep(value: Column, limit: int) -> Column:
    """Whether arrays and objects nest deeper than the limit: without strings, each round takes away the innermost pairs of brackets."""
    plain = F.regexp_replace(value, r'"(?:\\.|[^"\\])*+"', "")
    left = F.translate(F.regexp_replace(plain, r"[^\[\]{}]", ""), "{}", "[]")
    after = left
    for _ in range(limit):
        after = F.replace(after, F.lit("[]"), F.lit(""))
    return (F.length(left) > 2 * limit) & (after != "")


def name_too_long(value: Column, limit: int) -> Column:
    """Whether a member's name, at whatever depth, takes more bytes than the limit."""
    read = lambda n: F.from_json(F.concat(F.lit('["'), n, F.lit('"]')), "array<string>")[0]
    names = F.regexp_extract_all(value, F.lit(r'"((?:\\.|[^"\\])*+)"\s*:'), F.lit(1))
    return (F.octet_length(value) > limit) & F.exists(F.filter(names, lambda n: F.octet_length(n) > limit), lambda n: F.octet_length(read(n)) > limit)


def project(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Events from column value: known members become columns, all others stay in attributes, whatever they are called.

    Columns that a producer can't set (id, source, received_at) come later. bad holds what is wrong with the members.
    """
    m = F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE"})
    rows = lines.withColumn("m", m)
    get = lambda k: F.col("m").getItem(k)
    kind = lambda k: F.schema_of_variant(get(k))
    missing = lambda k: get(k).isNull() | (kind(k) == "VOID")

    def text(k: str) -> Column:
        return F.when(kind(k) == "STRING", F.try_variant_get(get(k), "$", "string"))

    def whole(k: str, cast: str) -> Column:
        return F.when(kind(k) == "BIGINT", F.try_variant_get(get(k), "$", cast))

    bad = F.coalesce(
        F.when(F.col("m").isNull(), "event must be an object"),
        F.when(too_deep(F.col("value"), limits.depth), "event is nested too deeply"),
        F.when(name_too_long(F.col("value"), limits.field), "a member's name is too long"),
        F.when(whole("time", "bigint").isNull(), "time must be integer Unix milliseconds"),
        F.when(~whole("time", "bigint").between(0, MAX_TIME), "time is out of range"),
        F.when(whole("level", "int").isNull() | (whole("level", "int") < 0), "level must be a nonnegative integer"),
        F.when(text("msg").isNull(), "msg is required"),
        *[F.when(~missing(k) & text(k).isNull(), f"{k} must be a string") for k in ("service", "name", "hostname")],
        F.when(~missing("pid") & (whole("pid", "bigint").isNull() | (whole("pid", "bigint") < 0)), "pid must be a nonnegative integer"),
    )
    rest = F.to_json(F.map_filter("m", lambda k, _: ~k.isin(*_OWN)))
    return rows.select(
        *[c for c in lines.columns if c != "value"], whole("time", "bigint").alias("event_time"), whole("level", "int").alias("level"), text("service").alias("service"), text("name").alias("logger"),
        text("hostname").alias("host"), whole("pid", "bigint").alias("pid"), text("msg").alias("message"), F.coalesce(rest, F.lit("{}")).alias("attributes"), bad.alias("bad"),
    )


def reject_reason(limits: Limits = Limits(), now_ms: int | None = None, cutoff: int | None = None, policy: str = "live") -> Column:  # noqa: B008
    """Why an event can't be taken, null if it can. History may be imported whatever its age; live events have to lie in the window."""
    t = F.col("event_time")
    checks = [F.col("bad")]
    if policy == "live" and now_ms is not None:
        if limits.retention_ms is not None:
            checks.append(F.when(t < F.lit(now_ms - limits.retention_ms), "time is older than retention"))
        checks.append(F.when(t > F.lit(now_ms + limits.skew_ms), "time is in the future"))
    if policy == "live" and cutoff is not None:
        checks.append(F.when(t < F.lit(cutoff), "time has expired"))
    checks += [F.when(F.octet_length("message") > limits.message, "msg is too long"), F.when(F.octet_length("attributes") > limits.attributes, "attributes are too long")]
    checks += [F.when(F.octet_length(c) > limits.field, f"{c} is too long") for c in ("service", "logger", "host")]
    return F.coalesce(*checks)


def accept(rows: DataFrame, reason: Column, limits: Limits = Limits(), bounded: bool = True) -> DataFrame:  # noqa: B008
    """The batch, or Rejected naming its first bad event. One aggregate decides; nothing is collected but its row."""
    checked = rows.withColumn("why", reason)
    r = checked.agg(F.count(F.lit(1)).alias("n"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("position"))).alias("why"), F.min(F.when(F.col("why").isNotNull(), F.col("position"))).alias("at")).first()
    if bounded and r["n"] > limits.events:
        raise Rejected(f"batch exceeds {limits.events} events")
    if r["at"] is not None:
        raise Rejected(f"event {r['at']}: {r['why']}")
    return rows.drop("bad")
