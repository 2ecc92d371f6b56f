"""A validated selection of events. Requests become a LogQuery on the driver; a LogQuery becomes a Column."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from stratalog.schema import MAX_TIME

MAX_SPAN, MAX_LIMIT, MAX_SOURCES, MAX_BUCKETS = 31 * 86_400_000, 1_000, 128, 2_000
MAX_CONDITIONS, MAX_KEY, MAX_STRING, MAX_NUMBER, MAX_DOCUMENT = 16, 256, 1_024, 128, 4_096


class QueryError(ValueError):
    """The request can't be answered as it stands."""


class Forbidden(PermissionError):
    """The caller's scope doesn't reach so far."""


class Expired(QueryError):
    """A position lies in what retention has removed."""


class Gap(Expired):
    """A tail can't go on without missing events."""


class Float(float):
    """A literal that is compared as a double, not as an integer."""


class _Number(str):
    pass


@dataclass(frozen=True)
class Condition:
    key: str
    value: str | bool | int | Float

    def identity(self) -> list:
        v = self.value
        if isinstance(v, bool):
            kind = ["boolean", v]
        elif isinstance(v, str):
            kind = ["string", v]
        elif isinstance(v, Float):
            kind = ["float", struct.pack(">d", v).hex()]
        else:
            kind = ["integer", str(v)]
        return [self.key, kind]


def number(token: str) -> int | Float:
    """Integers of 64 bits, signed or not, stay exact; whole doubles in [-2^63, 2^64) are integers; the rest are doubles."""
    if len(token) > MAX_NUMBER:
        raise QueryError(f"number exceeds {MAX_NUMBER} characters")
    if re.fullmatch(r"-?\d+", token) and -(1 << 63) <= int(token) < 1 << 64:
        return int(token)
    x = float(token)
    if not math.isfinite(x):
        raise QueryError("number is out of range")
    if x == math.floor(x) and -(2.0**63) <= x < 2.0**64:
        return int(x)
    return Float(x)


def _octets(text: str) -> int:
    try:
        return len(text.encode())
    except UnicodeEncodeError as e:
        raise QueryError("filter: a lone surrogate is no text") from e


def parse_filter(document: str) -> tuple[Condition, ...]:
    """{"attributes": [{"key", "op": "eq", "value"}]} -> conditions sorted by key, equal repeats merged."""
    if _octets(document) > MAX_DOCUMENT:
        raise QueryError(f"filter exceeds {MAX_DOCUMENT} bytes")

    def members(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise QueryError("filter: duplicate member")
        return out

    def refuse(token):
        raise QueryError(f"filter: {token} is no number")

    try:
        root = json.loads(document, object_pairs_hook=members, parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise QueryError(f"filter is no JSON: {e}") from e
    if not isinstance(root, dict) or set(root) != {"attributes"} or not isinstance(root["attributes"], list):
        raise QueryError("filter: an object with the one member attributes, a list")
    if len(root["attributes"]) > MAX_CONDITIONS:
        raise QueryError(f"filter.attributes: more than {MAX_CONDITIONS} conditions")
    found: dict[str, Condition] = {}
    for i, c in enumerate(root["attributes"]):
        at = f"filter.attributes[{i}]"
        if not isinstance(c, dict) or set(c) != {"key", "op", "value"}:
            raise QueryError(f"{at}: key, op and value")
        if c["op"] != "eq":
            raise QueryError(f"{at}.op: only eq")
        if not isinstance(c["key"], str) or isinstance(c["key"], _Number) or not 1 <= _octets(c["key"]) <= MAX_KEY:
            raise QueryError(f"{at}.key: a string of 1 to {MAX_KEY} bytes")
        v = c["value"]
        if isinstance(v, _Number):
            v = number(v)
        elif isinstance(v, str):
            if _octets(v) > MAX_STRING:
                raise QueryError(f"{at}.value: more than {MAX_STRING} bytes")
        elif not isinstance(v, bool):
            raise QueryError(f"{at}.value: a string, boolean or number")
        new = Condition(c["key"], v)
        if (old := found.get(new.key)) is not None and old.identity() != new.identity():
            raise QueryError("filter.attributes: conflicting values for the same key")
        found[new.key] = new
    return tuple(found[k] for k in sorted(found, key=str.encode))


_DURATION = re.compile(r"(\d+)(ms|s|m|h|d|w)")
_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    m = _DURATION.fullmatch(text)
    if not m or int(m[1]) == 0:
        raise QueryError(f"no duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def since(now_ms: int, text: str = "1h") -> tuple[int, int]:
    """[from, to) that ends now."""
    return max(0, now_ms - duration_ms(text)), now_ms


@dataclass(frozen=True)
class LogQuery:
    start: int = 0
    end: int = MAX_TIME
    sources: tuple[str, ...] = ()
    service: str | None = None
    logger: str | None = None
    host: str | None = None
    message: str | None = None
    min_level: int | None = None
    attributes: tuple[Condition, ...] = ()
    limit: int = 100
    scope: tuple[str, ...] = field(default=("internal",))

    def identity(self, kind: str) -> str:
        """Canonical JSON of all that decides the result, for search or tail."""
        some = lambda v: ["none"] if v is None else ["some", v]
        ordering = {"search": "search:event_time_desc,id_desc", "tail": "tail:id_asc"}[kind]
        sources = ["only", sorted(set(self.sources), key=str.encode)] if self.sources else ["all"]
        window = [str(self.start), str(self.end), str(self.limit)] if kind == "search" else []
        parts = [1, ordering, list(self.scope), sources, *map(some, (self.service, self.logger, self.host, self.message, self.min_level)), [c.identity() for c in self.attributes], window]
        return json.dumps(parts, separators=(",", ":"), ensure_ascii=False)

    def clipped(self, cutoff: int | None) -> LogQuery:
        """With `from` raised to the committed retention cutoff."""
        return self if cutoff is None else replace(self, start=max(self.start, cutoff))


def whole_number(params: dict, name: str, default: int | None = None) -> int | None:
    """A parameter that is an integer or its digits."""
    value = params.get(name, default)
    if value is None or type(value) is int:
        return value
    if not isinstance(value, str) or not re.fullmatch(r"-?[0-9]{1,19}", value):
        raise QueryError(f"{name} is no integer")
    return int(value)


_PARAMETERS = {"from", "to", "source", "service", "logger", "host", "message", "min_level", "filter", "limit", "cursor", "interval"}


def request(params: dict, *, scope: Iterable[str] | None = None, index: str = "default", indexes: Iterable[str] | None = None) -> LogQuery:
    """Validate request parameters. scope: the sources that the caller may read, None being all; indexes likewise."""
    if unknown := set(params) - _PARAMETERS:
        raise QueryError(f"unknown parameter {min(unknown)}")
    if indexes is not None and (allowed := set(indexes)) and index not in allowed:
        raise Forbidden(f"index {index}")
    start, end = whole_number(params, "from"), whole_number(params, "to")
    if start is None or end is None:
        raise QueryError("from and to are required")
    if not 0 <= start < end <= MAX_TIME:
        raise QueryError("0 <= from < to <= 253402300799999")
    if end - start > MAX_SPAN:
        raise QueryError("the range exceeds 31 days")
    limit = whole_number(params, "limit", 100)
    if limit is None or not 1 <= limit <= MAX_LIMIT:
        raise QueryError(f"limit is 1 to {MAX_LIMIT}")
    sources = params.get("source") or ()
    sources = (sources,) if isinstance(sources, str) else tuple(sources)
    if len(sources) > MAX_SOURCES:
        raise QueryError(f"more than {MAX_SOURCES} sources")
    if scope is not None:
        mine = tuple(scope)
        if outside := set(sources) - set(mine):
            raise Forbidden(f"source {min(outside)}")
        sources = sources or mine
    level = whole_number(params, "min_level")
    if level is not None and not 0 <= level < 1 << 31:
        raise QueryError("min_level is nonnegative")
    return LogQuery(
        start, end, sources, params.get("service"), params.get("logger"), params.get("host"), params.get("message"), level,
        parse_filter(params["filter"]) if params.get("filter") else (), limit, ("legacy", "default") if index == "default" else ("named", index),
    )


def default_interval(start: int, end: int) -> int:
    """A minute, or so long that there are 2,000 buckets at most."""
    return max(60_000, -(-(end - start) // MAX_BUCKETS))


def check_buckets(start: int, end: int, interval: int) -> None:
    if interval <= 0 or -(-(end - start) // interval) > MAX_BUCKETS:
        raise QueryError(f"more than {MAX_BUCKETS} buckets")


#: Round steps of a histogram, in milliseconds: seconds, minutes, hours, days.
_NICE = [u * n for u, ns in ((1_000, (1, 2, 5, 10, 15, 30)), (60_000, (1, 2, 5, 10, 15, 30)), (3_600_000, (1, 2, 3, 6, 12)), (86_400_000, (1, 2, 7))) for n in ns]


def nice_interval(start: int, end: int, target: int = 60) -> int:
    """The least round step that gives no more than `target` buckets."""
    return next((s for s in _NICE if -(-(end - start) // s) <= target), _NICE[-1])
