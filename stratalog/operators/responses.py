"""Answers as callers get them: JSON documents and, for people, tables of text."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row

from stratalog.operators.ops import Page
from stratalog.schema import FACETS

#: Fixed by the format: each facet is listed under its plural.
_PLURAL = {f: f + "s" for f in FACETS}


def _event(row: Row) -> dict:
    """Ids are strings, since callers may read numbers as doubles; attributes are what they say, or their text where that isn't JSON."""
    e = row.asDict()
    try:
        attributes = json.loads(e["attributes"])
    except ValueError:
        attributes = e["attributes"]
    return {**e, "id": str(e["id"]), "attributes": attributes}


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def page_json(page: Page) -> str:
    """{"events": [...], "next_cursor": token or null}; a page has at most 1,000 events."""
    return _json({"events": [_event(r) for r in page.events], "next_cursor": page.next_cursor})


def count_json(found: DataFrame) -> str:
    return _json({"count": found.first()["count"]})


def facets_json(found: DataFrame) -> str:
    """Each facet's values by rank; at most `top` of each came here."""
    out: dict[str, list] = {p: [] for p in _PLURAL.values()}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out[_PLURAL[r["facet"]]].append({"value": r["value"], "count": r["count"]})
    return _json(out)


def histogram_json(found: DataFrame) -> str:
    """The buckets in order of time; a range has at most 2,000."""
    return _json({"buckets": [{"time": r["time"], "count": r["count"]} for r in sorted(found.collect(), key=lambda r: r["time"])]})


def _shown(value) -> str:
    """On one line, without control characters, which could steer a terminal."""
    text = "" if value is None else str(value)
    return "".join(" " if c in "\t\r\n" else c for c in text if c in "\t\r\n" or unicodedata.category(c) not in ("Cc", "Cf"))


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table(names: list[str], rows: Iterable[Iterable]) -> str:
    """Columns under their names, each as wide as its widest cell."""
    lines = [list(names), *[[_shown(v) for v in r] for r in rows]]
    widths = [max(_width(line[k]) for line in lines) for k in range(len(names))]
    return "".join("  ".join(c + " " * (w - _width(c)) for c, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in lines)


def page_table(page: Page) -> str:
    """A page for people: times in UTC, and the cursor of the next page below, if there is one."""
    at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds")
    text = table(["time", "level", "service", "host", "message"], [(at(r["event_time"]), r["level"], r["service"], r["host"], r["message"]) for r in page.events])
    return text + (f"next: {page.next_cursor}\n" if page.next_cursor else "")
