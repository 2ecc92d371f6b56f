"""Opaque continuation tokens, bound to the query that they continue."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from dataclasses import dataclass

from .query import Expired, LogQuery, QueryError

MAX_TOKEN = 1_024
_I64 = range(-(1 << 63), 1 << 63)


@dataclass(frozen=True)
class Position:
    """Where a search stands: what it is pinned to, and the last event it gave."""

    high: int
    time: int
    id: int


def fingerprint(query: LogQuery, kind: str) -> str:
    return hashlib.sha256(query.identity(kind).encode()).hexdigest()


def _encode(query: LogQuery, payload: dict) -> str:
    raw = json.dumps(payload, separators=(",", ":")).encode()
    token = "v1." + base64.urlsafe_b64encode(raw).decode().rstrip("=")
    if query.scope[0] == "named":
        token = f"{query.scope[1]}:{token}"
    if len(token) > MAX_TOKEN:
        raise QueryError(f"cursor exceeds {MAX_TOKEN} bytes")
    return token


def encode_search(query: LogQuery, at: Position) -> str:
    return _encode(query, {"v": 1, "kind": "search", "query": fingerprint(query, "search"), "high": str(at.high), "time": str(at.time), "id": str(at.id)})


def encode_tail(query: LogQuery, after: int) -> str:
    return _encode(query, {"v": 1, "kind": "tail", "query": fingerprint(query, "tail"), "after": str(after)})


def _decode(query: LogQuery, token: str, kind: str, members: tuple[str, ...]) -> list[int]:
    if len(token.encode()) > MAX_TOKEN:
        raise QueryError(f"cursor exceeds {MAX_TOKEN} bytes")
    prefix = f"{query.scope[1]}:" if query.scope[0] == "named" else ""
    if not token.startswith(f"{prefix}v1."):
        raise QueryError("the cursor is of another index or version")
    body = token[len(prefix) + 3 :]
    if not re.fullmatch(r"[A-Za-z0-9_-]+", body):
        raise QueryError("no cursor")
    try:
        got = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)), object_pairs_hook=list)
    except (ValueError, binascii.Error) as e:
        raise QueryError("no cursor") from e
    if not isinstance(got, list) or any(not isinstance(p, tuple) for p in got) or sorted(k for k, _ in got) != sorted(("v", "kind", "query", *members)):
        raise QueryError("no cursor envelope")
    got = dict(got)
    if got["v"] != 1 or got["kind"] != kind or got["query"] != fingerprint(query, kind):
        raise QueryError("the cursor belongs to another query")
    out = []
    for m in members:
        if not isinstance(got[m], str) or not re.fullmatch(r"0|-?[1-9]\d*", got[m]) or int(got[m]) not in _I64:
            raise QueryError(f"cursor: {m} is no canonical integer")
        out.append(int(got[m]))
    return out


def decode_search(query: LogQuery, token: str) -> Position:
    return Position(*_decode(query, token, "search", ("high", "time", "id")))


def decode_tail(query: LogQuery, token: str) -> int:
    return _decode(query, token, "tail", ("after",))[0]


def check_position(query: LogQuery, at: Position, newest: int, cutoff: int | None) -> None:
    """The position has to lie in the query's range, in what is committed, and in what retention has left."""
    if cutoff is not None and at.time < cutoff:
        raise Expired("the cursor's position has expired")
    if not 0 <= at.high <= newest or at.id > at.high:
        raise QueryError("the cursor's high-water id was never given out")
    if not query.start <= at.time < query.end:
        raise QueryError("the cursor's position lies outside the range")


def continuation_end(query: LogQuery, at: Position) -> int:
    """Files that begin later than the last event can't hold the rest."""
    return min(query.end, at.time + 1)
