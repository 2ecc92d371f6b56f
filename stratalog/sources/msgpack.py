"""MessagePack as (kind, payload) pairs, which keep what JSON loses: repeated keys, raw bytes, float bits, extensions.

Kinds: nil, boolean, integer, float32 and float64 (bits), string and binary (bytes), extension ((type, bytes)), array
(list), map (list of pairs).
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Iterator

Value = tuple[str, object]
MAX_DEPTH = 32

#: Marker byte -> (kind, width of what follows: of the number, or of the count or size).
_FIXED = {
    0xC4: ("binary", 1), 0xC5: ("binary", 2), 0xC6: ("binary", 4),
    0xC7: ("extension", 1), 0xC8: ("extension", 2), 0xC9: ("extension", 4),
    0xCA: ("float32", 4), 0xCB: ("float64", 8),
    0xCC: ("unsigned", 1), 0xCD: ("unsigned", 2), 0xCE: ("unsigned", 4), 0xCF: ("unsigned", 8),
    0xD0: ("signed", 1), 0xD1: ("signed", 2), 0xD2: ("signed", 4), 0xD3: ("signed", 8),
    0xD9: ("string", 1), 0xDA: ("string", 2), 0xDB: ("string", 4),
    0xDC: ("array", 2), 0xDD: ("array", 4), 0xDE: ("map", 2), 0xDF: ("map", 4),
}


class Malformed(ValueError):
    """The bytes are no value that can be taken."""


class Incomplete(Malformed):
    """The bytes end inside a value."""


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise Incomplete("the bytes end inside a value")
    return data[at : at + n], at + n


def read(data: bytes, at: int = 0, depth: int = 0) -> tuple[Value, int]:
    """The value that starts at a place, and the place after it."""
    if depth > MAX_DEPTH:
        raise Malformed("values are nested too deep")
    head, at = _take(data, at, 1)
    b = head[0]
    if b < 0x80:
        return ("integer", b), at
    if b >= 0xE0:
        return ("integer", b - 256), at
    if b in (0xC0, 0xC2, 0xC3):
        return ("nil", None) if b == 0xC0 else ("boolean", b == 0xC3), at
    if b < 0xC0:  # small maps, arrays, strings
        kind, n = ("map", b & 15) if b < 0x90 else ("array", b & 15) if b < 0xA0 else ("string", b & 31)
    elif 0xD4 <= b <= 0xD8:
        kind, n = "extension", 1 << (b - 0xD4)
    elif b in _FIXED:
        kind, width = _FIXED[b]
        raw, at = _take(data, at, width)
        n = int.from_bytes(raw, "big", signed=kind == "signed")
        if kind in ("unsigned", "signed"):
            return ("integer", n), at
        if kind.startswith("float"):
            return (kind, n), at
    else:
        raise Malformed("reserved marker")
    if kind in ("string", "binary"):
        raw, at = _take(data, at, n)
        return (kind, raw), at
    if kind == "extension":
        raw, at = _take(data, at, n + 1)
        return (kind, (int.from_bytes(raw[:1], "big", signed=True), raw[1:])), at
    items: list = []
    for _ in range(n if kind == "array" else 2 * n):  # a false count meets the end of the bytes; nothing is set aside for it
        v, at = read(data, at, depth + 1)
        items.append(v)
    return (kind, items if kind == "array" else list(zip(items[::2], items[1::2], strict=True))), at


def whole_values(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each whole value; what is left after the last waits for more bytes."""
    at = 0
    while at < len(data):
        try:
            _, end = read(data, at)
        except Incomplete:
            return
        yield at, end
        at = end


def text_of(value: Value) -> str | None:
    """A string that is UTF-8."""
    if value[0] != "string":
        return None
    try:
        return value[1].decode()
    except UnicodeDecodeError:
        return None


class _NotJson(Exception):
    pass


def _natural(value: Value):
    kind, v = value
    if kind in ("nil", "boolean"):
        return v
    if kind == "integer" and -(2**63) <= v < 2**64:
        return v
    if kind in ("float32", "float64"):
        x = struct.unpack(">f", v.to_bytes(4, "big"))[0] if kind == "float32" else struct.unpack(">d", v.to_bytes(8, "big"))[0]
        if math.isfinite(x):
            return x
    if kind == "string" and (s := text_of(value)) is not None:
        return s
    if kind == "array":
        return [_natural(x) for x in v]
    if kind == "map":
        names = [text_of(k) for k, _ in v]
        if None not in names and len(set(names)) == len(names):
            return {n: _natural(x) for n, (_, x) in zip(names, v, strict=True)}
    raise _NotJson


def natural(value: Value) -> tuple[bool, object]:
    """(whether JSON holds all of the value, the JSON)."""
    try:
        return True, _natural(value)
    except _NotJson:
        return False, None


def b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def typed(value: Value) -> list:
    """[kind, payload] without loss: integers as digits, floats as the hex digits of their bits, bytes as base64."""
    kind, v = value
    if kind == "nil":
        return [kind]
    if kind == "integer":
        return [kind, str(v)]
    if kind in ("float32", "float64"):
        return [kind, f"{v:0{8 if kind == 'float32' else 16}x}"]
    if kind == "string":
        s = text_of(value)
        return ["string_bytes", b64(v)] if s is None else [kind, s]
    if kind == "binary":
        return [kind, b64(v)]
    if kind == "extension":
        return [kind, v[0], b64(v[1])]
    if kind == "array":
        return [kind, [typed(x) for x in v]]
    if kind == "map":
        return [kind, [[typed(k), typed(x)] for k, x in v]]
    return [kind, v]


def unique(value: Value, name: str) -> Value | None:
    """The member of that name where a map has it once; a repeated name is ambiguous, so it counts as missing."""
    found = [x for k, x in value[1] if text_of(k) == name] if value[0] == "map" else []
    return found[0] if len(found) == 1 else None


def loose_text(value: Value | None) -> str | None:
    """The text of a string, bytes that aren't UTF-8 being replaced."""
    return value[1].decode("utf-8", "replace") if value is not None and value[0] == "string" else None


def dumps(x) -> str:
    """Compact JSON with members in the order of their names."""
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
