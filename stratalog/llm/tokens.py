"""Token ids by the tokenizers library, each distinct stretch between spaces being encoded once per worker.

The library encodes about a megabyte of these texts a second, most of which goes into aligning the text with its
tokens. Between blanks the two tokenizers used here treat a stretch alike wherever it stands. So texts are cut at blanks
and their stretches numbered in Arrow, some megabytes at a time; each distinct one is looked up once in what the worker
has met before, a word that is new goes straight to the library's merge model, and the ids are put together by numpy.
"""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Two generations of so many stretches stay in a worker's memory; texts of so many bytes are cut together.
MEMO, CHUNK = 150_000, 4 << 20
#: So many stretches are put together at once.
_BLOCK = 1 << 19

_kept: dict[tuple[str, str], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The visible letters that byte-level models have for bytes: a byte that is visible in Latin-1 stands for itself, the others follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SPACE, _LINE = 0x20, 0x0A


def _table(of: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of.encode("ascii"))] = True
    return out


_IS_LETTER = _table(string.ascii_letters)
_IS_MARK = _table(string.punctuation)
_IS_BLANK = _table(" \n")


def borders(buffer: bytes, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of a buffer of texts, a byte before each: where stretches begin (and the buffer's end), and the number of each text's first.

    A stretch begins at a text, at a space or line end, and at an ASCII mark that follows a letter of ASCII or Latin-1:
    to the patterns of both tokenizers letters end there, and what follows doesn't look back.
    """
    a = np.frombuffer(buffer, np.uint8)
    letter = _IS_LETTER[a]
    pairs = np.flatnonzero(a[:-1] == 0xC3) + 1  # two-byte letters, but for the signs of times and division
    letter[pairs] = (a[pairs] != 0x97) & (a[pairs] != 0xB7)
    border = _IS_MARK[a]
    border[1:] &= letter[:-1]
    border |= _IS_BLANK[a]
    begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
    border[begins] = True
    at = np.append(np.flatnonzero(border), len(buffer))
    return at, np.searchsorted(at, begins)


class _Memo(dict):
    """Ids by stretch, encoded when first asked for. A full memo becomes the old one, from which what is still in use returns."""

    def __init__(self, encode: Callable, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.old: dict = {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit integers."""

    #: Stands for the ids of a stretch that can't be encoded by itself; no tokenizer has such an id.
    ODD = b"\xff\xff\xff\xff"

    def __init__(self, path: str, limit: int = MEMO):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.stretches = _Memo(self.stretch, limit)
        self.added = self._added()

    def _added(self) -> regex.Pattern | None:
        """The file's added tokens, looked for in the raw text: the leftmost, and of those the longest. Others than plain ones aren't handled."""
        found = self.tokenizer.get_added_tokens_decoder()
        self.added_ids = {t.content: self.raw[i] for i, t in found.items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in found.values()):
            raise ValueError("added tokens with normalisation, word borders or stripping")
        names = sorted(self.added_ids, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def piece(self, piece: str, before: str = "") -> bytes:
        """The ids of one piece of the tokenizer's pattern, normalised before; `before` is a beginning in the model's letters."""
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
        return b"".join([self.raw[t.id] for t in self.merge(before + piece)])

    def stretch(self, key: bytes) -> bytes:
        """The ids of a stretch with its border, or ODD."""
        raise NotImplementedError

    def cut(self, raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts as one buffer, the places in it where stretches begin (and its end), and the number of the first stretch of each text. Each text has one at least."""
        raise NotImplementedError

    def odd(self, text: str) -> bytes:
        """The ids of a text with a stretch that is ODD."""
        raise NotImplementedError

    def flawed(self, codes: np.ndarray, distinct: list[bytes], first: np.ndarray) -> np.ndarray:
        """Which texts have stretches that depend on those around them."""
        return np.zeros(len(first), bool)

    def parted(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        buffer, at, first = self.cut([t.encode("utf-8") for t in texts])
        keys = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buffer)]).dictionary_encode()
        codes, distinct = keys.indices.to_numpy(), keys.dictionary.to_pylist()
        known = [*map(self.stretches.__getitem__, distinct)]
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        starts = np.cumsum(sizes) - sizes
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=ends[1:])
        out = np.empty(int(ends[-1]), "<u4")
        for lo in range(0, len(codes), _BLOCK):
            part = codes[lo : lo + _BLOCK]
            e = ends[lo : lo + len(part) + 1]
            out[e[0] : e[-1]] = flat[np.repeat(starts[part] - e[:-1], sizes[part]) + np.arange(e[0], e[-1])]
        borders = np.append(ends[first], ends[-1])
        bad = self.flawed(codes, distinct, first)
        odd = np.flatnonzero(out == 0xFFFFFFFF)
        bad[np.searchsorted(borders, odd, side="right") - 1] = True
        raw, b = out.tobytes(), (4 * borders).tolist()
        return [self.odd(t) if x else raw[s:e] for t, x, s, e in zip(texts, bad.tolist(), b[:-1], b[1:], strict=True)]

    def whole(self, text: str) -> bytes:
        """The ids of a text, parted first at added tokens, each of which is one id."""
        parts = self.added.split(text)
        between = iter(self.parted(parts[::2]))
        return b"".join([self.added_ids[p] if k % 2 else next(between) for k, p in enumerate(parts)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        lo = size = 0
        for k, t in enumerate(texts, 1):
            size += len(t)
            if size < CHUNK and k < len(texts):
                continue
            part = texts[lo:k]
            special = [any(n in t for n in self.added_ids) for t in part]
            plain = [t for t, s in zip(part, special, strict=True) if not s]
            ids = iter(self.parted(plain) if plain else ())
            for t, s in zip(part, special, strict=True):
                yield self.whole(t) if s else next(ids)
            lo, size = k, 0


class WordEncoder(Encoder):
    """For tokenizers that compose and lower-case letters and drop white space: spaces and line ends always part tokens."""

    #: ASCII capitals as small letters, line ends as spaces.
    FOLDED = bytes(range(256)).lower().replace(b"\n", b" ")

    def cut(self, raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        # before a combining mark (U+0300 to U+036F) a capital may compose otherwise than its small letter
        raws = [r.replace(b"\n", b" ") if b"\xcc" in r or b"\xcd" in r else r.translate(self.FOLDED) for r in raws]
        buffer = b" ".join([b"", *raws])
        return buffer, *borders(buffer, raws)

    def stretch(self, key: bytes) -> bytes:
        word = key.decode("utf-8").removeprefix(" ")
        if word.isascii():
            if word.isalpha():
                return self.piece(word.lower())
        elif word.isalpha() and max(small := word.lower()) < "ƀ" and small.isalpha():
            return self.piece(small)  # composed and lower-cased alike everywhere: letters of the first two Latin blocks
        return self.odd(word)

    def odd(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


class ByteEncoder(Encoder):
    """For byte-level tokenizers whose pattern ties one space to the word after it.

    Where single spaces and line ends, and pairs of line ends, stand between visible characters, each is a border; texts
    with other white space go through the whole pattern.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, limit: int = MEMO):
        super().__init__(path, limit)
        self.line_end = self.piece("\n")
        self.pieces = _Memo(self.piece, limit)

    def cut(self, raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        buffer = b"\0".join([b"", *raws])  # the first stretch of a text begins with a zero
        return buffer, *borders(buffer, raws)

    def stretch(self, key: bytes) -> bytes:
        border, word = key[0], key[1:].decode("utf-8")
        if not word:
            return b"" if border == 0 else self.ODD if border == _SPACE else self.line_end if border == _LINE else self.by_pattern(chr(border))
        if word.isascii() and word.isalpha() and border == _SPACE:
            return self.piece(word, _LETTERS[_SPACE])
        if word[-1].isspace() or word[0].isspace() and border in (0, _SPACE, _LINE):
            return self.ODD
        if border == _LINE:
            return self.line_end + self.by_pattern(word)
        return self.by_pattern(word if border == 0 else key.decode("utf-8"))

    def flawed(self, codes: np.ndarray, distinct: list[bytes], first: np.ndarray) -> np.ndarray:
        """Empty stretches: a line end by itself has to stand before one with a word, and an empty beginning is an empty text."""
        bare = np.fromiter((len(d) == 1 and d[0] in (0, _LINE) for d in distinct), bool, len(distinct))
        if not bare.any():
            return np.zeros(len(first), bool)
        line_and_word = np.fromiter((d[0] == _LINE and len(d) > 1 for d in distinct), bool, len(distinct))
        begin = np.zeros(len(codes) + 1, bool)
        begin[first] = begin[-1] = True
        before_word = np.append(line_and_word[codes[1:]], False) & ~begin[1:]
        alone = begin[:-1] & begin[1:]
        wrong = bare[codes] & np.where(begin[:-1], ~alone, ~before_word)
        return np.logical_or.reduceat(wrong, first)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.PATTERN.findall(text)))

    odd = by_pattern


def encoder(kind: str, path: str) -> Encoder:
    """One a worker; its memory outlives the task."""
    if (kind, path) not in _kept:
        _kept[kind, path] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path)
    return _kept[kind, path]
