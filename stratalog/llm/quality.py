"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded as a vector of how it is written: shares of character kinds,
repetition, lengths, and a hashed histogram of word shapes. Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)),
weighs the passages; its weights are learnt from document labels alone, together with a logistic layer on the weighted
passage representation. Training is plain numpy on a bounded sample; scoring encodes every passage of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_of

#: Bound of what the model is fitted on; words in a passage; buckets for word shapes.
SAMPLE_ROWS, PASSAGE, SHAPES = 6_000, 96, 24
#: Passages of a labelled row that the model is fitted on, evenly spaced; scoring takes all.
SAMPLE_PASSAGES = 64
_STYLE = 15

_KIND = bytes.maketrans(bytes(range(256)), bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)))
_RUN = re.compile(rb"([aA0])\1+")
_shapes: dict[bytes, int] = {}


def _bucket(shape: bytes) -> int:
    b = _shapes.get(shape)
    if b is None:
        b = zlib.crc32(shape) % SHAPES
        if len(_shapes) < 100_000:
            _shapes[shape] = b
    return b


def encode(text: str) -> np.ndarray:
    """A row for each passage of up to PASSAGE words; an empty text has one passage, all zeros but a flag."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        out = np.zeros((1, _STYLE + SHAPES), np.float32)
        out[0, 0] = 1
        return out
    rows = []
    for at in range(0, len(words), PASSAGE):
        part = words[at : at + PASSAGE]
        n = len(part)
        raw = b" ".join(part)
        kinds = raw.translate(_KIND)
        size = len(kinds)
        up, low, num = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"0")
        ends = kinds.count(b".") + kinds.count(b"?") + kinds.count(b"!")
        other = size - up - low - num - n + 1
        distinct = len(set(part))
        same = sum(map(bytes.__eq__, part, part[1:]))
        row = np.zeros(_STYLE + SHAPES, np.float32)
        row[1:_STYLE] = (
            1.0, n / PASSAGE, up / size, num / size, other / size, kinds.count(b",") / n, ends / n, kinds.count(b"!") / n, kinds.count(b"|") / n,
            1 - distinct / n, same / n, (size + 1) / n / 10, len(set(raw)) / 64, len(zlib.compress(raw, 1)) / size,
        )
        shapes = _RUN.sub(rb"\1", kinds).split(b" ")
        row[_STYLE:] = np.bincount([_bucket(s) for s in shapes], minlength=SHAPES) / n
        rows.append(row)
    return np.stack(rows)


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
        return _forward(self, np.clip((np.concatenate(bags) - self.mean) / self.std, -8, 8), starts)[-1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: Model, X: np.ndarray, starts: np.ndarray):
    sizes = np.diff(np.append(starts, len(X)))
    t, g = np.tanh(X @ m.V), _sigmoid(X @ m.U)
    a = (t * g) @ m.w
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * X, starts, axis=0)
    return sizes, t, g, a, z, _sigmoid(z @ m.c + m.b)


def gradients(m: Model, X: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of bags, by parameter."""
    sizes, t, g, a, z, p = _forward(m, X, starts)
    dl = (p - y) / len(y)
    da = np.einsum("ij,ij->i", X, np.repeat(dl[:, None] * m.c, sizes, 0))
    ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, dg = ds[:, None] * (m.w * g * (1 - t * t)), ds[:, None] * (m.w * t * g * (1 - g))
    return {"V": X.T @ dt, "U": X.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "b": dl.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, epochs: int = 200, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """Adam on the mean logistic loss of bags, with weight decay on all but the bias; deterministic."""
    H = np.concatenate(bags).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
    d, rng = H.shape[1], np.random.default_rng(seed)
    mean, std = H.mean(0), H.std(0) + 1e-3
    X = np.clip((H - mean) / std, -8, 8)
    m = Model(mean, std, rng.normal(0, 0.2, (d, hidden)), rng.normal(0, 0.2, (d, hidden)), rng.normal(0, 0.2, hidden), np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    names = ("V", "U", "w", "c", "b")
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in names} for _ in range(2))
    for step in range(1, epochs + 1):
        grads = gradients(m, X, starts, y)
        for k in names[:-1]:
            grads[k] += decay * getattr(m, k)
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            setattr(m, k, getattr(m, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return m


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> Model | None:
    """A model from at most sample_rows labelled rows, none held out: those of the smallest hashes of their ids. None where one class is missing.

    Of a row's passages at most sample_passages, evenly spaced, are learnt from, which bounds what comes to the driver. Null
    labels and ids teach nothing; of an id's labels the larger counts; repeated rows of documents count each. Null texts are empty.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")  # sample_rows bounds it

    def some(bag: np.ndarray) -> np.ndarray:
        return bag if len(bag) <= sample_passages else bag[np.linspace(0, len(bag) - 1, sample_passages).astype(int)]

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "bag": [some(encode(t)).astype(np.float32).tobytes() for t in b["text"]]})

    got = sorted(rows.mapInPandas(bags, "id long, y int, bag binary").collect(), key=lambda r: (r["id"], bytes(r["bag"])))
    y = np.array([r["y"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, _STYLE + SHAPES) for r in got], y)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, whole texts. Null texts are empty; repeated rows stay; without a model each scores 0.5; other columns are not read."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), 0.5)
            for at in range(0, len(texts) if model is not None else 0, 256):
                out[at : at + 256] = model.scores([encode(t) for t in texts.iloc[at : at + 256]])
            yield pd.Series(out)

    rows = docs.select(F.col(id_col), F.pandas_udf(work, "double")(text_of(text_col)).alias("score"))
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
