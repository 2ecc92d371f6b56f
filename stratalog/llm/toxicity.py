"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows that part quotation from abuse.

The lexicon is learnt from labelled documents: words and word beginnings that toxic documents hold far more often than
clean ones do (a log-likelihood test held against the number of candidates). It becomes a trie. The product of the trie
with Levenshtein automata is made deterministic as texts ask for it: a state is the set of (trie node, errors) pairs that
a beginning can have reached, so a word dies at the first letter that no term allows, and a misspelt term is found in
time that doesn't depend on the size of the lexicon. What each term is worth when spelt right and when misspelt is
counted on the same sample, so that a misspelling that is an ordinary word counts as the ordinary word it is.

A hit's window decides how much it tells: between quotation marks or beside a reporting word it is a mention.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, text_of

#: Bounds of what the lexicon is learnt from, and of the lexicon.
SAMPLE_ROWS, MAX_TERMS = 20_000, 20_000
STEMS, WINDOW, MENTION = range(4, 8), 8, 0.35
PRIOR = 0.6  # worth of a misspelling never met, two observations strong

_WORD = re.compile(r"[^\W_]+")
#: Words and quotation marks. Apostrophes between letters, and those of words that lose their beginning, are no marks; others open or close by the side they stand on.
_TOKEN = re.compile(
    r"[^\W_]+|[\"“”„«»`]"
    r"|(?<=[^\W_])['‘’](?=[^\W_])(?P<inside>)|['‘’](?=(?:cause|em|til|tis|twas|twere|bout|round|nuff|n)\b)(?P<clipped>)"
    r"|['‘’](?=[^\W_])(?P<opens>)|(?<=[^\W_])['‘’](?P<closes>)|(?<!\S)['‘’](?=\S)(?P<opens_before_mark>)|(?<=\S)['‘’](?P<closes_after_mark>)|['‘’]"
)
_OPENS, _CLOSES = "‘", "’"
_SINGLE = {"opens": _OPENS, "opens_before_mark": _OPENS, "closes": _CLOSES, "closes_after_mark": _CLOSES}
_QUOTES = frozenset("\"“”„«»`'")
#: Reporting words beside which a term is mentioned, not used.
_REPORTING = frozenset("said says say wrote writes quote quoted quotes quoting word words term terms called cites cited phrase zitat wort sagte schrieb mot citation dit écrit palabra cita dijo escribió".split())
#: Words that aim a term at the reader.
_AIMED = frozenset("you your youre you're u ur du dich dein deine ihr tu toi ton ta vous votre tú usted vosotros eres".split())


#: Errors that the scorer allows in a stem, whatever follows it.
STEM_ERRORS = 1


def errors_allowed(term: str, stem: bool, in_stem: int = 0) -> int:
    return in_stem if stem else 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """match(word) -> (term number, errors) of the best term, or None. Terms are words, or stems that any ending may follow; a stem takes stem_errors errors.

    States are made as words ask for them. When their sets hold more than `pairs` pairs, all are dropped and made anew as
    they are asked for, so memory is bounded however many words a task sees.
    """

    def __init__(self, terms: list[tuple[str, bool]], memo: int = 200_000, stem_errors: int = 0, pairs: int = 2_000_000):
        self.terms, self.limit, self.stem_errors, self.pairs = terms, memo, stem_errors, pairs
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget: list[int] = [0]  # the most errors that a term below the node allows
        for k, (term, stem) in enumerate(terms):
            at, allowed = 0, errors_allowed(term, stem, stem_errors)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                at = self.children[at][c]
                self.budget[at] = max(self.budget[at], allowed)
            self.ends[at].append(k)
        self._begin()

    def _begin(self) -> None:
        self.held = 0
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []  # accepted as a whole word
        self.stem: list[tuple[int, int] | None] = []  # accepted whatever follows
        self.start = self._state({(0, 0)})

    def _closed(self, pairs) -> frozenset:
        """With the letters of a term that the word leaves out; of a node only the fewest errors matter."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.budget[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.budget[node]:
                todo += [(n, e + 1) for n in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs) -> int:
        closed = self._closed(pairs)
        if closed not in self.states:
            hits = [(e, k) for node, e in closed for k in self.ends[node] if e <= errors_allowed(*self.terms[k], self.stem_errors)]
            stems = [(e, k) for e, k in hits if self.terms[k][1]]
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.held += len(closed) + 1
            self.step.append({})
            self.found.append(min(hits, key=lambda x: (x[0], self.terms[x[1]][1], x[1]))[::-1] if hits else None)
            self.stem.append(min(stems)[::-1] if stems else None)
        return self.states[closed]

    def _next(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                pairs.add((child, e))
            pairs.add((node, e + 1))  # a letter too many
            pairs.update((n, e + 1) for n in self.children[node].values())  # a wrong letter
        pairs = {(n, e) for n, e in pairs if e <= self.budget[n]}
        to = self._state(pairs) if pairs else -1
        self.step[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        if self.held > self.pairs:
            self._begin()
        state, stem = self.start, None
        for c in word:
            steps = self.step[state]
            state = steps[c] if c in steps else self._next(state, c)
            if state < 0:
                return stem
            here = self.stem[state]
            if here is not None and (stem is None or here[1] <= stem[1]):
                stem = here
        found = self.found[state]
        return found if found is not None and (stem is None or found[1] <= stem[1]) else stem

    def matches(self, words: set[str], memo: dict[str, tuple[int, int] | None]) -> list[str]:
        """The words that match; memo keeps what was found for each word while there is room."""
        hits = []
        for w in words:
            if w in memo:
                m = memo[w]
            else:
                m = self.match(w)
                if m is not None or len(memo) < self.limit:
                    memo[w] = m
            if m is not None:
                hits.append(w)
        return hits


def tokens_of(low: str) -> list[str]:
    """Words and quotation marks of a lower-cased text; a single mark is ‘ where it opens, ’ where it closes and ' where it stands alone."""
    found = ((m.lastgroup, m[0]) for m in _TOKEN.finditer(low))
    return [_SINGLE.get(kind, t if t not in "‘’" else "'") for kind, t in found if kind not in ("inside", "clipped")]


def is_mention(tokens: list[str], at: int) -> bool:
    """Quotation marks on both sides within the window, or a reporting word close by."""
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    if any(t in _REPORTING for t in before[-3:] + after[:3]):
        return True
    if _CLOSES in after and next((t for t in reversed(before) if t in (_OPENS, _CLOSES)), "") == _OPENS:
        return True
    return sum(t in _QUOTES for t in before) % 2 == 1 and any(t in _QUOTES for t in after)


def is_aimed(tokens: list[str], at: int) -> bool:
    return any(t in _AIMED for t in tokens[max(0, at - 3) : at + 4])


class Scorer:
    """A learnt model: terms, their worths spelt right and misspelt, and single misspellings met in training."""

    def __init__(self, terms: list[tuple[str, bool]], worth: list[float], misspelt: list[float], known: dict[str, float], base: float):
        self.terms, self.worth, self.misspelt, self.known, self.base = terms, worth, misspelt, known, base

    def prepare(self) -> Scorer:
        self.automaton, self.memo = LexiconAutomaton(self.terms, stem_errors=STEM_ERRORS), {}
        return self

    def value(self, word: str) -> float:
        m = self.memo[word] if word in self.memo else self.automaton.match(word)
        if m is None:
            return 0.0
        k, errors = m
        return self.worth[k] if not errors else self.known.get(word, self.misspelt[k])

    def score(self, text: str) -> float:
        """0 to 1. Uses add up as independent signs; of mentions only the strongest counts."""
        low = text.lower()
        hits = {w: v for w in self.automaton.matches(set(_WORD.findall(low)), self.memo) if (v := self.value(w)) > self.base}
        if not hits:
            return round(self.base / 2, 6)
        tokens = tokens_of(low)
        clean, mentioned = 1.0, 0.0
        for i, t in enumerate(tokens):
            if (v := hits.get(t)) is not None:
                if is_mention(tokens, i):
                    mentioned = max(mentioned, v * MENTION)
                else:
                    clean *= (1 - v) * (0.7 if is_aimed(tokens, i) else 1)
        return float(min(1.0, max(self.base / 2, 1 - clean * (1 - mentioned))))


def _g2(a: Column, b: Column, pos: int, neg: int) -> Column:
    """Log-likelihood ratio of a and b of pos and neg documents."""
    rate = (a + b) / (pos + neg)
    g = F.lit(0.0)
    for seen, of in ((a, pos), (b, neg)):
        for got, share in ((seen, rate), (of - seen, 1 - rate)):
            g += F.when((got > 0) & (share > 0), got * F.log(got / (of * share))).otherwise(0.0)
    return 2 * g


#: Min-hashes of a text, and how many of them near copies share: a similarity of 0.8.
_HASHES, _SAME = 20, 16


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Min-hashes of a text's runs of five words."""
    seeds = np.arange(1, _HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        rows = []
        for text in b["text"]:
            words = text.split()
            h = np.fromiter({zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}, np.uint64)
            mixed = (h[:, None] + seeds) * np.uint64(0xFF51AFD7ED558CCD)
            rows.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)).min(0).view(np.int64).tolist())
        yield pd.DataFrame({"id": b["id"], "sketch": pd.Series(rows, dtype=object)})


def distinct_ids(rows) -> list[int]:
    """The ids of rows that are no near copies of one with a smaller id that is kept: what copies hold they say once."""
    kept: dict[tuple[int, int], list[int]] = {}
    out = []
    for r in sorted(rows, key=lambda r: r["id"]):
        keys = list(enumerate(r["sketch"]))
        shared = Counter(i for k in keys for i in kept.get(k, ()))
        if not shared or max(shared.values()) < _SAME:
            out.append(r["id"])
            for k in keys:
                kept.setdefault(k, []).append(r["id"])
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Scorer:
    """A scorer from at most sample_rows labelled rows, none of them held out, copies and near copies counting once.

    Which rows: those of the smallest hashes of their ids. Words are counted where the documents lie and summed by
    partial aggregates; only features that pass the log-likelihood test, and misspellings of the terms, come to the driver.
    Of more terms than max_terms those of the highest log-likelihood are kept. Without labelled rows of both kinds the
    lexicon is empty. Null labels and ids teach nothing; of an id's labels the larger counts. Null texts are empty.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")  # sample_rows bounds it
    sample = materialise(rows, "labelled")
    alone = distinct_ids(sample.mapInPandas(_sketches, "id long, sketch array<long>").collect())  # numbers only, sample_rows of them
    rows = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in alone], "id long")), "id").select("text", "y")

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    base = (pos + 1) / (pos + neg + 20)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                words = set(_WORD.findall(text.lower()))
                for f in words | {w[:k] + "\0" for w in words for k in STEMS if len(w) >= k}:
                    seen.setdefault(f, [0, 0])[y] += 1
        yield pd.DataFrame([(f, v[1], v[0]) for f, v in seen.items()], columns=["f", "toxic", "clean"])

    terms: dict[tuple[str, bool], tuple[int, int]] = {}
    if pos and neg:
        bar = 2 * math.log(200_000)  # a chance of 1 in 200,000 a candidate: a good term is met in many toxic documents
        counted = rows.mapInPandas(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        sure = counted.filter(F.col("toxic") >= 3 * F.col("clean")).withColumn("g2", _g2(F.col("toxic"), F.col("clean"), pos, neg)).filter(F.col("g2") > bar)
        found = sure.collect()
        worth = {r["f"]: r["g2"] for r in found}
        good = {r["f"]: (r["toxic"], r["clean"]) for r in found}
        words = {f: v for f, v in good.items() if not f.endswith("\0")}
        stems = {f[:-1]: v for f, v in good.items() if f.endswith("\0")}
        leading: dict[str, int] = {}  # the most toxic documents that one word with this beginning has
        for w, v in words.items():
            for k in STEMS:
                if len(w) >= k:
                    leading[w[:k]] = max(leading.get(w[:k], 0), v[0])
        for s in sorted(stems, key=len):  # the shortest beginning that is as sure; none where one word accounts for it
            if not any((s[:k], True) in terms for k in STEMS if k < len(s)) and leading.get(s, 0) < 0.8 * stems[s][0]:
                terms[s, True] = stems[s]
        terms |= {(w, False): v for w, v in words.items()}  # those of a stem too: long ones take more errors than it does
        terms = dict(sorted(terms.items(), key=lambda x: (-worth[x[0][0] + "\0" * x[0][1]], x[0]))[:max_terms])
    names = sorted(terms)
    scorer = Scorer(names, [(terms[t][0] + base) / (sum(terms[t]) + 1) for t in names], [PRIOR] * len(names), {}, base).prepare()

    def misspellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, memo, seen = LexiconAutomaton(names, stem_errors=STEM_ERRORS), {}, Counter()
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                hits = automaton.matches(set(_WORD.findall(text.lower())), memo)
                if any(not memo[w][1] for w in hits):
                    continue  # the text says so already; what else it holds tells nothing
                seen.update((w, memo[w][0], int(y)) for w in hits)
        yield pd.DataFrame([(w, k, n * y, n * (1 - y)) for (w, k, y), n in seen.items()], columns=["w", "k", "toxic", "clean"])

    if names:
        got = rows.mapInPandas(misspellings, "w string, k int, toxic long, clean long").groupBy("w", "k").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        got = materialise(got, "misspellings")
        # each spelling met counts once: one ordinary word near a term, however frequent, says little of spellings never met
        for r in got.groupBy("k").agg(F.sum(F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("toxic"), F.count(F.lit(1)).alias("met")).collect():
            scorer.misspelt[r["k"]] = (r["toxic"] + 2 * PRIOR) / (r["met"] + 2)
        scorer.known = {r["w"]: (r["toxic"] + scorer.misspelt[r["k"]]) / (r["toxic"] + r["clean"] + 1) for r in got.collect()}  # words of the sample that are near a term
    return Scorer(scorer.terms, scorer.worth, scorer.misspelt, scorer.known, scorer.base)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, whole texts. Null texts are empty and score low; repeated rows stay; other columns are not read."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(scorer.terms, scorer.worth, scorer.misspelt, scorer.known, scorer.base).prepare()
        for texts in batches:
            yield pd.Series(np.fromiter((s.score(t) for t in texts), np.float64, len(texts)))

    scored = F.pandas_udf(work, "double")
    rows = docs.select(F.col(id_col), scored(text_of(text_col)).alias("score"))
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, whatever their names. Null and empty texts stay, repeated rows go or stay together; an empty table gives an empty result."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(scorer.terms, scorer.worth, scorer.misspelt, scorer.known, scorer.base).prepare()
        for texts in batches:
            yield pd.Series([s.score(t) < threshold for t in texts], dtype=bool)

    return docs.filter(F.pandas_udf(work, "boolean")(text_of(text_col)))
