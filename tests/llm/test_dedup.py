import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from stratalog.llm import exact_dedup, passages, simhash
from stratalog.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0]))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out)


def test_exact_against_brute_force(spark):
    random.seed(3)
    base = ["a b", "ab", "a\tb\n", "", " ", None, "é ü", "éü", "long " * 3000, "x y", "xy"]
    rows = [(i - 5, random.choice(base)) for i in range(120)]
    got = exact_dedup.mark_exact_duplicates(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)


def test_exact_edges(spark):
    assert exact_dedup.mark_exact_duplicates(docs(spark, [])).collect() == []
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, " a")]
    got = exact_dedup.mark_exact_duplicates(docs(spark, rows)).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    assert {r["keep_id"] for r in got if r["group_size"] == 4} == {2}
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "b"), (2, " a")]


def test_exact_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a", "x", 1, "q"), (2, "a", "y", 2, "r")], "doc_id long, text string, norm string, salt int, keep_id string")
    assert [r["text"] for r in exact_dedup.drop_exact_duplicates(d).collect()] == ["a"]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_fingerprint_is_the_plain_one():
    random.seed(1)
    words = ["ab", "É", "Zz", "\x0b", "x\ty", "\x1c", "中", ".", "A  B"]
    for _ in range(200):
        t = random.choice([" ", "\n", "\r"]).join(random.choice(words) for _ in range(random.randint(0, 30)))
        assert simhash.fingerprint(t) == slow_fingerprint(t), repr(t)
    big = " ".join(str(i) for i in range(70_000))
    assert simhash.fingerprint(big) >= 0


def test_image_bounds_hamming():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 2**63, 2000).astype(np.uint64), r.integers(0, 2**63, 2000).astype(np.uint64)
    count = lambda f: np.stack([np.bitwise_count((f >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)], 1).astype(int)
    manhattan = np.abs(count(a) - count(b)).sum(1)
    assert (np.bitwise_count(simhash.image(a) ^ simhash.image(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("dense", [False, True])
def test_links_against_brute_force(spark, dense):
    r = np.random.default_rng(7 + dense)
    f = r.integers(0, 2**63, 60).astype(np.uint64)
    flips = [f]
    for step in range(3 if not dense else 1):
        source = flips[-1] if not dense else np.repeat(f[:2], 400)
        g = source.copy()
        for _ in range(4):
            g ^= np.where(r.random(len(g)) < 0.8, np.uint64(1) << r.integers(0, 64, len(g)).astype(np.uint64), np.uint64(0))
        flips.append(g)
    f = np.unique(np.concatenate(flips))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(5)
    links = simhash.link_fingerprints(df).collect()
    assert all(int(np.uint64(x["a"] & (2**64 - 1)) ^ np.uint64(x["b"] & (2**64 - 1))).bit_count() <= 4 for x in links)
    roots = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(f.view(np.int64).tolist(), f)
    assert {i: roots.get(i, i) for i in want} == want


def test_near_components_against_brute_force(spark):
    random.seed(9)
    vocabulary = ["w%d" % i for i in range(500)]
    rows = []
    for g in range(12):
        base = [random.choice(vocabulary) for _ in range(300)]
        for c in range(5):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(300)] = "changed"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (7, rows[6][1])]
    got = simhash.near_components(docs(spark, rows)).collect()
    ids, prints = [i for i, _ in rows], np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    want = brute_components(ids, prints)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == {(i, int(p)) for i, p in zip(ids, prints)}
    kept = simhash.drop_near_duplicates(docs(spark, [*rows[:-1], (None, "without id")]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id IS NULL").count() == 1
    assert simhash.near_components(docs(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (200, 201)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def test_compact_windows_are_sliding_minima():
    r = np.random.default_rng(2)
    for n, top in ((1, 5), (30, 3), (400, 10), (500, 2**40), (300, 1)):
        x = r.integers(0, top, n).astype(np.uint64)
        a, b, v = passages.compact_windows(x, np.array([0]), np.array([n - 1]), 20)
        got = {}
        for i, j, w in zip(a.tolist(), b.tolist(), v.tolist()):
            for s in range(i, j + 1):
                assert s not in got
                got[s] = w
        assert got == {s: int(x[s : s + 20].min()) for s in range(n - 19)}


def words(n, seed):
    r = random.Random(seed)
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


def test_passages(spark):
    p, q = words(70, 1), words(60, 2)
    near = list(q)
    near[30] = "other"
    rows = [
        (1, " ".join(words(200, 11) + p + words(100, 12))),
        (2, " ".join(words(20, 13) + p + words(300, 14))),
        (3, " ".join(p)),
        (4, " ".join(words(400, 15))),
        (5, " ".join(words(30, 16) + q + words(30, 17))),
        (6, "\n".join(near + words(90, 18))),
        (7, " ".join(p[:30])),
        (8, " ".join(words(60, 19) * 3)),
        (9, None),
        (None, " ".join(p)),
        (10, ""),
    ]
    d = docs(spark, rows + [(4, rows[3][1])])
    got = {r["doc_id"]: (r["start_word"], r["n_words"]) for r in passages.repeated_passages(d).collect()}
    assert got[1] == (200, 70) and got[2] == (20, 70) and got[3] == (0, 70)
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[5] == (30, 60) and got[6] == (0, 60)
    assert passages.repeated_passages(docs(spark, [])).collect() == []


def test_passages_find_every_exact_repeat(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen, width = {}, 46
    rows = [(r["doc_id"], passages.shingle_hashes(r["text"] or "", 5)) for r in d.collect()]
    for i, h in rows:
        for s in range(len(h) - width + 1):
            seen.setdefault(h[s : s + width].tobytes(), set()).add(i)
    want = {(i, s) for i, h in rows for s in range(len(h) - width + 1) if len(seen[h[s : s + width].tobytes()]) > 1}
    spans = {}
    for r in passages.repeated_passages(d).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"]))
    assert want and all(any(a <= s and s + 50 <= b for a, b in spans.get(i, [])) for i, s in want)
    assert {i for i, _ in want} <= set(spans)
