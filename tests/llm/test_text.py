import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat, decontamination, html, quality, toxicity
from stratalog.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(1)
    terms = [("idiot", False), ("worthless", False), ("disgusting", False), ("scum", False), ("clown", False), ("lowei", True), ("chll", True)]
    a = toxicity.LexiconAutomaton(terms)
    words = [t for t, _ in terms]
    for _ in range(4000):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "o", "é"])
        w = "".join(w) + r.choice(["", "", "ab"])
        hits = [(distance(w, t), k) for k, (t, stem) in enumerate(terms) if distance(w, t) <= toxicity.errors_allowed(t, stem)]
        hits += [(0, k) for k, (t, stem) in enumerate(terms) if stem and w.startswith(t)]
        got = a.match(w)
        assert (got is None) == (not hits), (w, got, hits)
        assert got is None or got[1] == min(hits)[0] or terms[got[0]][1]


def labelled(spark, n=600):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(3, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            text[r.randrange(40)] = r.choice(["wretchling", "gloomhead"])
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_toxicity_learns_and_parts_quotation_from_use(spark):
    d = labelled(spark)
    labels = d.select("doc_id", d["y"].alias("toxic"))
    s = toxicity.learn(d.select("doc_id", "text"), labels).prepare()
    assert {t for t, _ in s.terms} == {"wretchling", "gloomhead"}
    assert s.score("you are a wretchling indeed") > 0.8 and s.score("a wretchlimg walked by") >= 0.5
    assert s.score('the word "wretchling" is old') < 0.5 and s.score("nothing here") < 0.2 and s.score("") < 0.2
    got = toxicity.score(d, s).join(d.select("doc_id", "y"), "doc_id").collect()
    assert len(got) == 600 and all(r["predicted"] == r["y"] for r in got)
    odd = spark.createDataFrame([(1, None), (None, "gloomhead " * 5000), (1, None), (2, "")], "doc_id long, text string")
    assert sorted(r["predicted"] for r in toxicity.score(odd, s).collect()) == [0, 0, 0, 1]
    assert toxicity.score(odd.limit(0), s).collect() == []
    none = toxicity.learn(d.select("doc_id", "text"), labels.limit(0))
    assert none.terms == [] and all(r["predicted"] == 0 for r in toxicity.score(odd, none).collect())
    assert toxicity.drop_toxic(odd, s).count() == 3


def test_held_out_rows_teach_nothing(spark):
    d = labelled(spark).filter(held_out(F.col("doc_id")))
    s = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", d["y"].alias("toxic")))
    assert s.terms == []
    assert quality.learn(d.select("doc_id", "text"), d.select("doc_id", d["y"].alias("quality"))) is None


def test_attention_gradients_against_differences():
    rng = np.random.default_rng(5)
    X, starts, y = rng.normal(size=(11, 6)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0, 0.0])
    m = quality.Model(np.zeros(6), np.ones(6), rng.normal(size=(6, 3)), rng.normal(size=(6, 3)), rng.normal(size=3), rng.normal(size=6), 0.3)

    def loss():
        p = quality._forward(m, X, starts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, got in quality.gradients(m, X, starts, y).items():
        value = np.array(getattr(m, name), float)
        for at in np.ndindex(value.shape):
            sides = []
            for step in (1e-5, -1e-5):
                moved = value.copy()
                moved[at] += step
                setattr(m, name, moved if moved.shape else float(moved))
                sides.append(loss())
            setattr(m, name, value if value.shape else float(value))
            assert abs((sides[0] - sides[1]) / 2e-5 - np.asarray(got)[at]) < 1e-7, (name, at)


def test_held_out_accuracy_of_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 5 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    odd = spark.createDataFrame([(1, None), (None, "x " * 100_000), (1, ""), (2, "!!!")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect()) and quality.score(odd, model).count() == 4
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    bags = [quality.encode("One. Two, three! " * 80), quality.encode("***"), quality.encode("")]
    m = quality.fit(bags, np.array([1.0, 0.0, 0.0]), epochs=150)
    s = m.scores(bags)
    assert s[0] > 0.8 and s[1] < 0.2 and s[2] < 0.2


def brute_contained(docs, items, t=0.8):
    import re

    def shingles(text):
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    out, seen = [], {}
    for i, x in docs:
        if i is not None:
            seen.setdefault(i, set()).update(shingles(x))
    for j, y in items:
        b = shingles(y)
        for i, a in seen.items():
            if j is not None and b and len(a & b) >= t * len(b) - 1e-9:
                out.append((i, j, len(b), len(a & b)))
    return sorted(out)


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(j, " ".join(r.choice(words) for _ in range(r.choice([5, 6, 12, 40, 60])))) for j in range(30)] + [(90, "two words"), (91, ""), (92, None), (None, "a b c d e f"), (93, "w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(120):
        w = [r.choice(words) for _ in range(r.choice([3, 30, 400, 5000]))]
        item = (items[r.randrange(30)][1]).split()
        for _ in range(r.randint(0, 3)):
            item[r.randrange(len(item))] = "changed"
        at = r.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + (item if i % 2 else []) + w[at:])))
    docs += [(200, "Two, words!"), (201, None), (202, ""), (None, items[0][1]), (203, items[3][1].upper().replace(" ", " - ")), (203, "again"), (204, "w1 " * 50)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["item_shingles"], r["matched"]) for r in decontamination.find_contaminated(d, b).collect())
    want = brute_contained(docs, items)
    assert got == want and any(x[0] == 203 for x in want) and (200, 90, 1, 1) in want
    clean = decontamination.drop_contaminated(d, b)
    assert clean.columns == d.columns and clean.count() == len(docs) - sum(i in {x[0] for x in want} for i, _ in docs)
    assert decontamination.find_contaminated(d.limit(0), b).collect() == [] and decontamination.find_contaminated(d, b.limit(0)).collect() == []


PAGES = {
    "plain": ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One, two\n  three.<p>Four <b>bold</b> &#233;.</p></article><footer>F</footer></body></html>", "T & U\n\nOne, two three.\n\nFour bold é."),
    "divs": ('<div id="header">Head</div><div class="sidebar"><p>Side, bar, text, that, is, long.</p></div><div id="content"><p>Main text, of some length, with commas.</p><p>More of it, here.</p></div><div class="cookie-notice">We use cookies.</div><div id="comments"><p>First, post, here!</p></div>', "Main text, of some length, with commas.\n\nMore of it, here."),
    "furniture inside": ('<main><h2>A</h2><p>Body text, first.</p><div class="ad">Buy</div><form><label>Mail</label><input></form><script>var a="<p>x</p>";</script><!-- <p>no</p> --><p>Body text, second.</p><aside>rel</aside></main>', "A\n\nBody text, first.\n\nBody text, second."),
    "nothing": ("<html><body><nav>a</nav></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "broken": ("<p>Open, text <b>here<div><p>and, more.", "Open, text here\n\nand, more."),
    "text only": ("just words, here & there", "just words, here & there"),
}


def test_main_text(spark):
    df = spark.createDataFrame([(i, k, v[0], "clash") for i, (k, v) in enumerate(PAGES.items())], "page_id long, url string, html string, text string")
    got = {r["url"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    for k, (_, want) in PAGES.items():
        assert got[k] == (want, len(want)), k
    assert html.extract(df.limit(0)).collect() == []
    assert len(html.main_text("<p>long, text.</p>" * 20_000).split("\n\n")) == 20_000
    assert html.main_text("<div>" * 30_000 + "deep, text")


def test_escapes_are_reversible():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(["#", "##", "###", "\\", "</turn>", "<", "h", "l", " ", "\n", "### Assistant: ", "</turn", ":"]) for _ in range(r.randint(0, 9)))
        e = chat.escape(t)
        assert "###" not in e and "</turn>" not in e and chat.unescape(e) == t
        turns = [(t, t), ("assistant", t), ("user", "")]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns and all(chat.unescape(text[a:b]) == t for a, b in spans)


def test_conversations_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["hi", None, "### x", "é" * 50])) for c in range(12) for t in range(r.choice([1, 2, 7, 33]))]
    rows += [(50, 3, "user", "a"), (50, 3, "user", "a"), (50, None, "assistant", "first"), (None, 0, "user", "none"), (51, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.digests(chat.format_conversations(chat.reply_chains(df))).collect()}
    assert set(got) == {x[0] for x in rows if x[0] is not None}
    for c in got:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for i, t, role, text in rows if i == c))
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(chat.reply_chains(df.limit(0)))).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_best_branches_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for tree in range(15):
        for n in range(r.choice([1, 3, 20, 40])):
            parent = r.choice([None, 999]) if n == 0 else r.randrange(max(0, n - 3), n)
            rows.append((tree, n, parent, float(r.randint(-3, 5))))
    rows += [(90, 0, 1, 9.0), (90, 1, 0, 9.0), (91, 0, None, 1.0), (91, 5, 6, 9.0), (91, 6, 5, 9.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for x in chat.chosen_paths(df).collect():
        got.setdefault(x["tree"], []).append((x["place"], x["node"]))
    for tree in {x[0] for x in rows}:
        nodes = {n: (p, s) for t, n, p, s in rows if t == tree}
        best = []
        for leaf in set(nodes) - {p for p, _ in nodes.values()}:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            best.append((sum(nodes[n][1] for n in path), len(path), -leaf, path))
        want = max(best)[3] if best else []
        assert [n for _, n in sorted(got.get(tree, []))] == want, tree


def test_few_messages_make_few_files_whatever_the_partitions(spark, monkeypatch):
    made = []

    def counted(df, name, *rest, plain=chat.materialise):
        made.append((name, plain(df, name, *rest)))
        return made[-1][1]

    def written(df, count=chat.done_with):
        counts.extend((n, len(d.inputFiles())) for n, d in made if d is df)
        count(df)

    counts = []
    monkeypatch.setattr(chat, "materialise", counted)
    monkeypatch.setattr(chat, "done_with", written)
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    df = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(60) for t in range(9)], "conv_id long, turn long, role string, text string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = chat.format_conversations(chat.reply_chains(df)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x["tree"], x["n_turns"]) for x in got) == [(c, 9) for c in range(60)]
    assert {n for n, _ in counts} == {"reach", "path"} and max(k for _, k in counts) == 1, counts
    assert [n for n, _ in made].count("nodes") == 0  # the messages are written already
