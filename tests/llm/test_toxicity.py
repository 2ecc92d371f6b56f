import random

import pytest

from stratalog.llm import toxicity


def scorer(terms, worth=0.95):
    return toxicity.Scorer(terms, [worth] * len(terms), [0.6] * len(terms), {}, 0.05).prepare()


@pytest.mark.parametrize(
    ("text", "abuse"),
    [
        ("you're an idiot and you don't know it", True),
        ("c'est un idiot qui n'a rien compris", True),
        ("qu’on l’appelle l’idiot d’ici, ce n’est rien", True),
        ("the dogs' idiot and the cats' fool", True),
        ("'cause that idiot was rollin' by", True),
        ("he was 'an idiot' to some", False),
        ("‘idiot’ is rude", False),
        ("('idiot!')", False),
        ("'don't be an idiot, that's it' was heard", False),
        ("«l'idiot» est un roman", False),
        ('an "idiot" it\'s not', False),
    ],
)
def test_apostrophes_are_no_quotation(text, abuse):
    assert (scorer([("idiot", False)]).score(text) >= 0.5) == abuse


def test_stems_and_short_terms_take_an_error():
    s = scorer([("achlich", True), ("lowe", True), ("scum", False), ("worthless", False)])
    for word in ("achlichkeit", "achlchkeit", "axhlichzu", "achlicchen", "chlichen", "lxwering", "scumm", "scam", "worthles"):
        assert s.score(f"some {word} there") >= 0.5, word
    for word in ("aclihckeit", "some", "axxlichzu", "scaam", "lxxering"):
        assert s.score(f"a {word} there") < 0.5, word
    a = toxicity.LexiconAutomaton([("achlich", True), ("achlichkeit", False)], stem_errors=1)
    assert [a.match(w) for w in ("achlichkeit", "achlichkeim", "axhlichzu")] == [(1, 0), (0, 0), (0, 1)]
    assert a.match("axhlixhkeit") == (1, 2) and a.match("achlichzu") == (0, 0)


def test_dropped_states_change_no_match():
    r = random.Random(12)
    letters = "abcde"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
    terms = [(word(), r.random() < 0.3) for _ in range(60)]
    roomy, tight = toxicity.LexiconAutomaton(terms, stem_errors=1), toxicity.LexiconAutomaton(terms, stem_errors=1, pairs=500)
    most = 0
    for _ in range(3000):
        w = word()
        assert roomy.match(w) == tight.match(w), w
        most = max(most, len(tight.sets))
    assert most < len(roomy.sets) and tight.held < roomy.held


def families(spark, n=800):
    """Toxic documents hold compounds of one family, each rarely; some are near an ordinary word."""
    r = random.Random(7)
    letters = "abdeilnorst"
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[r.randrange(40)] = "zwergul" + "".join(r.choice(letters) for _ in range(5))
        elif i % 4 == 1:
            text[r.randrange(40)] = "zwerbulon"
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_misspelt_stems_are_found_after_learning(spark):
    d = families(spark)
    s = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic")).prepare()
    assert any(stem and "zwergul".startswith(t) for t, stem in s.terms)
    assert s.score("such zwergulessen here") >= 0.5
    for word in ("zwegulessen", "zwwergulessen", "zwerkulessen", "swergulessen"):
        assert s.score(f"you {word} there") >= 0.5, word
    assert s.score("the zwerbulon stands") < 0.5
