"""Generated pages against a plain extractor, and malformed pages in linear time."""

import random
import time
from html.parser import HTMLParser

import pytest

from stratalog.llm.html import main_text, pieces

WORDS = "lorem ipsum, dolor sit amet; consectetur &amp; adipiscing elit, sed &eacute;t do eiusmod tempor, incididunt ut &lt;labore&gt; et dolore".split()
NOISE = ['<nav><a href="/a">Menu one</a> <a href="/b">Menu two</a></nav>', '<aside><p>Aside text, with commas, of some length, that isn\'t the article.</p></aside>', '<div class="sidebar"><p>More to read, if you like, over there.</p></div>', "<script>var x = '<p>not text</p>';</script>", "<style>p > a { color: red }</style>", '<div class="ad"><p>Buy this, now, today, and save a lot of money.</p></div>', "<form><p>Your mail, please</p><input name='m'></form>", "<!-- <p>commented, out</p> -->", '<div id="comments"><p>First, I liked it, really.</p></div>', '<div style="display: none"><p>hidden, all of it</p></div>']


class Plain(HTMLParser):
    """Texts of the blocks in the element with id "it"; for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.out, self.buffer = 0, [], []

    def handle_starttag(self, tag, attrs):
        if ("id", "it") in attrs or self.depth:
            self.depth += 1
            if tag not in ("b", "a", "i"):
                self.flush()

    def handle_endtag(self, tag):
        if self.depth:
            if tag not in ("b", "a", "i"):
                self.flush()
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.buffer.append(data)

    def flush(self):
        if text := " ".join("".join(self.buffer).split()):
            self.out.append(text)
        self.buffer = []


def page(r):
    def sentence():
        words = [r.choice(WORDS) for _ in range(r.randint(8, 25))]
        if r.random() < 0.3:
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>%s</b>", "<i>%s</i>", '<a href="x?a=1&b=\'2\'">%s</a>']) % words[k]
        return " ".join(words) + "."

    def block():
        body = r.choice([" ", "\n  ", "\t"]).join(sentence() for _ in range(r.randint(2, 5)))
        return r.choice(["<p>%s</p>", '<p class="first">%s</p>', "<blockquote><p>%s</p></blockquote>", "<ul><li>%s</li></ul>"]) % body

    blocks = ["<h1>Title of it</h1>"] + [f"<p>{sentence()} {sentence()}</p>" for _ in range(4)] + [block() for _ in range(r.randint(1, 6))]
    tag = r.choice(["article", "main", "div", "section"])
    article = f'<{tag} id="it">' + r.choice(["", "\n"]).join(blocks) + f"</{tag}>"
    noise = [r.choice(NOISE) for _ in range(r.randint(0, 6))]
    at = r.randint(0, len(noise))
    return "<!DOCTYPE html><html><head><title>T</title></head><body><header><p>Site, name</p></header>" + "\n".join([*noise[:at], article, *noise[at:]]) + "<footer><p>All rights, reserved</p></footer></body></html>"


def test_generated_pages():
    r = random.Random(12)
    for _ in range(400):
        p = page(r)
        plain = Plain()
        plain.feed(p)
        assert main_text(p) == "\n\n".join(plain.out), p


UNIT = {
    "unclosed tags": "<b a=1 ", "unclosed quotes": '<b a="1 ', "both quotes": "<b '\"", "nested divisions": "<div>x, y ", "stray ends": "<div></p>", "less-than signs": "<", "declarations": "<!x ", "unclosed scripts": "<script ",
    "comments": "<!--", "attributes": "<div class='class=\"", "furniture": '<article><div class="ad">x, y',
}


@pytest.mark.parametrize("kind", UNIT)
def test_malformed_pages_take_linear_time(kind):
    def seconds(size):
        p = "<p>x" + UNIT[kind] * (size // len(UNIT[kind]))
        began = time.process_time()
        main_text(p)
        return time.process_time() - began

    small, large = seconds(250_000), seconds(1_000_000)
    assert large < 8 * small + 0.5, (small, large)  # a square would take sixteen times as long


def test_pieces_of_broken_markup():
    got = lambda p: list(pieces(p))
    assert got("a<b c='>'>d</B >e<") == [(None, "a", False), ("b", " c='>'", False), (None, "d", False), ("b", " ", True), (None, "e", False), (None, "<", False)]
    assert got("1 < 2 <p") == [(None, "1 ", False), (None, "<", False), (None, " 2 ", False), (None, "<", False), (None, "p", False)]
    assert got("<!doctype html><?x?><script>a<b</script><p>") == [("p", "", False)] and got("<!-- a") == [] and got("") == []
