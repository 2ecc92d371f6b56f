import pytest

from stratalog.llm.html import main_text

TEXT = "<p>Main text, of some length, with commas.</p><p>More of it, here, and more.</p>"
WANT = "Main text, of some length, with commas.\n\nMore of it, here, and more."
SIDE = '<div class="sidebar"><p>Side, bar.</p></div>'
REPLIES = '<div id="comments">' + "<p>First, post, here, and, so, on, it, goes!</p>" * 9 + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div id="content" class="with-sidebar">{TEXT}</div>{SIDE}',
        f'<div class="entry-content has-related">{TEXT}</div>{SIDE}',
        f'<div id="page" class="header-fixed"><nav>a</nav>{TEXT}{SIDE}</div>',
        f'<div id="page" class="header-fixed"><div class="entry">{TEXT}</div>{SIDE}{REPLIES}</div><footer>f</footer>',
        f'<div class="has-sidebar"><article>{TEXT}</article>{SIDE}</div>{REPLIES}',
        f'<div class="no-banner"><main><div class="post has-share">{TEXT}</div></main></div>',
        f'<article><div class="entry-content has-related">{TEXT}</div>{SIDE}</article>{REPLIES}',
        f'<div class="nav-open"><div class="search-on"><div>{TEXT}</div></div></div>',
        f'<article>{TEXT}</article>{SIDE}{REPLIES}',
        f'<div id="text">{TEXT}</div>{REPLIES}',
        f'<div id="text">{TEXT}</div><div class="sidebar" style="display:none">{TEXT}{TEXT}</div>',
        f'<div id="text">{TEXT}</div><div class="sidebar"><p>Side, bar, a, b, c, d, e, f, g, h, i.</p></div>',
        f'{TEXT}<div class="sidebar"><p>Side, bar, a, b, c, d, e, f, g, h, i.</p></div>',
        f'<article>{TEXT}<div class="related"><p>Side, bar, a, b, c, d, e, f, g, h, i.</p></div></article>',
    ],
)
def test_wrappers_named_as_furniture(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT
