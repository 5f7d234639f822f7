"""Pages of many layouts: no wrapper's name empties a page, and boilerplate stays out."""

import random
import time

import pytest

from corvane.llm.html_text import main_text

TITLE, ONE, TWO = "The title of it", "One two three four five six seven eight nine ten eleven twelve.", "A second paragraph has words of its own and goes on a little."
TEXT = f"<h1>{TITLE}</h1><p>{ONE}</p><p>{TWO}</p>"
WANT = f"{TITLE}\n{ONE}\n{TWO}"
SIDE = '<div class="sidebar"><ul><li><a href="/">Link one</a></li><li><a>Link two</a></li></ul><p>About us.</p></div>'
FOOT = "<footer><p>Words and more words here at the foot of the page</p></footer>"
READER = "I am a reader and write long comments that go on for many words, more than the article has, here and there and everywhere."
COMMENTS = f'<div class="comments"><h3>Comments</h3><article class="comment"><p>{READER}</p></article><div class="comment"><p>{READER} Again.</p></div></div>'

PAGES = {
    "wrapper of content and sidebar": f'<div class="content-sidebar-wrap"><main>{TEXT}</main>{SIDE}</div>{FOOT}',
    "fixed header": f'<div id="page" class="header-fixed"><article>{TEXT}</article></div>{FOOT}',
    "sticky footer": f'<div class="sticky-footer-wrap"><article>{TEXT}</article>{SIDE}</div>{FOOT}',
    "closed menu": f'<div class="nav-closed"><main>{TEXT}</main></div>',
    "main with sidebar": f'<div class="main-with-sidebar"><article>{TEXT}</article>{SIDE}</div>',
    "related content": f'<div class="related-content-page"><article>{TEXT}</article></div>{FOOT}',
    "discussion": f'<section id="discussion">{TEXT}</section>{FOOT}',
    "form around a page": f'<form id="aspnetForm"><div>{TEXT}</div></form>{FOOT}',
    "form around main": f"<form><main>{TEXT}</main></form>{FOOT}",
    "wrapper inside main": f'<main><div class="content-sidebar-wrap">{TEXT}</div>{SIDE}</main>{FOOT}',
    "long comments after": f'<div class="sticky-footer-wrap"><article>{TEXT}</article>{COMMENTS}</div>{FOOT}',
    "long comments in the article": f"<article>{TEXT}{COMMENTS}</article>{FOOT}",
    "neither article nor main": f'<div class="content-sidebar-wrap">{TEXT}{SIDE}</div>{FOOT}',
    "nested wrappers": f'<nav><a>Home</a> <a>x</a></nav><div class="nav-closed header-fixed"><div>{TEXT}</div>{SIDE}</div>{FOOT}',
    "box in an article": f"<article><h1>{TITLE}</h1><fieldset><p>{ONE}</p></fieldset><p>{TWO}</p></article>",
    "small articles beside": f'<div id="content">{TEXT}</div><div class="related"><article><p>A teaser</p></article><article><p>Teaser two</p></article></div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_no_name_empties_a_page(name):
    assert main_text(f"<html><body>{PAGES[name]}</body></html>") == WANT


WRAPPERS = ["header-fixed", "has-sidebar", "sidebar-right-layout", "nav-closed", "sticky-footer-wrap", "page-wrap", "site promo-theme", "widget-area-wrap", "modal-ready", "social-theme", "", "container"]
JUNK = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>',
    '<div class="sidebar"><h3>Archive</h3><ul><li><a href="/x">January</a></li></ul></div>',
    '<div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div>',
    '<div class="newsletter-box"><form><p>Sign up for letters</p><input name="e"></form></div>',
    '<div class="share-buttons"><a>Share</a> <a>Post</a></div>',
    '<ul class="breadcrumbs"><li><a href="/">Start</a></li></ul>',
    '<aside><p>An aside that says something else at some length, though nobody asked for it.</p></aside>',
    "<script>var a = '<p>no</p>';</script><style>p {}</style>",
    f'<div class="comments"><div class="comment"><p>{READER}</p></div></div>',
]


@pytest.mark.parametrize("seed", range(60))
def test_generated_layouts(seed):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    blocks = [("h1", "A heading of this page")] + [("p", " ".join(r.choices(words, k=r.randint(12, 60))) + ".") for _ in range(r.randint(2, 8))]
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    core = r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", '<div class="story">{}</div>', '<main><article class="post">{}</article></main>', '<div role="main">{}</div>', "<form><div>{}</div></form>"]).format(body)
    page = core
    for _ in range(r.randint(1, 4)):
        before, after = "".join(r.sample(JUNK[:6], r.randint(0, 2))), "".join(r.sample(JUNK, r.randint(0, 2)))
        page = f'<div class="{r.choice(WRAPPERS)}">{before}{page}{after}</div>'
    assert main_text(f'<html><body class="{r.choice(WRAPPERS)}">{page}{FOOT}</body></html>') == "\n".join(x for _, x in blocks)


def test_time_is_linear_in_named_wrappers():
    def seconds(n):
        page = '<div class="nav-wrap"><form>' * n + TEXT + "</form></div>" * n + '<div class="sidebar"><p>x y</p></div>' * n
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    seconds(500)
    assert seconds(8000) < 14 * max(seconds(1000), 0.02)
