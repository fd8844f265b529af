"""Quoted markup, names that mark as a whole, paths that take nothing away, and generated pages whose text is known."""

from __future__ import annotations

import html as escapes
import random
import time

import pytest

from tallyframe.llm import html_text

BODY, END = "The body goes on about it at some length, as bodies do, and then some more.", "The closing words sum it all up for readers in a hurry."


def text(html: str, path: str | None = None) -> str:
    return html_text.main_text(html, path)


@pytest.mark.parametrize(
    "tag, want",
    [
        ('<img alt="1 < 2">', ""), ('<a title="x < y">here</a>', "here"), ("<a title='<b>no</b>' href=x>here</a>", "here"), ('<a title = "a > b < c"\n href="d">here</a>', "here"), ('<a data-x="<p class=\'y\'>" b>here</a>', "here"),
        ('<a href="x>here</a> <i class="y">too</i>', "here too"), ("<a href='x>here</a> it's", "here it's"), ('<a href="x">it"s</a>', 'it"s'), ("a < b and c > d", "a < b and c > d"), ('<a href=x"y>here</a>', "here"), ('<a ="x">here</a>', "here"),
    ],
)
def test_quoted_markup_is_no_text(tag, want):
    assert text(f"<article><p>{BODY} {tag}</p><p>{END}</p></article>") == f"{BODY} {want}".strip() + f"\n\n{END}"


@pytest.mark.parametrize("name", ["social-history", "search-results-of-the-study", "related-work", "advertising-law", "menu-of-the-day", "share-prices", "notice-period", "comment-on-method", "history-of-navigation"])
def test_a_name_marks_only_as_a_whole(name):
    assert text(f'<body><article><p>{BODY}</p><div class="{name}"><p>{END}</p></div></article></body>') == f"{BODY}\n\n{END}"


@pytest.mark.parametrize("name", ["social-links", "search-form", "related-posts", "ad-slot", "menu-top", "share-buttons", "cookie-notice", "comment-list", "site-navigation", "newsletter-signup-box", "post-comments", "reader-comments", "sidebar_2"])
def test_whole_names_mark(name):
    assert text(f'<body><article><p>{BODY}</p><div class="{name}"><p>{END}</p></div></article></body>') == BODY


def test_a_winning_path_takes_no_real_text_away():
    page = f'<html><body><div class="story"><p>{BODY}</p></div><div class="more"><p>{END}</p></div></body></html>'
    assert text(page, "/html/body/div.story") == text(page) == f"{BODY}\n\n{END}"
    inner = f'<html><body><div class="story"><h2>Short</h2><div class="text"><p>{BODY}</p></div><p>Bye.</p></div></body></html>'
    assert text(inner, "/html/body/div.story") == f"Short\n\n{BODY}\n\nBye."


@pytest.mark.parametrize("part", ['<a b="<c " ', "<a b='<c d=\"", '<a b="<', "<p x=<", '="<a "', "<a b=\"<c>' ", "<!-- <a '"])
def test_tags_that_do_not_end_take_linear_time(part):
    began = time.perf_counter()
    text("<p>" + part * 40_000)
    assert time.perf_counter() - began < 10


WORDS = "river stone light under seven walking paper garden north often silver before window letter market quiet".split()
JUNK = [
    "<nav><ul><li><a href=/>{}</a></ul></nav>", '<div class="ad">{}</div>', "<aside><p>{}</p></aside>", '<div id="comments"><p>{}</p></div>', "<form><p>{}</p><input></form>", "<script>var a = '<p>{}</p>';</script>", "<style>p {{ {} }}</style>",
    "<!-- {} -->", '<div class="cookie-banner"><p>{}</p></div>', '<div role="navigation">{}</div>', "<noscript>{}</noscript>", '<section class="related-posts"><p>{}</p></section>', '<div hidden><p>{}</p></div>', "<template><p>{}</p></template>",
]


def generated(seed: int) -> tuple[str, str]:
    """A page and its text: blocks of known words in an article of a random shape, junk of known kinds all around."""
    chance = random.Random(seed)
    say = lambda n: " ".join(chance.choice(WORDS) for _ in range(n))
    blocks: list[str] = []

    def inline(words: str) -> str:
        out = []
        for w in words.split():
            kind = chance.randrange(12)
            out.append({0: f"<b>{w}</b>", 1: f'<a href="/{w}?a=1&b=<2>" title="{w} > x">{w}</a>', 2: f"<i class=x>{w}</i>", 3: "".join(f"&#{ord(c)};" for c in w), 4: f"{w}<!-- no -->", 5: f"<span\n id='{w}'>{w}</span>"}.get(kind, w))
        return chance.choice([" ", "\n  ", "\t"]).join(out)

    def block(tag: str, n: int) -> str:
        words = say(n)
        if chance.random() < 0.2:
            words += " x < y & é"
        blocks.append(words)
        shown = inline(words) if "<" not in words else escapes.escape(words)
        return f"<{tag}>{shown}" + ("" if tag in ("p", "li") and chance.random() < 0.5 else f"</{tag}>")

    def part(depth: int) -> str:
        out = []
        for _ in range(chance.randrange(2, 5)):
            kind = chance.randrange(8)
            if kind < 4:
                out.append(block("p", chance.randrange(12, 60)))
            elif kind == 4:
                out.append(block("h2", 3))
            elif kind == 5:
                out.append("<ul>" + "".join(block("li", chance.randrange(2, 9)) for _ in range(3)) + "</ul>")
            elif kind == 6 and depth < 3:
                out.append(f'<div class="{chance.choice(["text", "part-2", "body copy"])}">{part(depth + 1)}</div>')
            else:
                out.append(chance.choice(JUNK).format(say(8)))
        return "".join(out)

    junk = lambda: "".join(chance.choice(JUNK).format(say(chance.randrange(3, 20))) for _ in range(chance.randrange(3)))
    main = "<article>" + block("h1", 4) + block("p", 40) + part(0) + block("p", 30) + "</article>"
    if chance.random() < 0.5:
        main = f'<div class="layout">{junk()}<main>{main}</main>{junk()}</div>'
    page = f"<!DOCTYPE html><html><head><title>{say(4)}</title></head><body><header><h1>{say(2)}</h1></header>{junk()}{main}{junk()}<footer><p>{say(9)}</p></footer></body></html>"
    return page, "\n\n".join(blocks)


def test_generated_pages_give_their_text(spark):
    pages = {k: generated(k) for k in range(300)}
    rows = [(k, f"http://h{k % 7}.com/{k}", page) for k, (page, _) in pages.items()]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {k: got[k] for k in pages} == {k: want for k, (_, want) in pages.items()}
