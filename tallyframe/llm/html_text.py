"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text inside them, less that of links. The best one is the smallest that holds
all real text of the page; it votes, with its score, for its generalised path (tags and classes without digits) on its
host; votes are summed by host and path in Spark. Pages are then extracted again from the containers on their host's
winning path, or, where a page has none, from its own best container. A winning path never takes away what the page's
best container holds around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import host_of
from .storage import free_names, staged

#: Winning paths of up to so many hosts are broadcast; more are joined in ``SALTS`` parts a host.
BROADCAST_HOSTS, SALTS = 50_000, 16
# A quoted value follows an equals sign. It may hold a ">", and a "<" if the quote that ends it is followed by what may follow
# a value; with a quote left open, a tag ends at its first ">". A tag has at most 16 values with a "<", so that no
# sequence of tags that don't end is gone through more than so often.
_VALUE = r"""=\s*+(?:"[^"<]*+"|'[^'<]*+'|(?!["']))"""
_DEEP = r"""=\s*+(?:"[^"]*+"|'[^']*+')(?=[\s/>])"""
_LOOSE = rf"""(?:[^<>"'=]++|["']|{_VALUE}|(?!{_DEEP})=)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<!?/?[A-Za-z?]{_LOOSE}(?:{_DEEP}{_LOOSE}){{0,16}}+>|[^<]++|<""", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no text, and those that end only at their own end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "head", "option", "audio", "video", "map"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center", "header", *BOILERPLATE}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "tbody", "thead", "tfoot", "tr", "th", "figure", "figcaption", "address", "hr", "summary", "details", "fieldset", "legend", "caption", "hgroup"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that mark boilerplate; words that make such a name tell of a page's state or of what is beside
#: the element; and words that may stand beside a mark. A name marks only as a whole: each of its words is a mark or one
#: of the last kind, and one at least is a mark.
STATES = {"has", "no", "not", "with", "without", "is", "are", "in", "enabled", "disabled", "open", "opened", "closed", "active", "inactive", "on", "off", "show", "shown", "above", "below", "left", "right", "wrap", "wrapper", "layout", "page", "grid", "row", "main", "content", "article", "body", "text"}
MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "skip",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promoted", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall",
    "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "widget", "search", "searchform", "hidden",
    "contentinfo", "complementary", "alert", "alertdialog", "tooltip",
}
BESIDE = {
    "site", "top", "bottom", "header", "head", "box", "bar", "block", "list", "lists", "link", "links", "item", "items", "container", "area", "section", "panel", "form", "forms", "button", "buttons", "btn", "icon", "icons", "media",
    "post", "posts", "story", "stories", "articles", "news", "slot", "unit", "space", "global", "primary", "secondary", "mobile", "desktop", "inner", "outer", "group", "col", "column", "zone", "region", "holder", "thread", "count",
    "feed", "js", "ui", "bottom", "floating", "sticky", "fixed", "user", "reader", "readers", "policy", "message", "messages", "us", "to", "the", "and", "a", "of", "more", "tools", "nested", "level", "sub", "first", "last",
}
_WORDS = re.compile(r"[a-z]+")
#: Characters, but those of links, that make a block real text; the part of a page's score that an article or main has at
#: least to be its text whatever stands outside; and the part of a page's text that no mark takes away.
REAL, ARTICLE, MOST = 40, 0.5, 0.5
#: Elements that a start tag closes, and those that shield what is outside them.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SHIELDS = {"ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "main", "body"}


class _Element:
    __slots__ = ("depth", "junk", "marked", "parent", "path", "real", "score", "size", "tag", "whole")

    def __init__(self, tag, parent, path, junk, marked, whole):
        self.tag, self.parent, self.path, self.junk, self.marked, self.whole = tag, parent, path, junk, marked, whole
        self.score, self.size, self.real = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


def _marks(tag: str, found: dict[str, str]) -> bool:
    """Whether an element's names mark it as boilerplate."""
    if tag in ("html", "body", "article", "main"):
        return False
    for name in " ".join(found.get(name, "") for name in ("class", "id", "role")).lower().split():
        words = _WORDS.findall(name)
        if not MARKS.isdisjoint(words) and (len(words) == 1 or STATES.isdisjoint(words)) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


def parse(html: str) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """The blocks of text that aren't boilerplate, each with the element it stands in, and all containers, in page order."""
    root = _Element("#root", None, "", False, False, False)
    elements: list[_Element] = [root]
    at = root
    blocks: list[tuple[_Element, str, int]] = []
    held: list[str] = []
    linked = in_link = 0
    skip = None

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((at, text, linked))
                at.size += len(text)
            linked = 0

    for token in _TOKEN.findall(html):
        if token[0] != "<":
            if skip is None:
                held.append(token)
                if in_link:
                    linked += len(token.strip())
            continue
        name = _NAME.match(token)
        if name is None:
            if token == "<" and skip is None:
                held.append("&lt;")
            continue
        tag = name[1].lower()
        ends = token[1] == "/"
        if skip is not None:
            if ends and tag == skip:
                skip = None
            continue
        if not ends and tag in RAW:
            if token[-2] != "/":
                skip = tag
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag in ("br", "wbr", "img"):
                held.append(" " if tag != "wbr" else "")
            continue
        flush()
        in_link = 0
        if ends:
            box = at
            while box is not root and box.tag != tag:
                if tag == "p" and box.tag in CONTAINERS:
                    break
                box = box.parent
            if box is not root and box.tag == tag:
                at = box.parent
            continue
        if tag in VOID:
            continue
        if at.tag == "p" or (at.tag in HEADINGS and tag in HEADINGS):
            at = at.parent
        if shut := _CLOSED_BY.get(tag):
            box = at
            while box is not root and box.tag not in shut and box.tag not in _SHIELDS:
                box = box.parent
            if box.tag in shut:
                at = box.parent
        found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(token, name.end())} if len(token) > name.end() + 1 else {}
        inner = at.whole or tag in ("article", "main")
        heads = tag == "header" or tag not in ("html", "body", "article", "main") and "header" in _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
        # An article's own header is junk but for its headings.
        title = tag in HEADINGS and at.tag == "header" and at.whole and not at.parent.junk
        junk = not title and (at.junk or tag in BOILERPLATE or "hidden" in found or heads and not at.whole or tag == "header")
        path = at.path
        if tag in CONTAINERS:
            kinds = sorted({re.sub(r"[0-9]+", "", k) for k in found.get("class", "").lower().split()} - {""})
            path = f"{path}/{tag}" + "".join("." + k for k in kinds)
        at = _Element(tag, at, path, junk, _marks(tag, found), inner)
        elements.append(at)
    if skip is None:
        flush()
    return _judged(elements, blocks)


def _judged(elements: list[_Element], blocks: list[tuple[_Element, str, int]]) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """What is no boilerplate, scored. A mark counts only where most of the page's text stands outside."""
    for e in reversed(elements[1:]):
        if not e.junk:
            e.parent.size += e.size
    most = MOST * elements[0].size
    for e in elements[1:]:  # a title is judged by its article, as it stands in a header
        above = e.parent.parent if e.parent.tag == "header" and not e.junk and e.tag in HEADINGS and e.parent.parent else e.parent
        e.junk = e.junk or above.junk or e.marked and e.size < most
    kept = []
    for at, text, linked in blocks:
        if at.junk:
            continue
        kept.append((at, text))
        own = max(0.0, len(text) - 2.0 * linked)
        at.score += own * (1.0 if at.tag in ("p", "pre", "blockquote", "li") or at.tag in HEADINGS else 0.6)
        at.real += own >= REAL or at.tag in HEADINGS and own > 0
    for e in reversed(elements[1:]):
        e.parent.score += e.score
        e.parent.real += e.real
    return kept, [e for e in elements if not e.junk and (e.tag in CONTAINERS or e.parent is None)]


def _best(containers: list[_Element]) -> _Element:
    """From the page down, the container that holds all real text, or is an article or main with most of the score."""
    at, whole = containers[0], containers[0].score
    for box in containers[1:]:  # in page order, what is inside a container comes after it
        if _above(box, at) and box.score > 0 and (box.real >= at.real and box.score >= 0.5 * at.score or box.tag in ("article", "main") and box.score >= ARTICLE * whole):
            at = box
    return at


def _above(box: _Element, at: _Element) -> bool:
    while box.depth > at.depth:
        box = box.parent
    return box is at


def _inside(box: _Element | None, ends: set[int]) -> bool:
    while box is not None:
        if id(box) in ends:
            return True
        box = box.parent
    return False


def main_text(html: str, path: str | None) -> str:
    """The text of the containers on ``path``, or of the best container where there is none; blocks joined by two \\n.

    A path adds text or leads to another part of the page, and takes no real text away: where the page's best container
    holds one on the path, and so what is real in and outside of it, its text is taken as well.
    """
    blocks, containers = parse(html)
    if not blocks:
        return ""
    best, on_path = _best(containers), [c for c in containers if path and c.path == path]
    chosen = {id(c) for c in on_path}
    if any(_inside(c, {id(best)}) for c in on_path):
        chosen.add(id(best))
    text = "\n\n".join(t for at, t in blocks if _inside(at, chosen)) if chosen else ""
    return text or "\n\n".join(t for at, t in blocks if _inside(at, {id(best)}))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: dict[tuple[str, str], float] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, containers = parse(html)
            if blocks and (best := _best(containers)).path:
                key = (host, best.path)
                tally[key] = tally.get(key, 0.0) + best.score
        yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in tally], pa.string()), "path": pa.array([k[1] for k in tally], pa.string()), "score": pa.array(tally.values(), pa.float64())})


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path): the path with the most votes of each host. Pages without a host are left out; of equals the path
    that is first by name wins."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("host is not null and html is not null")
    votes = rows.mapInArrow(_votes, "host string, path string, score double").groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score"))
    return staged(votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path")), "host-paths")


def main_texts(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``, the main text of each row's html; further columns stay, one of that name is replaced.

    Null, empty and text-free html gives an empty text. A page without a host (null or odd url) is extracted by its own
    best container. Repeated rows are extracted each; an empty table stays empty.
    """
    paths = host_paths(pages, html_col, url_col)
    rows = pages.drop(*(c for c in pages.columns if c == text_col and c != html_col))
    host, path, salt = free_names(rows, "host", "path", "salt")
    rows = rows.withColumn(host, host_of(F.col(url_col)))
    paths = paths.select(F.col("host").alias(host), F.col("path").alias(path))
    if paths.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(paths), host, "left")
    else:
        parts = paths.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int")).join(parts, [host, salt], "left").drop(salt)

    def texts(html: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([main_text(h, p) if h else "" for h, p in zip(html.to_pylist(), path.to_pylist(), strict=True)], pa.string())

    from pyspark.sql.functions import arrow_udf

    return rows.withColumn(text_col, arrow_udf(texts, "string")(F.col(html_col).cast("string"), path)).drop(host, path)
