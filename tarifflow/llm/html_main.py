"""Main text of web pages by tag-path ratios.

A page is cut into text nodes with their root-to-leaf path of block tags.  Nodes
below elements that never hold main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, reader comments) are left out.  Such an element is
told by its tag, its role, or a class or id that is, or ends in, a label sites give to
furniture; a name that only ends in one says nothing about an element that holds most of
the page's text, and no name does about one around an article or main element.  A header
inside an article gives its headings.  For every path of the rest, text length and
punctuation per node are aggregated, smoothed with those of the enclosing section, fused
into one score and compared with a threshold taken from the page itself.

The paths that reach it choose the content sections: the article or main elements around
their nodes, else the lowest section around all of them, and the sections around that one
as long as the text chosen is half of what they hold.  Every block of these is kept,
whatever its own score: headings, lists, tables and short paragraphs.  Not part of a
section that was grown are divisions of links that hold nothing chosen, and of the body
itself blocks in divisions of their own.

Defined cases: null, empty and unclosed pages work like any other; a tag cut off by the
end of the page is dropped; repeated rows are extracted again; columns are carried
along, those named as the results are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clashing

RESULTS = ("text", "n_chars")

# Element names of the HTML standard, and labels sites give to furniture.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "canvas", "audio", "video"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
SECTIONS = {"article", "body", "div", "main", "section"}
PAGE_LEVEL = {"/html", "/html/body", "/body"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
LABELS_OUT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "notice", "notices",
    "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment",
    "comments", "disqus", "reply", "replies", "form", "search", "pagination", "pager", "toolbar", "masthead", "gdpr", "disclaimer",
}
# Labels that hold however much text there is.
READERS = {"comment", "comments", "disqus", "reply", "replies"}
# After these a name tells what an element has beside it.
BESIDE = {"with", "has", "no", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An open element of the key is closed by a start tag of these.
_ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

# A quote opens a value only behind an equals sign.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

# A path is content if its score is at least this share of the best score of the page.
THRESHOLD = 0.2
# Smoothing: a path's own ratio against that of the section around it, which is in turn
# smoothed with the section around that.
OWN = 0.5


# Whether the text below an element is kept: all, none, or that of headings alone.
_KEPT, _OUT, _HEADINGS_ONLY = 0, 1, 2


class _Open(NamedTuple):
    tag: str
    path: str
    out: int
    inside: tuple[tuple[str, int], ...]
    labels: tuple[int, ...]


class Block(NamedTuple):
    """A block of text; the sections around it, outermost first, are (tag, where it begins)."""

    path: str
    text: str
    inside: tuple[tuple[str, int], ...]
    links: int


def _label(name: str) -> tuple[str, bool] | None:
    """(label, whether the whole name is one) that a class or id ends in."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if name.lower() in LABELS_OUT or len(parts) == 1 and parts[0] in LABELS_OUT:
        return parts[-1], True
    if len(parts) > 1 and parts[-1] in LABELS_OUT and BESIDE.isdisjoint(parts[:-1]):
        return parts[-1], parts[-1] in READERS
    return None


def _furniture(tag: str, attrs: str) -> bool | None:
    """True if the element holds no main text, None if so unless most text is in it."""
    if tag in LEFT_OUT:
        return True
    found = False
    for name, *values in _ATTR.findall(attrs):
        value = html.unescape("".join(values))
        if name.lower() == "role":
            if value.strip().lower() in ROLES_OUT:
                return True
        elif tag not in ("html", "body", "article", "main"):
            for label in map(_label, value.split()):
                if label is not None:
                    found = True if label[1] or found is True else None
    return found


def text_nodes(page: str) -> list[Block]:
    """Blocks of text outside furniture, in page order."""
    stack = [_Open("", "", _KEPT, (), ())]
    out: list[tuple[Block, tuple[int, ...]]] = []
    held: list[str] = []
    linked: list[str] = []
    in_link = False
    sure: dict[int, bool] = {}  # labelled elements by where they begin

    def close_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            links = len(" ".join("".join(linked).split()))
            held.clear()
            linked.clear()
            if text:
                out.append((Block(stack[-1].path, text, stack[-1].inside, links), stack[-1].labels))

    def pop(to: int) -> None:
        close_block()
        del stack[to:]

    def add(raw: str) -> None:
        if raw and stack[-1].out == _KEPT:
            held.append(html.unescape(raw))
            if in_link:
                linked.append(held[-1])

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue  # a comment, a declaration, or a tag cut off by the end
        if tag == "a":
            in_link = not m[1]
        if m[1]:
            if tag == "br" or tag in INLINE:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            continue
        if tag in INLINE:
            if _furniture(tag, m[3]) is False:
                continue
            at = _after(page, at, tag)
            in_link = in_link and tag != "a"
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                at = _after(page, at, tag)
            continue
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if (t == "p" and tag in _ENDS_P) or tag in _ENDS.get(t, ()):
                pop(i)
                break
            if t in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                break
        close_block()
        top = stack[-1]
        kept, labels = top.out, top.labels
        if tag in ("article", "main"):
            sure.update(dict.fromkeys(labels, False))  # not furniture: an article is in them
        if kept == _HEADINGS_ONLY and tag in HEADINGS:
            kept = _KEPT
        elif kept == _KEPT:
            if tag == "header" and any(s[0] in ("article", "main") for s in top.inside):
                kept = _HEADINGS_ONLY
            elif tag in LEFT_OUT:
                kept = _OUT
            elif (furniture := _furniture(tag, m[3])) is not False:
                labels = (*labels, at)
                if furniture:
                    sure.setdefault(at, True)
        inside = (*top.inside, (tag, at)) if tag in SECTIONS else top.inside
        stack.append(_Open(tag, f"{top.path}/{tag}", kept, inside, labels))
    close_block()
    return _outside(out, sure)


def _outside(blocks: list[tuple[Block, tuple[int, ...]]], sure: dict[int, bool]) -> list[Block]:
    """Blocks below no labelled element, or only below such as hold most of the text."""
    most = sum(len(b.text) for b, _ in blocks) / 2
    own: dict[int, int] = {}
    for b, labels in blocks:
        if labels:
            own[labels[-1]] = own.get(labels[-1], 0) + len(b.text)

    def holds(label: int) -> bool:
        return sure.get(label, own.get(label, 0) <= most)

    return [b for b, labels in blocks if not any(map(holds, labels))]


def _after(page: str, at: int, tag: str) -> int:
    """Where the element that began before ``at`` ends; nested ones of its name are counted."""
    depth = 1
    raw = tag in ("script", "style", "textarea", "title", "noscript", "iframe")
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>]|\Z)[^>]*(>|\Z)", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif not raw:
            depth += 1
        if depth == 0:
            return m.end()
    return len(page)


def _prefixes(path: str) -> list[str]:
    """The path and its enclosing sections below the body, innermost first."""
    out = [path]
    while (path := path.rpartition("/")[0]) and path not in PAGE_LEVEL:
        out.append(path)
    return out


def content_paths(nodes: list[tuple[str, str]]) -> set[str]:
    """Paths whose fused, smoothed ratios reach the threshold."""
    sums: dict[str, list[int]] = {}
    for path, text in nodes:
        signs = len(_PUNCTUATION.findall(text))
        for prefix in _prefixes(path):
            s = sums.setdefault(prefix, [0, 0, 0])
            s[0] += len(text)
            s[1] += signs
            s[2] += 1
    fused = {p: chars / n * (1 + signs / n) for p, (chars, signs, n) in sums.items()}
    score = {}
    for path in {p for p, _ in nodes}:
        outermost, *inner = reversed(_prefixes(path))
        smoothed = fused[outermost]
        for prefix in inner:
            smoothed = OWN * fused[prefix] + (1 - OWN) * smoothed
        score[path] = smoothed
    best = max(score.values(), default=0.0)
    return {p for p, s in score.items() if s >= THRESHOLD * best}


def _article(inside: tuple[tuple[str, int], ...]) -> tuple[str, int] | None:
    for tag in ("article", "main"):
        for s in reversed(inside):
            if s[0] == tag:
                return s
    return None


def _common(blocks: list[Block]) -> tuple[tuple[str, int], ...]:
    """The sections around all of the blocks, outermost first."""
    first, last = min(b.inside for b in blocks), max(b.inside for b in blocks)
    n = 0
    while n < min(len(first), len(last)) and first[n] == last[n]:
        n += 1
    return first[:n]


def _grown(blocks: list[Block], chosen: list[Block]) -> list[Block]:
    """The blocks of the section around all chosen ones, grown while these are half of it."""
    around = [s for s in _common(chosen) if s[0] != "body"]
    if not around:
        return []
    have = sum(len(b.text) for b in chosen)
    region = around[-1]
    for s in reversed(around[:-1]):
        if 2 * have < sum(len(b.text) for b in blocks if s in b.inside):
            break
        region = s
    own = {s for b in chosen for s in b.inside}
    sums: dict[tuple[str, int], list[int]] = {}
    for b in blocks:
        for s in b.inside:
            x = sums.setdefault(s, [0, 0])
            x[0] += len(b.text)
            x[1] += b.links
    lists = {s for s, (n, links) in sums.items() if 2 * links > n and s not in own} if region != around[-1] else set()
    return [b for b in blocks if region in b.inside and lists.isdisjoint(b.inside)]


def main_text(page: str | None) -> str:
    blocks = text_nodes(page or "")
    paths = content_paths([(b.path, b.text) for b in blocks])
    chosen = [b for b in blocks if b.path in paths]
    if not chosen:
        return ""
    articles = {_article(b.inside) for b in chosen} - {None}
    loose = [b for b in chosen if _article(b.inside) is None]
    if not articles:
        kept = _grown(blocks, chosen)
        if kept:
            return "\n".join(b.text for b in kept)
    # Beside an article, or in several divisions of the body: the nearest sections.
    near = {b.inside[-1] if b.inside and b.inside[-1][0] != "body" else None for b in loose}

    def part(b: Block) -> bool:
        if not (near | articles).isdisjoint(b.inside):
            return True
        return b.path in paths or (None in near and all(s[0] == "body" for s in b.inside))

    return "\n".join(b.text for b in blocks if part(b))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the HTML column."""
    pages = clashing(pages, RESULTS)
    kept = [f for f in pages.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            cols = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *RESULTS])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[F.col(f.name) for f in kept], F.col(html_col).cast("string")).mapInArrow(run, schema)
