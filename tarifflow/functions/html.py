"""Text of arbitrary HTML: native where that is exact, a real parser elsewhere."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text

# --- fixed values -----------------------------------------------------------
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Their strings are kept apart from a page's text.
SIDE_TEXT_TAGS = ("rp", "rt", "template")
# --- end of fixed values ----------------------------------------------------

_HIDDEN = frozenset(text.DROPPED_TAGS + SIDE_TEXT_TAGS)


class _VisibleText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.node: list[str] = []
        self.nodes: list[str] = []

    def end_node(self):
        node = "".join(self.node).strip()
        if node:
            self.nodes.append(node)
        self.node.clear()

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in VOID_TAGS:
            self.open.append(tag)
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.hidden -= closed in _HIDDEN
                if closed == tag:
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.node.append(data)

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_node()
        if data.startswith("CDATA[") and not self.hidden:
            self.nodes += [s for s in [data[6:].strip()] if s]


def visible_text(html: str) -> str:
    parser = _VisibleText()
    try:
        parser.feed(html)
        parser.close()
    except Exception:  # an unparsable page is kept as it is
        return html
    parser.end_node()
    return " ".join(parser.nodes)


@F.pandas_udf(StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """Text of arbitrary pages, by the parser alone."""
    return pages.map(lambda page: None if page is None else visible_text(page))


def with_html_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """Adds the text of the HTML column.  Rows the native chain handles exactly
    stay in the JVM; only the others are handed to Python (the rest travel as
    nulls).  The test for that is a column of its own, so it runs once."""
    marked = df.withColumn("_plain", F.expr(text.html_is_plain_sql(html)))
    parsed = page_text(F.when(~F.col("_plain"), F.col(html)))
    native = F.when(F.col("_plain"), text.html_to_text(html))
    return marked.withColumn(out, F.coalesce(parsed, native)).drop("_plain")


def with_clean_content(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds the cleaned text of a column of arbitrary HTML; null gives an empty text."""
    shown = with_html_text(df, raw, "_shown")
    return shown.withColumn(out, F.coalesce(text.normalize_ws("_shown"), F.lit(""))).drop("_shown")
