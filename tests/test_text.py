import random
import re
from hashlib import sha256

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tarifflow.functions import text as X
from tarifflow.functions.html import visible_text, with_html_text
from tarifflow.functions.register import register


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, x STRING")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_strip_equals_python_strip_for_all_bmp_characters(spark):
    texts = [chr(c) + "a" + chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    assert values(spark, texts, X.strip("x")) == [t.strip() for t in texts]


def test_url_domain_keeps_port_user_and_case(spark):
    urls = ["https://example.com/pricing", "http://Me@Host.COM:8080/x?y#z", "http://a b/x y", "plain", "", "//h/p"]
    assert values(spark, urls, X.url_domain("x")) == ["example.com", "Me@Host.COM:8080", "a b", "", "", "h"]


def test_html_to_text_drops_script_and_style(spark):
    page = "<style>p{}</style><script>var a='</p>';</script><p>Model V3: <b>$0.59</b> per 1M</p>"
    assert values(spark, [page], X.html_to_text("x")) == ["Model V3: $0.59 per 1M"]


def test_html_edge_cases(spark):
    pages = ["<b>$0.59</b>x", "Tax &amp", "a &amp;amp; b", "<!-- <script> -->seen<script>x", "<p>\n a\t</p>\n<p></p>b"]
    assert values(spark, pages, X.html_to_text("x")) == ["$0.59 x", "Tax &", "a &amp; b", "seen", "a b"]


def test_native_html_equals_parser_on_all_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = pages.select("html", X.html_to_text("html").alias("t")).collect()
    assert rows and all(r.t == visible_text(r.html) for r in rows)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p>a &mdash; b &#163;5 &#x20AC;9 &eacute;</p>", "a — b £5 €9 é"),
        ("<svg><svg><text>x</text></svg>y</svg>z", "z"),
        ("<div><svg><path></div>t", "t"),
        ('<a title="a>b">link</a> c', "link c"),
        ("<ruby>K<rt>k</rt></ruby>", "K"),
        ("<template>no</template>yes", "yes"),
    ],
)
def test_pages_beyond_the_native_chain(spark, page, expected):
    df = spark.createDataFrame([(page,)], "h STRING")
    row = with_html_text(df, "h", "t").withColumn("plain", F.expr(X.html_is_plain_sql("h"))).first()
    assert row.t == expected
    assert page.startswith("<p>a &mdash;") or not row.plain


def test_normalize_and_clean(spark):
    assert values(spark, ["  a \t b\n\n\n\nc \xa0"], X.normalize_ws("x")) == ["a b\n\nc"]
    assert values(spark, [None, "", " x  y "], X.clean_content("x", "'markdown'")) == ["", "", "x y"]


def test_cap_and_note(spark):
    long = "x" * 60000
    df = spark.createDataFrame([(long,), ("short",)], "x STRING")
    cut, kept = [r.t for r in df.select(X.truncate_guard("x").alias("t")).collect()]
    assert cut.was_truncated and cut.original_length == 60000
    assert cut.content == long[:50000] + "\n\n[...content truncated: showing 50,000 of 60,000 characters...]"
    assert (kept.content, kept.was_truncated, kept.original_length) == ("short", False, 5)


def test_cap_counts_code_points(spark):
    df = spark.createDataFrame([("€😀" * 5,)], "x STRING")
    t = df.select(X.truncate_guard("x", 4).alias("t")).first().t
    assert t.content.startswith("€😀€😀\n\n[...content truncated: showing 4 of 10 ")


def test_hash(spark):
    texts = ["", "a", "é€"]
    assert values(spark, texts + [None], X.content_hash("x")) == [sha256((t or "").encode()).hexdigest() for t in texts + [None]]


def test_freshness_edges(spark):
    times = ["2026-01-01T12:00:00", "2026-01-01T12:00:00.000001", "2026-01-03T00:00:00", "no time", None]
    fresh = values(spark, times, X.is_fresh("x", "'2026-01-02T12:00:00'"))
    assert fresh == [False, True, True, False, False]


PRICE = re.compile(r"[$€£]\s?\d|\d+\.\d{2}|per\s+1?[MK]?\s*tokens?", re.IGNORECASE)


def test_price_pattern_equals_python(spark):
    templates = ["${}5", "{}5.25", "per{}1M tokens", "per 1M{}token", "{}.55", "per 1M input tokens{}", "PER K TOKENſ{}"]
    chars = [chr(c) for c in (*range(1, 0x600), *range(0x660, 0x66A), *range(0x2000, 0x2070), 0x3000, 0x212A)]
    lines = [t.format(c) for t in templates for c in chars]
    assert values(spark, lines, X.is_price_like("x")) == [bool(PRICE.search(s)) for s in lines]


def test_url_and_clip_and_tokens(spark):
    assert values(spark, ["see (https://x.y/a?b), ok", "none"], X.first_url("x")) == ["https://x.y/a?b),", None]
    assert values(spark, ["+  " + "y" * 300 + " \n"], X.clip_line("x")) == ["y" * 200]
    assert values(spark, ["$ 5 and 2.50, PER K token"], X.price_tokens("x")) == [["$ 5", "2.50", "PER K token"]]


def test_registered_functions_stay_plain_expressions(spark):
    register(spark)
    df = spark.sql("SELECT is_price_like(x) AS p, url_domain('https://a.b/c') AS d FROM VALUES ('$5'), ('no') AS t(x)")
    assert [(r.p, r.d) for r in df.collect()] == [(True, "a.b"), (False, "a.b")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_plain_page_differs_from_the_parser(spark):
    rng = random.Random(3)
    pieces = (
        "text ", "$5 ", "<p>", "</p>", "</ p>", "<br/>", "<svg/>", "<svg>", "</svg>", "<svg a='b'/>", "<script/>", "<script>", "</script>",
        "<style>", "</style >", "<!-- c -->", "<!--", "-->", "<!x>", "<?x>", "</>", "&lt;", "&ltx", "&amp;lt;", "&copy", "&copysr;", "&quot",
        "&ampx", "&nope;", "<title>", "</title>", "<a href='x>y'>", "<svg-x>", "<noscript>", "</noscript>", "<", ">", "<b", "<![CDATA[x]]>", "\n",
    )
    pages = ["<svg/>text $5", "<script/>s", "</ p>x", "&ltx"] + ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(6000)]
    df = spark.createDataFrame([(p,) for p in pages], "h STRING").repartition(8)
    rows = df.select("h", F.expr(X.html_is_plain_sql("h")).alias("plain"), X.html_to_text("h").alias("t")).collect()
    wrong = [(r.h, r.t, visible_text(r.h)) for r in rows if r.plain and r.t != visible_text(r.h)]
    assert not wrong, wrong[:5]
    assert sum(r.plain for r in rows) > 1000
    both = with_html_text(df.limit(400), "h", "t").collect()
    assert all(r.t == visible_text(r.h) for r in both)


def test_icon_rich_page_takes_linear_time(spark):
    page = "<p>a</p>" + "<svg><path d='M0 0'></path></svg> icon " * 20_000
    row = spark.createDataFrame([(page,)], "h STRING").select(F.expr(X.html_is_plain_sql("h")).alias("plain")).first()
    assert row.plain


def test_oracle_text_depends_on_no_table_of_the_code(monkeypatch):
    """Without one of the code's references the comparison SQL still decodes it."""
    from tarifflow.plans import oracle_parts

    before = oracle_parts.html_text("html")
    monkeypatch.setattr(X, "ENTITIES", {})
    monkeypatch.setattr(X, "OPEN_ENTITIES", {})
    assert oracle_parts.html_text("html") == before and "&hellip;" in before


def test_page_text_as_sql_function(spark):

    assert "page_text" in register(spark)
    pages = ['<p title="a>b">x &frac12; y</p>', "<template>no</template>yes <b>$0.59</b>x", "", "<![CDATA[z]]> &#8364;5"]
    spark.createDataFrame(list(enumerate(pages)), "i INT, page STRING").createOrReplaceTempView("odd_pages")
    got = spark.sql("SELECT page_text(page) AS t FROM odd_pages ORDER BY i").collect()
    assert [r.t for r in got] == [visible_text(p) for p in pages]


def test_html_text_takes_no_step_per_node(spark):
    """A page's text is cut by one pattern, whatever its number of nodes; texts stay the same."""
    cases = {
        "<p>a</p> \t<b>\xa0</b><i> b  c </i>　": "a b  c",
        "a\x01\x01 b<br/>\n&amp;lt; &ampx &nbsp;<p>&nbsp;</p>&copy z": "a b &lt; &x © z",
        "T &amp; f<!-- <script> --><script>q</p></script><p>1 left": "T & f 1 left",
        "&am<b>p;": "&am p;", "": "", " \x1c ": "",
    }
    rows = spark.createDataFrame([(h,) for h in [*cases, None]], "h STRING").select("h", X.html_to_text("h").alias("t"))
    assert {r.h: r.t for r in rows.collect()} == {**cases, None: None}
    assert "filter(" not in X.html_to_text_sql("h") and "split(" not in X.html_to_text_sql("h")


def test_runs_of_blanks(spark):
    cases = {"a b": "a b", "a\tb": "a b", "a \tb": "a b", "a\t b  c": "a b c", "a\n \nb": "a\n \nb", "a\n\n\n\n b": "a\n\n b"}
    rows = spark.createDataFrame([(h,) for h in cases], "h STRING").select("h", X.normalize_ws("h").alias("t"))
    assert {r.h: r.t for r in rows.collect()} == cases


def test_hundredths_equal_rounding(spark):
    from tarifflow.plans.derived import hundredths

    cents = spark.range(-20_000, 20_000).selectExpr("id / 100D AS x").union(spark.sql("SELECT explode(array(0.125D, -0.125D, 0.045D, 12345.675D, NULL))"))
    assert cents.where(f"NOT ({hundredths('x')} <=> CAST(round(x * 100) AS BIGINT))").count() == 0
