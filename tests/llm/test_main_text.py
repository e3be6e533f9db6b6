"""Article text that must not get lost, and furniture that must."""

import pytest

from tarifflow.llm import html_main

P = "This is paragraph {}, with a full sentence, some commas, and an end. It goes on for a while."


def paragraphs(n):
    return "".join(f"<p>{P.format(i)}</p>" for i in range(n))


ALL = [P.format(i) for i in range(3)]
LINKS = "<ul><li><a href=x>First link</a></li><li><a href=y>Second link</a></li></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content-with-sidebar"><article><h1>T</h1>{paragraphs(3)}</article><div class="sidebar"><p>Aside.</p></div></div>', ["T", *ALL]),
        (f'<div class="content-sidebar"><h1>T</h1>{paragraphs(3)}<div class="left sidebar"><p>Aside.</p></div></div>', ["T", *ALL]),
        (f'<div id="sidebar"><main><h1>T</h1>{paragraphs(3)}</main></div>', ["T", *ALL]),
        (f'<article><h1>T</h1>{paragraphs(3)}<section class="related-work"><h2>Related work</h2><p>Short.</p></section></article>', ["T", *ALL, "Related work", "Short."]),
        (f'<article><h1>T</h1>{paragraphs(3)}<section id="search-methods"><h2>S</h2><p>Short.</p></section></article>', ["T", *ALL, "S", "Short."]),
        (f"<article><header><h1>Title</h1><p>By someone</p></header>{paragraphs(3)}</article>", ["Title", *ALL]),
        (f"<header><h1>Site</h1></header><article>{paragraphs(3)}</article>", ALL),
        (f'<article><p class=a"b>Fine, first.</p>{paragraphs(3)}</article>', ["Fine, first.", *ALL]),
        (f"<article><p title='a > b'>Fine, first.</p>{paragraphs(3)}</article>", ["Fine, first.", *ALL]),
        (f"<body><div id=post><div><h1>Head</h1></div><div>{paragraphs(3)}</div><div><ul><li>one</li><li>two</li></ul></div></div><div>{LINKS}</div>", ["Head", *ALL, "one", "two"]),
        (f"<body><div id=wrap><div>{LINKS}</div><div id=c><h1>H</h1>{paragraphs(3)}</div></div>", ["H", *ALL]),
        (f"<body><div><h1>H</h1>{paragraphs(3)}</div><div class='comments'>{paragraphs(9)}</div>", ["H", *ALL]),
        (f"<body><div><h1>H</h1>{paragraphs(3)}</div><div class='article-comments'>{paragraphs(9)}</div>", ["H", *ALL]),
        (f"<body><div><h1>H</h1>{paragraphs(3)}<div class='adBanner'><p>Buy.</p></div></div>", ["H", *ALL]),
        (f"<article>{paragraphs(3)}<table><tr><td>a</td><td>b</td></tr></table><dl><dt>x</dt><dd>y</dd></dl></article>", [*ALL, "a", "b", "x", "y"]),
        (f"<article>{paragraphs(3)}<div><div><div><p>deep</p></div></div></div></article>", [*ALL, "deep"]),
        ("<a class='", []),
        ("", []),
    ],
)
def test_blocks(page, want):
    assert html_main.main_text(page).split("\n") == (want or [""])


def test_quotes_do_not_cost_quadratic_time():
    page = "<article>" + "<p class=a\"b title='c>One, two.</p>" * 3000
    assert len(html_main.main_text(page)) > 0
