"""Main text of pages, on layouts of several kinds and on broken ones."""

import html
import random
import re

import pytest

from panelloom.llm import pages
from panelloom.llm.queries import QUERIES

WORDS = "stone river market council winter bridge harvest letter signal garden copper valley".split()


def prose(seed, n, least=12, most=60):
    dice = random.Random(seed)
    return [" ".join(dice.choices(WORDS, k=dice.randint(least, most))).capitalize() + "." for _ in range(n)]


BODY = prose(1, 9)
BODY[4] = "So."
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS)
LONG = " ".join(prose(2, 2))
PLAIN_DIVS = f'<html><body><div id="x1"><ul>{LINKS}</ul></div><div id="x2"><h1>A title of the page</h1>{PARAGRAPHS}</div><div id="x3"><a href="/a">terms</a> <a href="/b">contact</a></div></body></html>'
LAYOUTS = {
    "article": (f"<body><nav><ul>{LINKS}</ul></nav><article><h1>A title of the page</h1>{PARAGRAPHS}</article><footer>{LONG}</footer></body>", True),
    "main, header and sidebar": (f'<body><header><h2>Site</h2><p>{LONG}</p></header><main><h1>A title of the page</h1>{PARAGRAPHS}</main><aside><p>{LONG}</p></aside></body>', True),
    "names": (f'<body class="with-sidebar"><div id="site-header">{LONG}</div><div class="post"><h1>A title of the page</h1>{PARAGRAPHS}</div><div class="right-sidebar"><p>{LONG}</p></div><div class="cookieNotice"><p>{LONG}</p></div></body>', True),
    "opaque divs": (PLAIN_DIVS, True),
    "no containers": (f"<body><ul>{LINKS}</ul><h1>A title of the page</h1>{PARAGRAPHS}<ul>{LINKS}</ul></body>", True),
    "sections": (f"<body><ul>{LINKS}</ul><div id=c><div><h1>A title of the page</h1>{''.join(f'<p>{p}</p>' for p in BODY[:4])}</div><div>{''.join(f'<p>{p}</p>' for p in BODY[4:])}</div></div></body>", True),
    "inside an article": (f'<article><header><h1>A title of the page</h1><p>by someone</p></header><div class="ad">{LONG}</div>{PARAGRAPHS}<form>{LONG}<input></form><section id="comments"><p>{LONG}</p><p>{LONG}</p></section></article>', True),
    "comments as articles": (f'<article class="post comments-open"><h1>A title of the page</h1>{PARAGRAPHS}</article><section class="comments"><article><p>{LONG}</p><p>{LONG}</p></article></section>', True),
    "one form around all": (f'<body><form id="f"><div><ul>{LINKS}</ul></div><article><h1>A title of the page</h1>{PARAGRAPHS}</article></form></body>', True),
    "menu without end": (f"<body><nav><ul>{LINKS}<article><h1>A title of the page</h1>{PARAGRAPHS}</article>", True),
    "no end tags": (f"<body><nav><ul>{LINKS}</ul></nav><article><h1>A title of the page</h1>{''.join(f'<p><b>{p}<br>' for p in BODY)}", True),
    "script and style": (f"<article><style>p {{x}}</style><h1>A title of the page</h1><script>var a = '</p><p>no';</script>{PARAGRAPHS}<noscript>{LONG}</noscript><!-- {LONG} --></article>", True),
    "comment without end": (f"<article><h1>A title of the page</h1>{PARAGRAPHS}</article><!-- {LONG}", True),
    "marked section": (f"<article><h1>A title of the page</h1><![foo bar]>{PARAGRAPHS}</article>", True),
    "hidden": (f'<article><h1>A title of the page</h1>{PARAGRAPHS}<div hidden>{LONG}</div><p style="display: none">{LONG}</p><p aria-hidden="true">{LONG}</p></article>', True),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    source, titled = LAYOUTS[name]
    assert pages.main_text(source) == "\n".join((["A title of the page"] if titled else []) + BODY)


def test_references_white_space_and_inline_markup():
    source = "<article><p>a\n\t b&nbsp;&amp;&#x41;&eacute;&unknown; c<b>d</b>e<br>f</p><table><tr><td>g<td>h<tr><td>i</table><ul><li>j<li>k</ul><div>l<p>m</div>n &lt;p&gt;</article>"
    assert pages.main_text(source) == "a b &Aé&unknown; cde f\ng h\ni\nj\nk\nl\nm\nn <p>"


@pytest.mark.parametrize("source", [None, "", " \n", "<", "<p", "<!--", "</p></p>", "<![", "<!DOCTYPE html>", "<nav>x</nav><script>", "<p class='", "&#", "<head><title>t</title></head>"])
def test_nothing_to_find(source):
    assert len(pages.main_text(source)) <= 8


def test_deep_and_long_pages():
    assert pages.main_text("<div>" * 50_000 + "<p>deep text</p>") == "deep text"
    words = "word " * 500_000
    assert pages.main_text(f"<article><p>{words}</p></article>") == words.strip()


def test_rows_and_clashing_names(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>"), (None, None, None), (2, "v", ""), (3, "w", "plain words")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = table.selectExpr("*", "'mine' AS text", "'mine too' AS n_chars", "1 AS kind")
    want = sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (-1, None, "", 0), (2, "v", "", 0), (3, "w", "plain words", 11)], key=str)
    for t in (table, clash):
        got = pages.report(t)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        assert sorted([(-1 if r.page_id is None else r.page_id, r.url, r.text, r.n_chars) for r in got.collect()], key=str) == want
    assert pages.extract(clash).columns == ["page_id", "url", "text", "n_chars", "kind", "text_", "n_chars_"]
    assert pages.report(table.limit(0)).collect() == []


def test_query_takes_every_article_of_the_table(spark, sf_dir):
    """The given pages mark their articles, so that plain patterns can say what is due."""
    given = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(given)
    for row in got:
        article = re.search("<article>(.*?)</article>", given[row.page_id], re.DOTALL).group(1)
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?h1>|</?p>", article)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)
