"""Main text of pages: rules on small pages, templates against plain counting, odd rows."""

from collections import defaultdict

import pytest

from tidemark.llm import extract

SCHEMA = "page_id long, url string, html string, row string, host int, text string"


def plain(html):
    return " ".join(extract.Page(html).main_blocks()[0])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a <b>b</b>c<br>d</p><p>e&amp;f &#233;&nbsp;g &lt;i&gt;</p>", "a bc d e&f é g <i>"),
        ("<nav>menu</nav><article><h1>T</h1><p>one\n two</article><footer>f</footer>", "T one two"),
        ("<article><p><b>a.<br><p>b</p></article><div>later</div>", "a. b"),
        ("<script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>open", "yes"),
        ("<header><h1>Site</h1></header><main><h1>T</h1><p>x</p><aside>s</aside></main>", "T x"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>tags</footer><div class='share-bar'>Tweet</div></article>", "T x"),
        ("<article><p>x</p><section id='comments'><article class='comment'><p>first!</p></article></section></article>", "x"),
        ("<div class='cookieBanner'>We use cookies</div><div class=content><p>x</p></div><div id=left-sidebar>s</div>", "x"),
        ("<body class='has-sidebar no-ads'><div class='post-header'><h1>T</h1></div><p>x</p><form><p>Name <input></p></form>", "T x"),
        ("<form id=aspnetForm><article><p>x</p></article><button>Go</button></form>", "x"),
        ("<nav><a>m</a><article><p>x</p></article>", "x"),
        ("<article><h2 id='search-methods'>S</h2><section id='related-work'><p>y</p></section><p class=ad>buy</p><span class='advert'>buy</span>z</article>", "S y z"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl>", "a b c d e f g"),
        ("<article>1<div>2</article>3</div>", "1 2"),
        ("<p title='a>b'>x</p><p hidden>no</p><div style='display: none'>no</div><noscript>no</noscript><textarea>no</textarea>", "x"),
        ("<p>a<p>b<", "a b<"),
        ("<a href=x>l", "l"),
        ("a<!-- open comment <p>b", "a"),
        ("<article>a</article><p>between</p><article>b</article>", "a b"),
    ],
)
def test_rules(html, text):
    assert plain(html) == text


def test_deep_and_long_pages():
    assert plain("<div>" * 20_000 + "x") == "x"
    assert plain("<div>x" * 30_000).count("x") == 30_000
    assert plain("</div><p>" * 30_000 + "x") == "x"
    assert plain("<p>word </p>" * 30_000).count("word") == 30_000
    assert plain("<" * 50_000) == "<" * 50_000
    assert plain('<a href="' * 3_000 + "x").count("x") <= 1


def site(host, n, article):
    """Pages without any hint in their markup: an own text amid parts that all pages share."""
    return [(i, f"https://{host}/p{i}", f"<div><ul><li>Home<li>News</ul></div><div><p>{article(i)}</p><p>Second {i}.</p></div><div><p>All rights, {host}</p></div>", "r", 1, "t") for i in range(n)]


ROWS = (
    site("big.example", 40, lambda i: f"Own text of page {i}, longer than all the parts around it taken together.")
    + site("small.example", 4, lambda i: f"Text {i}")
    + [(100 + i, f"http://BIG.example:80/c{i}", f"<div><ul><li>Home<li>News</ul></div><div>Copy {i % 2}, and that is all there is to be told here today</div><p>Quoted by ten</p>", "r", 1, "t") for i in range(10)]
    + [(200 + i, f"http://marked.example/{i}", f"<article><p>Quoted by all</p><div>Sign up now</div><p>{i}</p></article>", "r", 1, "t") for i in range(20)]
    + [(None, None, None, None, None, None), (300, "", "", None, 1, None), (301, "no url", "<p>x</p>", None, 1, None), (302, "http://one.example", "<p>same</p>", None, 1, None), (302, "http://one.example", "<p>same</p>", None, 1, None)]
)


def brute(rows):
    pages = [(i, url, html or "", *extract.Page(html or "").main_blocks()) for i, url, html, *_ in rows]
    host = lambda url: (url or "").partition("://")[2].partition("/")[0].partition(":")[0].lower()
    seen, all_pages = defaultdict(set), defaultdict(set)
    for _, url, html, _, subtrees in pages:
        all_pages[host(url)].add(html)
        for h, _, _ in subtrees:
            seen[host(url), h].add(html)
    gone = {k for k, v in seen.items() if len(v) >= extract.MIN_PAGES and len(v) >= extract.MIN_SHARE * len(all_pages[k[0]])}
    out = [(i, url, " ".join(t for k, t in enumerate(blocks) if not any((host(url), h) in gone and a <= k <= b for h, a, b in subtrees))) for i, url, _, blocks, subtrees in pages]
    return sorted([(*x, len(x[2])) for x in out], key=repr)


@pytest.mark.parametrize("heavy", [1 << 16, 2])
def test_templates_equal_plain_counting(spark, monkeypatch, heavy):
    """Also with nearly all hosts and subtrees going by the shuffled joins."""
    monkeypatch.setattr(extract, "HEAVY", heavy)
    got = sorted(map(tuple, extract.main_text(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()), key=repr)
    assert got == brute(ROWS)
    text = {r[0]: r[2] for r in got}
    assert text[7] == "Own text of page 7, longer than all the parts around it taken together. Second 7."
    assert text[203] == "Quoted by all 3"
    assert text[1] != "" and text[300] == "" and text[302] == "same"
    assert [r[2] for r in got if r[1] == "https://small.example/p1"] == ["Home News Text 1 Second 1. All rights, small.example"]


def test_empty_table(spark):
    assert extract.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
