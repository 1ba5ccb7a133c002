from __future__ import annotations

import pytest

from cohortwave.llm import main_text

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
AD = "<div class=\"ad banner\">Buy now, buy it all. Cheap, cheap!</div>"
FOOT = "<footer>&copy; site &middot; all rights</footer></body></html>"
LONG = "This is a sentence of the article, with commas, and it goes on. " * 3
CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    (HEAD + NAV + AD + f"<article><h1>Head&amp</h1><p><b>First  part<br>second\n part<p>{LONG}</p></article>" + FOOT, f"Head& First part second part {LONG.strip()}"),
    (HEAD + NAV + f"<div class=content><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>" + FOOT, f"Title {LONG.strip()} Short. {LONG.strip()}"),
    (HEAD + f"<article><p>{LONG}</p><form><p>Sign up: {LONG}</p></form></article><section id='comments'><p>{LONG}</p></section>" + FOOT, LONG.strip()),
    (HEAD + NAV + "<article><h1>Cut &am", "Cut &am"),
    ("<p>a<!-- <p>no</p> -->b</p><p>1 < 2 &lt;b&gt; &#233;&#x41;</p>", "ab 1 < 2 <b> éA"),
    ("<script>never closed <p>x</p>", ""),
    ("<div><p>it's <em>in</em>line <a href='x>y'>link</a></p></div>", "it's inline link"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_pages(page, want):
    assert main_text.main_text(page) == want


def test_short_paths_lose_to_long_ones():
    menu = "".join(f"<td><a href='/{i}'>m{i}</a></td>" for i in range(20))
    page = f"<table><tr>{menu}</tr></table><div><p>{LONG}</p><p>{LONG}</p><p>Yes.</p></div>"
    assert main_text.main_text(page) == f"{LONG.strip()} {LONG.strip()} Yes."


def neutral(paragraphs, menu=12):
    """No article, no telling class: a menu, a teaser, a text column with a subheading, a strip of captions, a last line."""
    links = "".join(f"<div class=k2><a href='/{i}'>item {i}</a></div>" for i in range(menu))
    column = "".join(f"<p>{p}</p>" for p in paragraphs[:2]) + "<h2>Half way</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs[2:])
    captions = "".join(f"<div class=k6>Picture {i}</div>" for i in range(6))
    return f"<body><div class=k1>{links}</div><div class=k3>See it all</div><div class=k4>{column}</div><div class=k5>{captions}</div><div class=k7>Made with care since 1990</div></body>"


def test_ratio_alone_decides():
    paragraphs = [f"{LONG}Part {i}." for i in range(5)]
    page = main_text.Page(neutral(paragraphs))
    assert {b.element.factor for b in page.blocks} == {main_text.NEUTRAL}
    assert main_text.main_text(neutral(paragraphs)) == " ".join([*paragraphs[:2], "Half way", *paragraphs[2:]])
    assert len(page.blocks) - int(main_text.chosen(page.blocks).sum()) >= 20


def test_ratio_also_decides_inside_an_article():
    teasers = "".join(f"<div class=k{i}>{i} more</div>" for i in range(8))
    assert main_text.main_text(f"<article><p>{LONG}</p><p>{LONG}</p><section>{teasers}</section></article>") == f"{LONG.strip()} {LONG.strip()}"


def test_ratio_removes_blocks_of_the_given_pages():
    import pyarrow.parquet as pq

    removed = 0
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        blocks = main_text.Page(page).blocks
        removed += len(blocks) - int(main_text.chosen(blocks).sum())
    assert removed > 100


def test_long_comments_lose_to_a_short_article():
    comments = "".join(f"<p>{LONG * 4}</p>" for _ in range(3))
    assert main_text.main_text(f"<body><div class=x1><p>Short article, of one sentence.</p></div><div class=comments>{comments}</div></body>") == "Short article, of one sentence."


def test_deeply_nested_pages_in_linear_time():
    import time

    n = 100_000
    began = time.process_time()
    assert main_text.main_text("<div>" * n + LONG + "</div>" * n) == LONG.strip()
    assert main_text.main_text("<p><li>" + "<h2>x</q></ul>" * n) == " ".join("x" * n)
    assert time.process_time() - began < 30


def test_operator(spark):
    rows = [(i, f"u{i}", page, "x") for i, (page, _) in enumerate(CASES)] + [(100, None, None, "x"), (101, "u", "<p>" * 20_000 + "deep", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text.extract(df).collect()}
    assert all(got[i].text == want and got[i].n_chars == len(want) and got[i].url == f"u{i}" for i, (_, want) in enumerate(CASES))
    assert got[100].text == "" and got[100].url is None and got[101].text == "deep"
    assert main_text.extract(df.limit(0)).count() == 0


def test_query_against_article_tags(spark):
    import html
    import re

    import pyarrow.parquet as pq

    pages = {r["page_id"]: r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()}
    for r in main_text.query(spark, "/root/testdata/sf0.001").collect():
        inner = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        parts = (re.sub(r"\s+", " ", html.unescape(x.replace("<b>", "").replace("</b>", ""))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert r.text == " ".join(p for p in parts if p)
