import html
import re
import time

import pytest
from freightcube.llm import html_text, queries
from freightcube.llm.html_text import main_text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def plain(page):
    """Independent of the parser: the table's pages have one article of headings and paragraphs."""
    inner = re.search("<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split("</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op12_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"])
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])


LONG = "A sentence of the story that goes on for a while, with some words more. " * 3
BODY = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p>"
TEXT = "\n".join(["Title", LONG.strip(), "Short.", "one", "two", LONG.strip()])
AROUND = [
    "<nav><ul><li><a href=x>Home</a><li><a href=y>News of the day</a></ul></nav>",
    "<header><h1>The Site</h1><p>Its claim of some length that no reader wants to read again.</p></header>",
    f"<aside><p>{LONG}</p></aside>",
    f"<div class='sidebar left'><p>{LONG}</p></div>",
    f"<div id=cookieNotice class='x'><p>{LONG} <button>Accept</button></p></div>",
    f"<div class='ad'>{LONG}</div>",
    "<div class='ad-slot wide'><div><p>Buy this now</div></div>",
    f"<form action=/s><label>Mail</label><p>{LONG}</p><input name=q></form>",
    "<script>var t = '</p><p>not text';</script><style>p > b {x: 1}</style>",
    f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{LONG}</p></article></section>",
    f"<ol class=commentlist><li><p>{LONG}</ol>",
    f"<footer><p>&copy; 2024 {LONG}</p></footer>",
    "<!-- <p>a comment</p> --><![if IE]><![endif]><?php echo 1 ?>",
    f"<div role=navigation><p>{LONG}</p></div>",
    f"<div class=cookieconsent-bar><p>{LONG}</p></div><div id=mainMenu><p>{LONG}</p></div><p class=adBanner>{LONG}</p>",
]


@pytest.mark.parametrize("extra", [*AROUND, "".join(AROUND)])
@pytest.mark.parametrize("layout", ["{e}<article>{b}</article>{e}", "<main>{e}{b}{e}</main>", "<div><div>{e}</div><div class=body>{b}</div></div>{e}",
                                    "<form><div>{e}</div><article>{e}{b}{e}</article></form>"])
def test_boilerplate(extra, layout):
    if "<form>" in layout and "<form" in extra:
        pytest.skip("forms do not nest")
    if "<article>{e}" in layout:  # there, a header's headings are the article's
        extra = extra.replace("<h1>The Site</h1>", "")
    page = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body class='has-sidebar'>" + layout.format(e=extra, b=BODY) + "</body></html>"
    assert main_text(page)[0] == TEXT


def test_text_rules():
    assert main_text("<article><p>a&amp;b &lt;c&gt; &copy &#65;&#x42;&nbsp;&nbsp;d\n\t e<br>f<b>g</b>h</p>i  <span>j</span>k</article>")[0] == "a&b <c> © AB d e fgh\ni jk"
    assert main_text("<article><p>one<p>two<div>three</div>four<table><tr><td>5<td>6<tr><td>7</table></article>")[0] == "one\ntwo\nthree\nfour\n5\n6\n7"
    assert main_text("<article><header><h1>T</h1><p>By me</p></header><p>x</p><footer>tags</footer></article>")[0] == "T\nx"
    assert main_text("<article><p>x &am")[0] == "x &am"
    assert main_text("<article><p>1 < 2 and 3 > 2</p><p>y</p><p class='cut")[0] == "1 < 2 and 3 > 2\ny"
    assert main_text("<article><p>x</p><!-- never closed <p>y</p></article>")[0] == "x"
    assert main_text("<article><p>x</p><script>never closed <p>y</p></article>")[0] == "x"
    assert main_text("just text")[0] == "just text"
    for nothing in ("", "   ", "<p></p>", "<nav>menu</nav>", "<script>x</script>", "<", "<!", "</", "<![bad[", "<!-", "&"):
        assert main_text(nothing)[0] in ("", "<", "&")


def test_two_articles_and_none():
    teaser = "<article><h2>Other</h2><p>More</p></article>"
    assert main_text(f"{teaser}<article>{BODY}</article>{teaser}")[0] == TEXT
    links = "<div>" + "".join(f"<p><a href={i}>Link number {i} to another page of this site</a></p>" for i in range(9)) + "</div>"
    text, blocks, how = main_text(f"<body>{links}<div>{BODY}</div>{links}</body>")
    assert (text, blocks, how) == (TEXT, 6, "ratio")


def test_long_pages_take_linear_time():
    def seconds(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    for unit in ("<p>words and words</p>", "<div><b>", "<li><a>x", "</div><i>", "<td>", "&amp; ", "<div class=ad>x", "< <"):
        seconds(unit * 100)
        short, long = seconds(unit * 10_000), seconds(unit * 80_000)
        assert long < 24 * max(short, 0.01)
    text = main_text("<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>")[0]
    assert text == "\n".join([LONG.strip()] * 5_000)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", None), (None, None, "<p>x"), (2, None, ""), (3, "u", "<article>é 😀</article>"), (3, "u", "<article>é 😀</article>"), (4, "v", "<p>" + "w " * 500_000)]
    df = spark.createDataFrame(rows, schema)
    got = {(r["row"]["page_id"], r["text"], r["region"]) for r in html_text.extract_pages(df).collect()}
    assert got == {(1, "", "none"), (None, "x", "ratio"), (2, "", "none"), (3, "é 😀", "article"), (4, ("w " * 500_000).strip(), "ratio")}
    names = ["row", "text", "n_blocks", "region", "a b", "x.y"]
    wide = df.select("*", *[F.lit(c).alias(c) for c in names])
    out = html_text.extract_pages(wide).select("row.*").collect()
    assert len(out) == len(rows) and all(r[c] == c for r in out for c in names)
    assert html_text.extract_pages(spark.createDataFrame([], schema)).collect() == []
    assert html_text.extract_pages(df.select("html")).count() == len(rows)


def test_names():
    gone = lambda name: html_text.aside_by_name(name)[0]
    assert all(map(gone, ["ad", "top-ad", "navLinks", "site_nav", "topmenu", "comment-list", "user-comments", "Footer2", "cookie-notice", "sidebar-left", "x promo"]))
    assert not any(map(gone, ["article-body", "no-sidebar", "has-comments", "lead", "commentary", "address", "shade", "navy-text", "radio", "content", "", None]))
