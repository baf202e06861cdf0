"""Extraction against pages built from known texts; wrappers of small hosts by hand."""

import html
import random
import re

import pytest

from recsift.llm import html_wrappers as H


def plain(page):
    """Blocks of the article of the test tables' pages, by their known form."""
    body = re.sub(r"(?s)<!--.*?-->", "", page).split("<article>", 1)[1].split("</article>", 1)[0]
    parts = re.split(r"</?(?:p|h1|br|div)[^>]*>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_pages(spark, small_dir):
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in H.op9_page_text(spark, small_dir).collect()}
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]] == (plain(r["html"]), len(plain(r["html"])), r["url"])


SITE = """<html><head><title>T{n}</title><script>if (a < b) x = "<p>no</p>";</script></head><body class="home">
<div id="top-menu"><ul><li>Home</li><li>About</li></ul></div><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="story">{paragraphs}<h6>Tagline of the site</h6></div>
<div class="comments"><p>user {n}: a long comment that is not part of the text at all, number {n} of many</p></div></div>
<div class="sidebar">Offer {n}</div><footer>Imprint {n}</footer></body></html>"""


def site(rng, n):
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(8, 60))) for _ in range(rng.randrange(1, 7))]
    return texts, SITE.format(n=n, paragraphs="".join(f"<p>{t[:9]}<b>{t[9:15]}</b>{t[15:]} &amp;&nbsp;&#33;</p>" for t in texts))


def test_region_from_slots(spark):
    """No article element: the region is where the texts vary; constant texts of the template go."""
    rng = random.Random(1)
    pages = [site(rng, n) for n in range(30)]
    df = spark.createDataFrame([(n, f"https://Site.example:80/{n}", p, "x") for n, (_, p) in enumerate(pages)],
                               "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    assert got == {n: "\n".join(f"{t} & !" for t in texts) for n, (texts, _) in enumerate(pages)}
    w = [r["wrapper"] for r in H.wrappers(df).collect()]
    assert len(w) == 1
    text = H.expression(H.json.loads(w[0]))
    assert "(<p>" in text and ")+" in text and "Tagline of the site" in text


def test_copies_are_no_evidence(spark):
    """Hosts of nothing but copies or near copies keep their text; copies do not change other pages' texts."""
    copy = "<html><body><div><h2>Title of all copies</h2></div><div><p>The one paragraph that all copies have.</p></div></body></html>"
    near = "<html><body><div><p>A paragraph that is the same in all pages of the host.</p></div><div>Seen {n} times</div><script>{n}</script></body></html>"
    mixed = [site(random.Random(n), n)[1] for n in range(12)]
    special = SITE.format(n=99, paragraphs="<h4>Heading of the copies only</h4><p>some words that stand in the copies and on no other page</p>")
    rows = [(n, "https://copies.example/", copy) for n in range(6)]
    rows += [(10 + n, "https://near.example/", near.format(n=n)) for n in range(6)]
    rows += [(20 + n, "https://mixed.example/", p) for n, p in enumerate(mixed)] + [(50 + n, "https://mixed.example/", special) for n in range(9)]

    def texts(some):
        df = spark.createDataFrame(some, "page_id long, url string, html string").repartition(4)
        return {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}

    got = texts(rows)
    assert {got[n] for n in range(6)} == {"Title of all copies\nThe one paragraph that all copies have."}
    assert [got[10 + n] for n in range(6)] == [f"A paragraph that is the same in all pages of the host.\nSeen {n} times" for n in range(6)]
    assert {got[50 + n] for n in range(9)} == {"Heading of the copies only\nsome words that stand in the copies and on no other page"}
    once = texts([x for x in rows if x[0] <= 50])
    assert all(got[n] == t for n, t in once.items())


def test_alignment():
    a, b, c = (H.fold(H.parse(x)) for x in (
        "<div><h1>A</h1><p>x</p><p>y</p><i>k</i></div>", "<div><h1>B</h1><p>z</p></div>", "<div><h1>B</h1><ul><li>1</li><li>2</li></ul></div>"))
    w = H.align(H.align(a, b), c)
    assert H.expression(w) == "<><div><h1>#text</h1>(<p>#text</p>)+(<i>k</i>)?(<ul>(<li>#text</li>)+</ul>)?</div></>"
    # the order of the pages does not matter for what is a slot, optional or repeated
    assert sorted(H.expression(H.align(H.align(c, b), a))) == sorted(H.expression(w))


def test_edge_rows(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    pages = [(1, None, None), (2, "https://a.example/x", ""), (3, "not a url", "plain text only"),
             (4, "https://b.example/1", "<article><h1>T</h1><p>one <b>two</b>three<br>four<p>five &lt;5&gt;</article><footer>f</footer>"),
             (4, "https://b.example/1", "<article><h1>T</h1><p>one <b>two</b>three<br>four<p>five &lt;5&gt;</article><footer>f</footer>"),
             (5, "https://c.example/", deep), (6, "https://d.example/", "<p>" + "long " * 100_000 + "</p>"),
             (7, "https://e.example/", '<article><p title="a > b">q</p><p class=x>r<!-- no --></p><script>s</script'),
             (None, "https://b.example/2", "<div><p>other form</p></div>")]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, n_chars int")
    rows = H.extract_pages(df).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == got[2] == "" and got[3] == "plain text only" and got[5] == "deep text"
    assert got[4] == "T\none twothree\nfour\nfive <5>" and got[6] == ("long " * 100_000).strip()
    assert got[7] == "q\nr" and got[None] == "other form"
    assert H.extract_pages(df.limit(0)).count() == 0
    # tasks without pages
    assert H.extract_pages(df.repartition(20, "page_id")).count() == len(pages)


def test_shuffled_wrappers_give_the_same(spark, small_dir, monkeypatch):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    first = {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()}
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    again = {r["page_id"]: r["text"] for r in H.extract_pages(pages.repartition(7)).collect()}
    assert first == again


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div>x</b>", "<a \">\" ", "<a href='x ", "<script ", "<script>", "<!-- ", "<p><b>", "<b><ul></ul>",
                                  "</div", "<!", "<li><i>", "<x1><y1></x1>", "< ", "<a class='menu", "class=\"<p class=\"", "<h1>t</h1><p>x</p><ul></ul><ol></ol><hr>"])
def test_a_page_of_one_megabyte_takes_time_in_proportion(unit):
    import time
    page = "<article><p>start</p></article>" + unit * (1_000_000 // len(unit))
    began = time.process_time()
    text = H.extract(page, None)
    assert time.process_time() - began < 20
    assert text.split("\n")[0].startswith("start")


def test_many_kinds_of_elements():
    import time
    page = "".join(f"<x{i}>t{i}</x{i}>" for i in range(20_000))
    began = time.process_time()
    a, b = H.fold(H.parse(page)), H.fold(H.parse(page + "<p>more</p>"))
    H.align(a, b)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("page,text", [
    ("<p>a<p>b", "a\nb"), ("<p>a <b>b<div>c</div>", "a b\nc"), ("<div>a</b>b</div>c", "ab\nc"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("a < b", "a < b"), ("a <b", "a <b"), ("x <!-- never ends", "x"), ("x<!-- y -->z", "xz"), ("<p>a</p><script>var x = '<p>';</script><p>b</p>", "a\nb"),
    ("<p title='a > b'>c</p>", "c"), ("<p title='a>b</p><p>c</p>", "b\nc"), ("<script>x", ""), ("<p>a</p><style>y", "a"), ("<br/>a<br>b", "a\nb"),
    ("<p>k &lt;b&gt; &amp; l</p>", "k <b> & l"), ("</>a", "a"), ("<p>a<script/>b</p>", "ab")])
def test_broken_markup(page, text):
    assert "\n".join(H.blocks(H.parse(page), frozenset())) == text
