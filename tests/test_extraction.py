import random
from html import unescape

import pytest
from plans import plan_text
from pyspark.sql import Observation
from pyspark.sql import functions as F

from etalase.functions.html import parse
from etalase.functions.tags import unescaped
from etalase.operators import extraction
from etalase.operators.extraction import Field
from etalase.schemas import RAW


@pytest.mark.parametrize(
    ("html", "tag", "text"),
    [
        ("<p> a <b> b </b> c</p>", "p", "abc"),
        ("<p>a<p>b", "p", "a"),
        ("<p>a<div>b</div>", "p", "a"),
        ("<div>a<div>b</div>c</div>d", "div", "abc"),
        ("<div>x &amp; y &lt;z&gt; &eacute;&#39;</div>", "div", "x & y <z> é'"),
        ("<div>a<!-- <b>no</b> -->b</div>", "div", "ab"),
        ("<div>a<script>'<div>'</script>b<style>c</style></div>", "div", "ab"),
        ("<title>a <b> c</title>", "title", "a <b> c"),
        ("<DIV>a</DIV>", "div", "a"),
        ("<div title='a>b'>c</div>", "div", "c"),
        ("<div>a </b> c</div>", "div", "a  c"),
        ("<div>1 < 2</div>", "div", "1 < 2"),
        ("<div>a<br/>b<img src=x>c</div>", "div", "abc"),
        ("<div>a<template>b<i>c</i></template>d</div>", "div", "ad"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "li", "ab"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "tr", "ab"),
        ("<div>a", "div", "a"),
        ("<div>a<!-- open", "div", "a"),
        ('<div class="x" title="open>a</div>', "div", "a"),
    ],
)
def test_text_of_first_tag(html, tag, text):
    assert parse(html).first(tag).text() == text


def test_class_and_attribute_matching():
    page = parse('<i class="a  b" id=k></i><i class="a"></i><i data-x="1&amp;2"></i><i ID="K2"/>')
    assert [n.start for n in page.all("i", cls="a")] == [1, 2]
    assert [n.start for n in page.all("i", cls="a b")] == [1]
    assert [n.start for n in page.all("i", cls="b a")] == []
    assert [n.start for n in page.all("i", id=True)] == [1, 4]
    assert page.first("i", id="K2").start == 4
    assert page.first("i", **{"data-x": True}).attrs["data-x"] == "1&2"


def pages(spark, *htmls):
    rows = [(i, f"https://h/{i}", html) for i, html in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_links(spark):
    html = (
        "<a href='/product/1'>x</a><A class=\"b>c\" HREF=\"/product/2?a=1&amp;b=2\">y</A>"
        "<a\nhref=/product/3>z</a><a href='/about'>n</a><a data-href='/product/no'>n</a>"
        "<!-- <a href='/product/no'> --><script>'<a href=\"/product/no\">'</script>"
        "<a name=k>no</a><a href='/product/1'>again</a><abbr href='/product/no'></abbr>"
        "<a href='https://o.example/product/9'>far</a>"
    )
    got = extraction.page_links(pages(spark, html, None, "")).orderBy("place")
    rows = got.withColumn("full", extraction.absolute(F.col("href"), F.lit("https://h"))).collect()
    assert [r.href for r in rows] == [
        "/product/1",
        "/product/2?a=1&b=2",
        "/product/3",
        "/product/1",
        "https://o.example/product/9",
    ]
    assert rows[1].full == "https://h/product/2?a=1&b=2"
    assert rows[4].full == rows[4].href


def test_links_of_a_large_page(spark):
    html = "<div " + "x='1' " * 20000 + ">" + "<a " + "y='2' " * 5000 + "href='/product/1'>" * 3
    assert extraction.page_links(pages(spark, html)).count() == 1
    # Tags that never end, quotes that never end, and a tag of two million characters.
    open_tags, open_quote = "<a " * 30_000, "<a href='/product/" * 3_000
    long_tag = "<a " + "x='1' " * 400_000 + "href='/product/2'>"
    assert extraction.page_links(pages(spark, open_tags, open_quote, long_tag)).count() == 1


def plain_links(html):
    """The page reader's answer."""
    return [a.attrs["href"] for a in parse(html).all("a", href=True)]


@pytest.mark.parametrize("seed", range(3))
def test_links_of_broken_pages(spark, seed):
    draw = random.Random(seed)
    bits = (
        "<a href=/product/1>|<a href='/product/2|'>|\"|<A HREF=\"/product/3?x=1&amp;y=2\" class='b>c'>|<a/href=/product/4>|<a>"
        "|<a name=x href>|<a href = /product/5 href=/product/6>|<!--|-->|<script>|</script >|</SCRIPT>|<title>|</title>|<style a='>'>"
        "|</style>|<textarea>|</textarea>|<b|>|<|</a>|<?x>|<!x>|<abbr href=/product/7>|<a\u2003href=/product/8>|text | \n|<a href='&lt;/product/&eacute;&notit;&#x41;'>"
    ).split("|")
    htmls = ["".join(draw.choices(bits, k=draw.randint(1, 14))) for _ in range(400)]
    got = {}
    for r in extraction.page_links(pages(spark, *htmls), "").collect():
        got.setdefault(int(r.page_url.rsplit("/", 1)[1]), []).append((r.place, r.href))
    for i, html in enumerate(htmls):
        assert sorted(got.get(i, [])) == list(enumerate(plain_links(html))), html


def test_character_references(spark):
    draw = random.Random(9)
    bits = ["&", "&amp", "&amp;", "&lt", "&#", "&#x", "&#65;", "&#65", "&#x1F600;", "&#0;", "&#128;", "&#xD800;", "&#x110000;", "&#xFFFE;"]
    bits += ["&#99999999999999999999;", "&notit;", "&notin;", "&CounterClockwiseContourIntegral;", "&eacute", "&nope;", ";", "x", "é", " ", "#", "&#1;"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 6))) for _ in range(500)] + ["", "plain", "&" * 50]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in rows.select("t", unescaped(F.col("t")).alias("got")).collect():
        assert r.got == (None if r.t is None else unescape(r.t)), r.t


def tag(name, depth=0, content=""):
    element, wanted = extraction.PRODUCT_FIELDS[name].path[depth]
    marks = f'class="{wanted["cls"]}"' if "cls" in wanted else f'id="{wanted["id"]}"'
    return f"<{element} {marks}>{content}</{element}>"


def row(label, *values):
    cells = "".join(f'<div class="font-[500]">{v}</div>' for v in values)
    return f'<tr><td><div class="text-[#8C9197]">{label}</div></td><td>{cells}</td></tr>'


def test_missing_tags_are_null_and_faults_stay_with_their_page(spark):
    df = extraction.product_rows(
        pages(
            spark,
            tag("Product_Name", content=" Tas &amp; Co "),
            tag("Penjual", content="<a>no span</a>"),
            tag("Image_Srcset", content="<img src=x>"),
            tag("Stok", content=tag("Stok", 1, "only one")),
            None,
            "",
        )
    )
    progress = Observation("progress")
    rows = {r.URL[-1]: r for r in extraction.counted(df, progress).collect()}
    assert rows["0"].Product_Name == "Tas & Co" and rows["0"].error is None
    assert rows["0"].Penjual is None and rows["0"].Stok is None
    assert [rows[i].error for i in "1234"] == [
        "LookupError: no span below a",
        "LookupError: no img below div",
        "LookupError: no span below div",
        "no page",
    ]
    assert rows["5"].error is None and rows["5"].Product_Name is None
    assert progress.get == {"stored": 2, "faulty": 4}
    good = extraction.good_rows(df)
    assert good.columns == [f.name for f in RAW.fields]
    assert {f.name: f.dataType for f in good.schema} == {f.name: f.dataType for f in RAW.fields}
    assert good.count() == 2 and extraction.faulty_rows(df).count() == 4


def test_labelled_rows(spark):
    html = "<table>" + "".join(
        [
            row("Kategori", "old"),
            row("Kategori", "new"),
            row("Kategori"),
            row("Dimensi Ukuran", "10 cm", "20 cm", "30 cm"),
            row("Dimensi Ukuran", "one value only"),
            row("Unknown", "x"),
            "<tr><td>no label</td></tr>",
            row("Brand ", " B "),
        ]
    )
    got = extraction.product_rows(pages(spark, html)).collect()[0]
    assert (got.Kategori, got.Brand, got.Dimensi_Ukuran) == ("new", "B", "10 cm 20 cm")
    assert got.Min_Pembelian is None and got.error is None


def test_page_is_parsed_once_even_if_filtered(spark):
    rows = extraction.good_rows(extraction.product_rows(pages(spark, "<p>")))
    assert plan_text(rows).count("ArrowEvalPython (") == 1
    links = plan_text(extraction.page_links(pages(spark, "<p>").where("page_id >= 0")))
    assert "EvalPython" not in links and "ArrowPython" not in links


def test_own_fields(spark):
    fields = {
        "second": Field([("ul", {}), ("li", {})], nth=1),
        "to": Field([("a", {"rel": "next"})], take="href"),
    }
    got = extraction.page_fields(
        pages(spark, "<ul><li>a<li>b</ul><a rel=next href='?p=2'>", "<p>"), fields
    )
    assert got.columns == ["page_id", "url", "second", "to", "error"]
    assert [(r.second, r.to) for r in got.orderBy("page_id").collect()] == [("b", "?p=2"), (None, None)]


def test_frontier(spark):
    df = extraction.listing_frontier(spark.createDataFrame([("kantor",)], "category string"), "https://h")
    assert df.count() == 200
    assert df.where("page = 200").collect()[0].url == "https://h/c/kantor?page=200"
