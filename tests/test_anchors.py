"""Links between chapters, and addresses against urljoin."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from quillspark.functions.urls import resolve
from quillspark.operators import anchors

PAGE = "https://h.org/a/b.html"


def chapters(spark, *parts, url=PAGE):
    return spark.createDataFrame([(1, i, url, html) for i, html in enumerate(parts)], "doc long, chapter int, page_url string, html string")


def kinds(frame):
    return [(r.chapter, r.href, r.kind, r.target) for r in anchors.anchor_links(frame).orderBy("chapter", "place").collect()]


def test_resolve(spark):
    hrefs = ["", "#x", "?q=1", "c.html", "./c", "../c", "../../../c", "/d/../e/./f", "//k.org/z", "https://o.org/y?z#w", "mailto:a@b", "c/../d/", "..", ".", "x?y=/../z#/../w", "/", "/a//b", "d/e/../..", "ä b"]
    bases = [PAGE, "http://h.org", "http://h.org/x?q=1", "https://h.org/a/b/c/?r#s"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = {(r.b, r.h): r.u for r in spark.createDataFrame(rows, "b string, h string").select("b", "h", resolve("b", "h").alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(*k)} == {}


def test_kinds_of_links(spark):
    frame = chapters(
        spark,
        '<p id="one">x <a href="#two">to two</a> <a href=\'b.html#one\'>here</a> <a href="#none">gone</a><a href="#">top</a></p><!-- <a id="late" href="#one">no</a> -->',
        '<h2 ID=two>y</h2><a name="note"></a><a class="k" href="https://h.org/a/b.html#note">note</a> <a href="c.html">away</a><a>bare</a><span name="not">z</span><a href="#not">n</a>',
        '<i id="two">again</i><i id="&quot;q&quot;"></i><a href="#two">first owner</a><a href="#late">l</a><script>var a = "<a href=\'#one\'>"</script><a href="b.html">self</a>',
    )
    assert kinds(frame) == [
        (0, "#two", "moved", "chapter_0002.xhtml#two"), (0, "b.html#one", "kept", "#one"), (0, "#none", "broken", None), (0, "#", "broken", None),
        (1, "https://h.org/a/b.html#note", "kept", "#note"), (1, "c.html", "address", "https://h.org/a/c.html"), (1, "#not", "broken", None),
        (2, "#two", "moved", "chapter_0002.xhtml#two"), (2, "#late", "broken", None), (2, "b.html", "address", "https://h.org/a/b.html"),
    ]


def test_relinked_html(spark):
    frame = chapters(spark, '<p>a <A class="k" href="#two" target=_top>t<b>w</b>o</A> <a href="#none">gone <i>x</i></a> <a href="/r?a=1&amp;b=2">r</a></p>', '<p id="two">&lt;b&gt;</p>', None, "plain > text")
    got = {r.chapter: r.html for r in anchors.relinked(frame).collect()}
    assert got == {
        0: '<p>a <a href="chapter_0002.xhtml#two" class="k">t<b>w</b>o</A> <span>gone <i>x</i></span> <a href="https://h.org/r?a=1&amp;b=2" target="_blank">r</a></p>',
        1: '<p id="two">&lt;b&gt;</p>', 2: None, 3: "plain > text",
    }


def test_nothing_to_link(spark):
    empty = chapters(spark, "x").filter("chapter > 0")
    assert kinds(empty) == [] and anchors.relinked(empty).count() == 0
    assert kinds(chapters(spark, '<a href="#x">' * 3, "<p id='x'>", '<a id="" name="" href="">')) == [(0, "#x", "moved", "chapter_0002.xhtml#x")] * 3 + [(2, "", "address", PAGE)]


def test_attributes(spark):
    tags = ['<a href="a>b">', "<a title='href=\"no\"' href=yes>", "<a data-id=1 id = 'x y'>", "<a href>", '<p id="&amp;lt;">']
    rows = [(r[0], r[1]) for r in spark.createDataFrame([(t,) for t in tags], "t string").select(anchors.attribute(F.col("t"), "href"), anchors.attribute(F.col("t"), "id")).collect()]
    assert rows == [("a>b", None), ("yes", None), (None, "x y"), (None, None), (None, "&lt;")]
