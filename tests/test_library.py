"""The library's queries against their SQL, and its functions against tables of facts."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark import queries
from quillspark.functions import chapters, files, html, layout, lines, sanitize, text, urls
from quillspark.functions.udf import dealt, spread
from quillspark.operators import catalog, lifecycle, links, runs, upkeep
from quillspark.operators import records as desk
from quillspark.plans import convert, planner
from quillspark.sources import catalogs, feeds
from quillspark.sources import books as containers
from quillspark.sources import files as file_sources
from quillspark.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def L(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("ua,client", [("KOReader/2024.1", "KOReader"), ("CrossPoint x", "CrossPoint"), (None, None), ("  ", None), ("odd thing", files.UNKNOWN_CLIENT)])
def test_client(spark, ua, client):
    got = one(spark, files.client(L(ua)).alias("c"))[0]
    assert got.client == client and (got.client_key is None) == (client is None)
    assert client is None or len(got.client_key) == 12


@pytest.mark.parametrize("header,flags", [("bytes=100-", (True, True, True)), ("bytes=0-99", (True, False, False)), (None, (False, False, True)), ("bytes=0-1,5-6", (True, False, False)), ("bytes", (True, False, False))])
def test_range(spark, header, flags):
    assert tuple(one(spark, files.range_flags(L(header)).alias("r"))[0]) == flags


@pytest.mark.parametrize("url,normal", [("https://www.h/x/", "h/x"), ("https://h/x", "h/x"), ("HTTP://WWW.H:8080/A/?q=1#f", "h:8080/A"), ("not a url", ""), (None, "")])
def test_normal_form(spark, url, normal):
    assert one(spark, urls.normal_form(L(url)).alias("u"))[0] == normal


def test_names_and_text(spark):
    slug = one(spark, text.slugify(L("Mangá — Ação!")).alias("a"), text.slugify_path(L("rss/Meu Feed")).alias("b"), text.slugify(L("")).alias("c"), urls.file_name(L("https://h/a%20b+c.epub?x=1")).alias("d"), text.human_size(F.lit(1536)).alias("e"))
    assert slug == ("manga-acao", "rss/meu-feed", "item", "a b+c.epub", "1.5 KB")
    tags = one(spark, text.clean_tags(F.array(L(" a "), L("A"), L(""), L("b"))).alias("a"), text.merge_tags(F.array(L("X")), F.array(L("x"), L(" y "))).alias("b"))
    assert tags == (["a", "b"], ["X", "y"])
    names = spark.createDataFrame([("page10",), ("page2",), ("Page1",)], "n string")
    assert [r.n for r in names.orderBy(files.natural_key("n")).collect()] == ["Page1", "page2", "page10"]
    assert one(spark, text.join_lines(F.array(L("an ex-"), L("ample of"), L("self-"), L("Made")))) == ("an example of self- Made",)
    assert one(spark, text.strip_title(L("Chapter One: it began"), L("chapter one")).alias("x")) == ("it began",)


def test_page_reader():
    page = """<html lang="pt-BR"><head><title> Pagina </title><meta name="author" content="Fulano"><meta name="keywords" content="um, dois,"></head>
    <body><header>site</header><script>x()</script><main><article class="c"><p>Ola <a href="/rel">link</a><img data-src="i.png" src=" "></p><p hidden>no</p><div></div></article></main><footer>f</footer></body></html>"""
    got = html.read_page(page, "https://h.org/p/")
    assert (got["title"], got["author"], got["language"], got["tags"]) == ("Pagina", "Fulano", "pt", ["um", "dois"])
    (chapter,) = got["chapters"]
    assert "site" not in chapter["body"] and "x()" not in chapter["body"] and "class=" not in chapter["body"] and "no</p>" not in chapter["body"]
    assert 'href="https://h.org/rel"' in chapter["body"] and got["images"] == ["https://h.org/p/i.png"]
    assert html.read_page("", "https://h.org/")["title"] == "h.org"


def test_consolidation():
    short = chapters.merged([("a", "x" * 100), ("b", "y" * 100)])
    assert len(short) == 1 and "<h2>b</h2>" in short[0][1]
    two = chapters.merged([("a", "x" * 8000), ("b", "tiny"), ("c", "z" * 30000)])
    assert [t for t, _ in two] == ["a", "c"] and "tiny" in two[0][1]
    assert 2 <= len(chapters.merged([("a", "x" * 6000)] + [(str(i), "y" * 3000) for i in range(18)])) <= 8


def test_text_chapters(spark):
    frame = spark.createDataFrame([(1, "intro\nChapter 1\nbody one\nCAPS TITLE\nbody two\n\n"), (2, ""), (3, None)], "id int, t string")
    got = [(r.id, r.title, r.body) for r in chapters.split_text(frame, "id", "t").orderBy("id", "chapter").collect()]
    assert got == [(1, "Início", "intro"), (1, "Chapter 1", "body one"), (1, "CAPS TITLE", "body two")]


def test_pdf_lines(spark):
    rows = [(1, p, 0.0, y, w, y + 10, 10.0, "f", t) for p in (1, 2, 3) for y, w, t in ((0.0, 50.0, f"Header {p}"), (40.0, 100.0, f"alpha {chr(96 + p)}"), (52.0, 100.0, f"beta {chr(96 + p)}"), (90.0, 100.0, f"gamma {chr(96 + p)}"))]
    frame = spark.createDataFrame(rows, "doc int, page int, x0 double, y0 double, x1 double, y1 double, size double, font string, text string")
    lines = frame.withColumn("edge", F.col("y0") < 10)
    assert {r.text for r in chapters.running_headers(lines).filter("header").collect()} == {"Header 1", "Header 2", "Header 3"}
    assert tuple(chapters.body_font(lines).first()) == (1, 10.0, "f")
    # the short header ends its paragraph; no step is wide against the page's median of 38
    assert len({(r.page, r.paragraph) for r in chapters.paragraph_numbers(lines).collect()}) == 6


FEED = """<rss xmlns:c="http://purl.org/rss/1.0/modules/content/"><channel>
<item><guid>g1</guid><title>One</title><link>/one</link><enclosure url="https://h/b.epub" type="application/epub+zip"/></item>
<item><guid>g2</guid><link>/two</link><description>short</description><c:encoded>a longer inline text</c:encoded></item>
<item><link>/three</link></item><item><guid>g4</guid><enclosure url="https://h/p.mp3" type="audio/mpeg"/></item>
<item><guid>g5</guid><link>/five</link><enclosure url="https://h/i.jpg" type="image/jpeg"/></item><item><description>only text</description></item><item/></channel></rss>"""


def test_feed(spark):
    payload = spark.createDataFrame([(1, "https://h/feed", FEED), (2, "https://h/x", "not xml"), (3, None, None)], "feed_id int, url string, xml string")
    got = feeds.feed_entries(payload).withColumn("kind", urls.kind("content_type", "extensions")).orderBy("position").collect()
    assert [r.guid for r in got][:5] == ["g1", "g2", "/three", "g4", "g5"] and got[5].guid.startswith("urn:sha1:") and len(got) == 6
    assert [r.kind for r in got] == ["ebook", "article", "article", "podcast", "article", "article"]
    assert got[0].url == "https://h/b.epub" and got[1].inline_html == "a longer inline text" and got[4].url == "https://h/five"


def test_obtain(spark):
    long, page, thin = "x" * 1200, "y" * 3800, "z" * 100
    cases = [(long, "ok", page, "inline"), (None, "ok", page, "page"), (long, "failed", None, "inline"), (long, "ok", thin, "inline"), (None, "failed", None, "error"), ("s", "failed", None, "inline_fallback"), ("s", "ok", thin, "inline_fallback"), (long, "ok", page + "<img src=a>", "page")]
    for inline, status, body, want in cases:
        assert one(spark, feeds.obtain(L(inline), L(status), L(body)).alias("s"))[0] == want


def test_cap_counts_new_items(spark):
    entries = spark.createDataFrame([(1, f"g{i}", i) for i in range(5)] + [(1, "g0", 9)], "feed_id int, guid string, position int")
    seen, totals = spark.createDataFrame([], "feed_id int, guid string"), []
    for _ in range(3):
        seen = seen.union(links.new_items(entries, seen, 2).select("feed_id", "guid"))
        totals.append(seen.count())
    assert totals == [2, 4, 5]


def test_sitemap(spark):
    urlset = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
    loc = "<url><loc>{}</loc></url>".format
    maps = [
        ("root", "<sitemapindex><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>b.xml</loc></sitemap><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>"),
        ("a.xml", urlset.format(loc("https://h/2026/09/28/post-novo") + loc("https://h/2026/01/02/b/") + loc("https://h/2025/12/31/c") + loc("https://h/2026/09/28/") + loc("https://h/tag/x") + loc("https://h/2026/09/28/7"))),
        ("b.xml", f"<urlset>{loc('https://h/2020/13/45/odd')}</urlset>"),
    ]
    reached = feeds.walk(spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame([("root",)], "url string"))
    assert reached.count() == 3
    got = {r.url: r for r in feeds.posts(feeds.sitemap_rows(reached)).collect()}
    assert len(got) == 4 and got["https://h/2026/09/28/post-novo"].title == "post novo" and got["https://h/2020/13/45/odd"].date is None
    dated = feeds.posts(feeds.sitemap_rows(reached))
    for days, n in ((0, 0), (7, 1), (365, 3), (-1, 4)):
        assert feeds.within_days(dated, days, "2026-09-29").count() == n
    assert one(spark, urls.sitemap_places(L("https://h/f")).alias("p"))[0][0] == "https://h/sitemap.xml"


def test_limit_comes_before_the_filter(spark):
    now = dt.datetime(2024, 1, 11)
    rec = spark.createDataFrame([(1, 1, "downloaded", 0, dt.datetime(2024, 1, 1)), (2, 2, "downloaded", 0, dt.datetime(2024, 1, 2)), (3, 3, "available", 0, dt.datetime(2024, 1, 1)), (4, 4, "blocked", 1, dt.datetime(2024, 1, 1))], "file_id int, book_id int, state string, active_downloads int, last_download_at timestamp").withColumn("updated_at", F.col("last_download_at")).withColumn("created_at", F.col("last_download_at"))
    books = spark.createDataFrame([(1, True, 5), (2, False, 6)], "id int, is_original boolean, file_size int")
    assert lifecycle.cleanup_candidates(rec, books, now, 1, 1).count() == 0
    assert [r.file_id for r in lifecycle.cleanup_candidates(rec, books, now, 1, 2).collect()] == [2]


def test_throttle_key(spark):
    assert one(spark, lifecycle.throttle_key(L(" Ana "), L("")).alias("k")) == ("ana@?",)


def test_records_and_state(spark):
    old = spark.createDataFrame([(1, "a.epub", "epub", "h", 5, "blocked")], "file_id int, file_name string, file_ext string, file_hash string, size_bytes int, state string")
    new = spark.createDataFrame([(1, "b.epub", "epub", "", 0), (2, "c.pdf", "pdf", "k", 7)], "file_id int, file_name string, file_ext string, file_hash string, size_bytes int")
    got = [tuple(r) for r in lifecycle.ensure_records(old, new).orderBy("file_id").collect()]
    assert got == [(1, "b.epub", "epub", "h", 5, "blocked"), (2, "c.pdf", "pdf", "k", 7, "available")]
    assert one(spark, lifecycle.unblock(L("blocked"), F.lit(0)).alias("a"), lifecycle.unblock(L("blocked"), F.lit(2)).alias("b"), lifecycle.unblock(L("deleted"), F.lit(2)).alias("c")) == ("available", "downloaded", "deleted")
    assert tuple(one(spark, lifecycle.completion(L("finished"), F.lit(0), F.lit(9)).alias("c"))[0]) == ("completed", 9)


def test_stream_equals_batch(spark, tmp_path):
    ev = queries.events(spark, SF)
    for k in range(3):
        ev.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.lifecycle(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out: list = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.file_id: tuple(r) for r in out}
    want = {r.file_id: (r.file_id, r.download_count, r.first_download_at, r.last_download_at, r.active_downloads, r.state) for r in lifecycle.fold_events(ev).collect()}
    assert last == want


def test_ingest_twice_adds_nothing(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2)], "feed_id long, guid string, position int")
    path = f"file://{tmp_path}/items"
    assert sorted(r.guid for r in ingest.ingest(entries, path).collect()) == ["a", "b"]
    assert ingest.ingest(entries, path).count() == 0 and spark.read.parquet(path).count() == 2


def test_ingest_batch_comes_again(spark, tmp_path):
    path, got, broken = f"file://{tmp_path}/items", [], [True]

    def sink(df):
        rows = sorted((r.feed_id, r.guid) for r in df.collect())
        if rows and broken and broken.pop():
            raise RuntimeError("sink is down")
        got.append(rows)

    run = ingest.on_each_batch(path, sink)
    first = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "feed_id long, guid string, position int")
    second = spark.createDataFrame([(1, "b", 0), (2, "b", 1)], "feed_id long, guid string, position int")
    with pytest.raises(RuntimeError):
        run(first, 0)
    run(first, 0)
    run(second, 1)
    run(second, 1)
    assert got == [[(1, "a"), (1, "b")], [(2, "b")], [(2, "b")]]


def test_stream_dedup_and_hours(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, "a")]
    for k in range(2):
        spark.createDataFrame(rows, "feed_id long, guid string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    out: list = []
    q = ingest.unseen(spark.readStream.schema("feed_id long, guid string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(out) == [(1, "a"), (2, "a")]
    ev = queries.events(spark, SF)
    ev.coalesce(1).write.parquet(str(tmp_path / "h"))
    hours: list = []
    q = ingest.downloads_per_hour(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "h"))).writeStream.outputMode("update").foreachBatch(lambda df, _: hours.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.downloads for r in hours) == ev.filter("status = 'completed'").count()


def test_unique_names_pass_taken_ones(spark):
    rows = spark.createDataFrame([(1, "x.epub"), (2, "x.epub"), (3, "x (2).epub"), (4, "x.epub"), (5, "x (4).epub"), (6, "d/y"), (7, "d/y"), (8, "x (2).epub")], "id int, path string")
    got = {r.id: r.unique_path for r in links.unique_names(rows, "path", "id").collect()}
    assert got == {1: "x.epub", 2: "x (3).epub", 3: "x (2).epub", 4: "x (5).epub", 5: "x (4).epub", 6: "d/y", 7: "d/y (2)", 8: "x (2) (2).epub"}


def test_json_feed_and_errors():
    doc = """{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "1", "url": "/a", "title": "A", "content_html": "<p>x</p>", "date_published": "2024"},
      {"id": "2", "attachments": [{"url": "https://h/b.epub", "mime_type": "application/epub+zip"}]}, {"title": "nothing"}, {"content_text": "only text"}]}"""
    got = feeds.read_feed(doc, "https://h.org/")
    assert [(e["guid"][:9], e["url"], e["content_type"]) for e in got] == [("1", "https://h.org/a", None), ("2", "https://h/b.epub", "application/epub+zip"), ("urn:sha1:", None, None)]
    assert feeds.feed_error(doc) is None and feeds.feed_error("<rss><channel/></rss>") is None
    assert all(feeds.feed_error(x) for x in ("", None, "<rss>", "{bad", '{"a": 1}', "<html/>"))


def test_mended_references():
    names = {"O/book.opf", "O/text/c1.xhtml", "O/text/c2.xhtml", "O/images/i.jpg", "O/cover.xhtml"}
    fix = lambda value, entry="O/text/c1.xhtml": upkeep.mended(value, entry, names, "O", {"p": "O/text/c2.xhtml", "q": "O/text/c1.xhtml"})
    assert fix("../images/i.jpg") == "../images/i.jpg" and fix("images/i.jpg") == "../images/i.jpg" and fix("../images/i.jpg", "O/cover.xhtml") == "images/i.jpg"
    assert fix("gone.xhtml#p") == "c2.xhtml#p" and fix("gone.xhtml#q") == "#q" and fix("gone.xhtml#z") == "gone.xhtml#z" and fix("https://h/x") == "https://h/x" and fix("#p") == "#p"
    book = file_sources.write_epub("T", "A", "en", [("One", '<p><img src="../nav.xhtml"/></p>')])
    assert b"T" in book and upkeep.mend_epub(b"x") is None
    fixed = upkeep.mend_epub(book)
    with containers.zipfile.ZipFile(containers.io.BytesIO(fixed)) as z:
        assert b'src="nav.xhtml"' in z.read("c0.xhtml") and z.namelist()[0] == "mimetype"


def test_layout(spark):
    cells = [(0, 0, 10, "Name"), (100, 0, 10, "Long"), (100, 7, 17, "header"), (0, 40, 50, "a"), (100, 40, 50, "1"), (0, 60, 70, "b"), (101, 61, 71, "2")]
    assert layout.grid(cells) == [["Name", "Long header"], ["a", "1"], ["b", "2"]]
    assert layout.grid(cells[:3]) is None and layout.grid([(0, k * 20, k * 20 + 10, "x") for k in range(9)]) is None
    assert layout.table_xhtml([["a<"], ["b"]], True) == "<table><tr><th>a&lt;</th></tr><tr><td>b</td></tr></table>"
    assert layout.boxes([(0, 0, 10, 10), (20, 50, 40, 60), (500, 55, 520, 60)], [(100, 110)]) == [(0, 0, 40, 96), (500, 55, 520, 96)]
    rows = spark.createDataFrame([("d", 0, k, t, float(x0), float(x1), float(y), float(y) + 8, s, 10.0, h) for k, (t, x0, x1, y, s, h) in enumerate([("A wide line of the body text of the page", 0, 300, 0, 10.0, False), ("Server", 10, 60, 20, 8.0, False), ("a@b.org", 10, 60, 30, 8.0, False), ("Ends here.", 10, 60, 40, 8.0, False), ("Heading", 10, 60, 50, 8.0, True), ("Table", 200, 260, 60, 8.0, False)])], "doc string, page int, line int, text string, x0 double, x1 double, y0 double, y1 double, size double, body_size double, heading boolean")
    regions = spark.createDataFrame([("d", 0, 190.0, 55.0, 270.0, 75.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.figure_labels(rows, regions).filter("label").collect()] == ["Server"]
    assert sorted(r.text for r in layout.title_block(rows).filter("front").collect()) == sorted(["A wide line of the body text of the page", "Server", "a@b.org", "Ends here."])
    drawn = spark.createDataFrame([("d", 0, 0.0, 70.0, 100.0, 100.0), ("d", 0, 0.0, 400.0, 100.0, 500.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    caption = rows.withColumn("text", F.when(F.col("line") == 5, "Table 1 - x").otherwise(F.col("text")))
    assert [tuple(r)[2:] for r in layout.table_regions(drawn, caption).collect()] == [(-6.0, 64.0, 106.0, 106.0)]


def _equals_sql(spark, folder, name, **frames):
    db = duckdb.connect()
    for k, frame in frames.items():
        frame.write.parquet(f"{folder}/{k}.parquet")
        db.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def test_sizes_of_a_terabyte(spark, tmp_path):
    parts = spark.createDataFrame([(i, 1, n) for i, n in enumerate((1, 100, 20_000, 120_000, 1_199_999))], "l_orderkey long, l_linenumber int, l_partkey long")
    assert max(float(shown.split()[0]) for _, _, shown, _ in _equals_sql(spark, tmp_path, "sizes_shown", lineitem=parts) if shown.endswith("GB")) > 100_000


def test_titles_with_other_entities(spark, tmp_path):
    titles = ["a &quot;b&quot; &amp;quot; &lt;c&gt;", "cut &amp", "R&D &copy; x", "plain"]
    pages = spark.createDataFrame([(i, f"https://h.org/{i}", f'<html lang="De"><head><TITLE>{t}</title></head><body><p>x &quot;y&quot;</p></body></html>'.replace("TITLE", "title" if i else "TITLE")) for i, t in enumerate(titles)], "page_id long, url string, html string")
    assert len(_equals_sql(spark, tmp_path, "pages_as_epub", pages=pages)) == 4


def test_language_cuts_a_text_once(spark):
    texts = spark.createDataFrame([("the and of que",), ("de que",), ("que el",), (None,), ("xyz",), ("der die und",), ("",)], "text string")
    guessed = texts.select("text", text.guess_language("text").alias("g"), text.guess_language("text", F.lit("xx")).alias("d"))
    assert texts.select(text.guess_language("text").alias("g"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in guessed.collect()] == [("the and of que", "en", "xx"), ("de que", "pt", "xx"), ("que el", "es", "xx"), (None, "", "xx"), ("xyz", "", "xx"), ("der die und", "de", "xx"), ("", "", "xx")]


def test_an_address_is_parsed_once(spark):
    rows = spark.createDataFrame([("https://h.org/2024/01/02/a-b/",), ("https://h.org/2024/01/02/page",), ("https://h.org/2024/01/02/12",), (None,), ("no",), ("/2024/1/2/x",)], "url string")
    made = rows.select(urls.post_parts("url").alias("p"))
    assert made._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_url") <= 1
    assert [r.p and tuple(r.p) for r in made.collect()] == [(2024, 1, 2, "a-b"), None, None, None, None, (2024, 1, 2, "x")]


def test_tables_share_a_batch(spark):
    cells = [(0, 0, 10, "Name"), (100, 0, 10, "Long"), (100, 7, 17, "header"), (0, 40, 50, "a"), (100, 40, 50, None), (100, 40, 50, "1")]
    rows = [(doc, 0, 0, float(x), float(y0), float(y1), t) for doc in ("a", None) for x, y0, y1, t in cells] + [("b", 0, 0, 0.0, 0.0, 9.0, "x")]
    made = layout.tables(spark.createDataFrame(rows, "doc string, page int, table int, x0 double, y0 double, y1 double, text string"))
    # a group of pandas for each table took a second for a thousand
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc or "", r.n_rows, r.n_columns) for r in made.collect()) == [("", 2, 2), ("a", 2, 2)] and made.first().xhtml.startswith("<table><tr><th>Name</th><th>Long header</th></tr><tr><td>a</td><td>1</td>")


def test_conversions(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>P</title></head><body><p>hello there</p></body></html>", "https://h.org/p"), (2, None, None)], "page_id int, html string, url string")
    made = {r.page_id: r for r in convert.pages_to_epub(pages).collect()}
    assert made[1].title == "P" and file_sources.read_epub(bytes(made[1].epub))["title"] == "P" and made[2].epub is not None
    texts = spark.createDataFrame([(1, "T", "A", "pt", "CHAPTER ONE\n\nSome words here.\n\nCHAPTER TWO\n\nMore words.")], "id int, title string, author string, language string, text string")
    assert file_sources.read_epub(bytes(convert.texts_to_epub(texts).first().epub))["spine"] >= 1
    book = containers.write_fb2("B", "A C", "en", [("One", "<p>x</p>")])
    fb = spark.createDataFrame([(1, book), (2, b"no")], "id int, content binary")
    got = {r.id: r.epub for r in convert.fictionbooks_to_epub(fb).collect()}
    assert file_sources.read_epub(bytes(got[1]))["title"] == "B" and got[2] is None


def test_charset_and_categories(spark):
    got = one(spark, runs.with_charset(L("<html><HEAD a><p>")).alias("a"), runs.with_charset(L("<p>x")).alias("b"), runs.with_charset(L('<meta charset="x">')).alias("c"), runs.feed_category(L("Name"), L(" /x/ ")).alias("d"), runs.feed_category(L("Name"), L("")).alias("e"), runs.default_target(L("text/html; x"), L("a")).alias("f"), runs.default_target(L("x/y"), L("a.bin")).alias("g"))
    assert got == ('<html><HEAD a><meta charset="utf-8"><p>', '<meta charset="utf-8"><p>x', '<meta charset="x">', "rss/x", "rss/Name", "epub", "")
    assert one(spark, runs.address(L("/opds/all"), {"q": L("a b&c"), "page": F.lit(2), "x": L("")}, "http://h/").alias("a")) == ("http://h/opds/all?q=a+b%26c&page=2",)


def test_settings_and_profiles(spark):
    s = upkeep.setting
    got = one(spark, s(L("x"), "choice", choices=["a", "b"]).alias("a"), s(L("B"), "choice", choices=["a", "b"]).alias("b"), s(L("99"), "int", least=1, most=50).alias("c"), s(L("no"), "int", default=7).alias("d"), s(L("ON"), "bool").alias("e"), s(L(""), "float", least=0.5).alias("f"))
    assert [tuple(x) for x in got] == [("a", True), ("b", False), ("50", False), ("7", True), ("true", False), ("0.5", False)]
    p = one(spark, upkeep.profile(L('{"slug": "k", "screen_width": 600, "unknown": 1, "native_formats": ["EPUB"]}')).alias("p"))[0]
    assert p.slug == "k" and p.screen_width == 600
    assert one(spark, upkeep.can_open(F.array(L("EPUB")), L(".epub")).alias("a"), upkeep.screen_label(F.lit(600), F.lit(800), F.lit(212), F.lit(False)).alias("b"), upkeep.merged_options(L('{"a": 1, "b": 2}'), L('{"b": 3}')).alias("c")) == (True, "600×800 · 212 ppi", {"a": "1", "b": "3"})


def test_catalog_documents(spark):
    totals = catalogs.page_links(spark.range(1).select(F.lit(90).cast("long").alias("total"), F.lit(True).alias("has_prev"), F.lit(True).alias("has_next")), "/opds/all", 2, 40)
    entries = spark.createDataFrame([(2, "<entry>b</entry>"), (1, "<entry>a</entry>")], "work_id int, xml string")
    xml = catalogs.atom_feed(entries, totals, "A & B", "urn:x", "/opds/all?page=2", "2024-01-01T00:00:00Z", "Lib").first().xml
    root = containers.ElementTree.fromstring(xml)
    assert [c.text for c in root if c.tag.endswith("entry")] == ["a", "b"] and 'rel="next" href="/opds/all?page=3"' in xml and "A &amp; B" in xml
    import json

    doc = json.loads(catalogs.publications_feed(spark.createDataFrame([(1, '{"x": 1}')], "work_id int, json string"), totals, "T", "/v2").first().json)
    assert doc["publications"] == [{"x": 1}] and [x["rel"] for x in doc["links"]] == ["self", "next", "previous"]


def test_files(spark, tmp_path):
    data = file_sources.write_epub("T & U", "A", "pt", [("One", "<p>" + "text " * 50 + "</p>")])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.epub").write_bytes(data)
    (tmp_path / "fake.txt").write_bytes(b"%PDF-1.5")
    (tmp_path / ".hidden.epub").write_bytes(b"x")
    (tmp_path / "x.unknown").write_bytes(b"x")
    got = {r.name: r for r in file_sources.detect(file_sources.scan(spark, str(tmp_path), content=True)).withColumn("meta", file_sources.epub_metadata("content")).collect()}
    assert set(got) == {"b.epub", "fake.txt"}
    assert got["b.epub"].format == "epub" and got["fake.txt"].format == "pdf" and got["fake.txt"].corrected
    assert (got["b.epub"].meta.title, got["b.epub"].meta.author, got["b.epub"].meta.spine, got["b.epub"].meta.image_only) == ("T & U", "A", 1, False)
    assert one(spark, file_sources.decoded(F.lit("é".encode("cp1252"))).alias("a"), file_sources.decoded(F.lit("﻿é".encode())).alias("b")) == ("é", "é")


def test_geometry(spark):
    assert tuple(one(spark, planner.fit(F.lit(2000), F.lit(1000), 800, 480).alias("f"))[0]) == (800, 400)
    assert one(spark, planner.grey_levels(F.lit(100), 16).alias("g"), planner.spread(F.lit(200), F.lit(100)).alias("s"), planner.text_mode(L(" TRUE ")).alias("t")) == (102, "rotate", "experimental")
    assert one(spark, catalogs.published_date(L("1999")).alias("a"), catalogs.display_title(L("T"), L("S"), F.lit(3.0)).alias("b")) == ("1999-01-01T00:00:00Z", "S #3 — T")
    assert one(spark, catalog.has_room(F.lit(5), F.lit(6), F.lit(10)).alias("a"), catalog.has_room(F.lit(5), F.lit(6), F.lit(0)).alias("b")) == (False, True)
    assert pd.notna(one(spark, files.fingerprint(F.lit(b"abc")).alias("x"))[0])


def test_pages_cover_the_result(spark):
    books = queries.books(spark, SF)
    q = catalog.BookQuery(sort="size_desc", per_page=70)
    found = [r.id for n in (1, 2, 3) for r in catalog.page(books, catalog.BookQuery(sort="size_desc", per_page=70, page=n))[0].collect()]
    assert sorted(found) == sorted(r.id for r in books.select("id").collect()) and len(set(found)) == len(found)
    assert catalog.page(books.limit(0), q)[1].first().pages == 1


def test_progress_writes(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, t(0), 0, 2), (1, t(0), 1, 4), (1, t(0.5), 2, 20), (1, t(1), 3, 8), (1, t(1), 4, 9), (1, t(1.1), 5, 100), (1, t(1.2), 6, 100), (2, t(0), 0, 5), (2, t(9), 1, 9), (None, t(0), 0, 50), (2, t(9), 2, None)]
    found = desk.progress_writes(spark.createDataFrame(rows, "job_id long, at timestamp, seq long, percent int"))
    assert sorted((r.job_id, r.seq) for r in found.collect()) == [(1, 1), (1, 4), (1, 5), (1, 6), (2, 0)]


def test_gutters(spark):
    two = [("d", 1, x, y, x + 180.0) for x in (50.0, 300.0) for y in range(0, 200, 20)]
    one_column = [("d", 2, 50.0, y, 480.0) for y in range(0, 200, 20)]
    found = lines.gutters(spark.createDataFrame([*two, *one_column], "doc string, page int, x0 double, y0 long, x1 double"))
    at = {r.page: r.gutter for r in found.collect()}
    assert at[2] is None and 230 < at[1] < 300


def test_merge_pages(spark):
    rows = [("d", 0, 1, "head", "Title"), ("d", 1, 1, "para", "An exam-"), ("d", 2, 2, "para", "ple that goes"), ("d", 3, 3, "para", "on. It ends."), ("d", 4, 3, "para", "next"), ("d", 5, 4, "para", "Upper"), ("d", 6, 4, "para", "Co-"), ("d", 7, 5, "para", "Op")]
    found = lines.merge_pages(spark.createDataFrame(rows, "doc string, n int, page int, kind string, text string")).orderBy("n").collect()
    assert [(r.n, r.page, r.text) for r in found] == [(0, 1, "Title"), (1, 1, "An example that goes on. It ends."), (4, 3, "next"), (5, 4, "Upper"), (6, 4, "Co- Op")]


def test_profiles_and_names(spark):
    stored = spark.createDataFrame([("a", "A", "{}", True), ("b", "B", "{}", False)], "slug string, name string, spec string, builtin boolean")
    both = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    assert [r.slug for r in desk.delete_profiles(stored, both).collect()] == ["a"]


def test_headers_need_an_edge(spark):
    rows = [(1, p, t, edge) for p in range(5) for t, edge in ((f"Part {p}", True), ("inside", False), ("Part", False), ("12", False), (str(p), True), ("- xiv -", True))]
    found = chapters.running_headers(spark.createDataFrame(rows, "doc int, page int, text string, edge boolean")).filter("header").collect()
    assert {r.text for r in found} == {f"Part {p}" for p in range(5)} | {"Part", "- xiv -"} | {str(p) for p in range(5)}
    few = chapters.running_headers(spark.createDataFrame(rows, "doc int, page int, text string, edge boolean"), spark.createDataFrame([(1, 90)], "doc int, pages int"))
    assert {r.text for r in few.filter("header").collect()} == {"- xiv -"} | {str(p) for p in range(5)}


def test_heading_levels(spark):
    level = lambda t, size=10.0, bold=False, font="A": one(spark, lines.heading_level(F.lit(t).cast("string"), F.lit(size), F.lit(bold), F.lit(font), F.lit(10.0), F.lit("A")).alias("l"))[0]
    assert [level("2.3.1.4 Deep part"), level("1) First"), level("Resumo:"), level("Resumo", 11.0), level("ALL CAPS"), level("plain words", 13.5), level("plain words", 11.3), level("plain words", 10.5, True, "B"), level("plain words", 10.5, True)] == [3, 1, 2, 1, 2, 1, 2, 2, 0]
    assert [level("Ends.", 20.0), level("x" * 91, 20.0), level("a " * 17, 20.0), level(None), level("AB")] == [0, 0, 0, 0, 0]


def test_spans_and_lines(spark):
    rows = [(1, 0, 0, 0, 10.0, 5.0, 20.0, 15.0, 10.0, 0, "f", "codi", 100.0), (1, 0, 0, 1, 20.1, 5.0, 24.0, 15.0, 12.0, 16, "fi", "fi", 100.0), (1, 0, 0, 2, 24.2, 5.0, 40.0, 15.0, 10.0, 0, "f", "cador", 100.0), (1, 0, 0, 3, 45.0, 5.0, 60.0, 15.0, 10.0, 0, "f", " x  y ", 100.0), (1, 0, 1, 0, 0.0, 50.0, 9.0, 60.0, 10.0, 0, "f", "  ", 100.0)]
    got = lines.page_lines(spark.createDataFrame(rows, "doc int, page int, line int, n int, x0 double, y0 double, x1 double, y1 double, size double, flags int, font string, text string, height double")).collect()
    assert [(r.text, r.x0, r.x1, r.size, r.font, r.bold, r.edge) for r in got] == [("codificador x y", 10.0, 60.0, 12.0, "f", True, True)]


def test_plain_chapters(spark):
    text_of = lambda t: [(c["title"], c["body"]) for c in chapters.plain_markup(t)]
    assert text_of(None) == [("Texto", "")] and text_of("Chapter 1\na") == [("Texto", "<p>Chapter 1</p>\n<p>a</p>")]
    assert text_of("a\n\n<b>\nChapter 1\nx\n1.2 early\nPART TWO\ny") == [("Seção", "<p>a</p>\n<p>&lt;b&gt;</p>"), ("Chapter 1", "<h2>Chapter 1</h2>\n<p>x</p>\n<p>1.2 early</p>"), ("PART TWO", "<h2>PART TWO</h2>\n<p>y</p>")]
    assert chapters.plain_cuts(["x"] * 7, 3) == [(0, 3, ""), (3, 6, ""), (6, 7, "")]


def test_archives_and_comics(spark):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name in ("p10.png", "p2.png", "../up.png", "note.txt"):
            t.addfile(tarfile.TarInfo(name), io.BytesIO(b""))
    assert [n for n, _ in containers.members(out.getvalue())] == ["p2.png", "p10.png"]
    made = containers.write_comic([("a.JPG", b"1"), ("b", b"2")], {"series": "S & T", "series_index": 3.0, "reading_direction": "rtl"})
    assert [(n, d) for n, d in containers.members(made)] == [("00001.jpg", b"1"), ("00002.jpg", b"2")]
    read = containers.read_comic(made)
    assert (read["title"], read["series"], read["series_index"], read["page_count"], read["reading_direction"], read["author"]) == ("S & T", "S & T", 3.0, 2.0, "rtl", None)
    rows = spark.createDataFrame([(bytearray(made),), (bytearray(b"junk"),), (None,)], "c binary").select(containers.comic_metadata("c").alias("m"), containers.archive_pages("c").alias("p"), containers.epub_contents("c").alias("t")).collect()
    assert [r.m.series for r in rows] == ["S & T", None, None] and [r.p is None for r in rows] == [False, True, True] and [r.t for r in rows] == [None] * 3


def test_fictionbook():
    made = containers.write_fb2("T", "Ann B C", None, [("One", "<h2>In</h2><p>a <em>b</em> &amp; c</p>\x00"), ("", "")])
    read = containers.read_fb2(made)
    assert (read["title"], read["author"], read["language"]) == ("T", "Ann B C", "pt")
    assert [(c["title"], c["body"]) for c in read["chapters"]] == [("One", "<p>In</p>\n<p>a b &amp; c</p>"), ("", "")]
    nested = f'<FictionBook xmlns="{containers.FB2}" xmlns:l="http://www.w3.org/1999/xlink"><body><section><title><p>A</p><p>B</p></title><p>x<image l:href="#i"/>y</p><section><title><p>In</p></title><p>z</p></section></section></body><binary id="i" content-type="image/png">AA==</binary></FictionBook>'
    assert [(c["title"], c["body"]) for c in containers.read_fb2(nested.encode())["chapters"]] == [("A B", '<p>x<img src="i.png" alt=""/>y</p>\n<h2>In</h2>\n<p>z</p>')]


def test_epub_parts():
    data = file_sources.write_epub("T", "A", "pt", [("One", "<p>First one. Second <b>bold</b> tail! End</p>"), ("Two", "<p></p>")])
    assert containers.read_contents(data) == [{"key": "c0.xhtml", "title": "One", "level": 1}, {"key": "c1.xhtml", "title": "Two", "level": 1}]
    assert [c["title"] for c in containers.read_chapters(data)] == ["One", "Two"]
    made = containers.write_kepub(data)
    with containers.zipfile.ZipFile(containers.io.BytesIO(made)) as z:
        page, first = z.read("c0.xhtml").decode(), z.namelist()[0]
    assert first == "mimetype" and [f'id="kobo.2.{k}"' in page for k in range(1, 6)] == [True] * 5 and 'id="kobo.2.6"' not in page and "<b>bold</b>" in page
    ncx = b'<ncx xmlns="n"><navMap><navPoint><navLabel><text>P</text></navLabel><content src="a.html"/><navPoint><navLabel><text>Q</text></navLabel><content src="b.html"/></navPoint></navPoint></navMap></ncx>'
    assert list(containers._ncx_links(containers.ElementTree.fromstring(ncx))) == [("a.html", "P", 0), ("b.html", "Q", 0)]


def test_kindle_cover():
    import struct

    def book(place, first=2):
        exth = b"EXTH" + struct.pack(">II", 0, 2) + struct.pack(">II", 100, 9) + b"x" + struct.pack(">III", 201, 12, place)
        head = bytearray(16 + 232) + exth
        head[16:24] = b"MOBI" + struct.pack(">I", 232)
        head[108:112], head[128:132] = struct.pack(">I", first), struct.pack(">I", 0x40)
        records = [bytes(head), b"TEXT", b"FIRST", b"SECOND"]
        at, marks = 78 + 8 * len(records), b""
        for r in records:
            marks += struct.pack(">II", at, 0)
            at += len(r)
        return b"\0" * 60 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records)) + marks + b"".join(records)

    assert containers.read_kindle_cover(book(0)) == b"FIRST" and containers.read_kindle_cover(book(1)) == b"SECOND"
    assert containers.read_kindle_cover(book(7)) is None and containers.read_kindle_cover(b"x") is None


def test_deep_page():
    deep = "<html><body>" + "<div>" * 10_000 + "<h2>Deep</h2><p>" + "text " * 30 + "</p>" + "</div>" * 10_000 + "</body></html>"
    got = html.read_page(deep, "https://h.org/")
    assert [c["title"] for c in got["chapters"]] == ["Deep"] and "text text" in got["chapters"][0]["body"]
    assert "text text" in sanitize.safe_html(deep, "", "/a/")


def test_page_steps():
    lead = "An opening paragraph that is long enough to become a chapter of its own, with the title of the page. "
    page = f"""<html><head><title>T</title><meta name="subtitle" content="S"><meta property="og:site_name" content="Site"><meta name="owner" content="Owner"><meta name="article:modified_time" content="2024"></head>
    <body><header><h1>Top</h1><p>{lead}</p></header><section id="s1"><h2>One</h2><p>first <a href="#s2">to two</a> <a href="#gone">broken</a> <a href="/x">out</a></p></section>
    <section id="s2"><h2>Two</h2><p>second <mark>m</mark><u>u</u></p><canvas>no</canvas><video>no</video><form><p>kept words</p></form><custom-tag>c</custom-tag><table><tr><td>cell</td></tr></table><pre>a   b</pre></section></body></html>"""
    got = html.read_page(page, "https://h.org/p")
    assert (got["description"], got["publisher"], got["date"]) == ("S", "Owner", "2024")
    (chapter,) = got["chapters"]
    body = chapter["body"]
    assert "opening paragraph" in body and "kept words" in body and ">no<" not in body and "<h2>One</h2>" in body and "<header" not in body
    assert '<a href="#s2">to two</a>' in body and "<span>broken</span>" in body and 'href="https://h.org/x" target="_blank"' in body
    assert '<span style="background-color: #ff0;">m</span>' in body and "<div>c</div>" in body and '<td style="border: 1px solid black;">' in body and "<pre>a   b</pre>" in body


def test_page_links_between_chapters():
    long = "<p>" + "word " * 4000 + "</p>"
    page = f"<body><h2>One</h2><p><a href='#b'>b</a><a href='#a'>a</a></p><p id='a'>x</p>{long}<h2>Two</h2><p id='b'>y</p>{long}</body>"
    one, two = html.read_page(page, "https://h.org/p")["chapters"]
    assert 'href="chapter_0002.xhtml#b"' in one["body"] and 'href="#a"' in one["body"] and two["title"] == "Two"


def test_sanitiser():
    css = sanitize.safe_css("/* c */ @import url(x.css); a{behavior:url(b.htc);-moz-binding:url(x);background:url('../i.png')} b{background:url(http://h/x)} c{background:url(../../../e)}", "t/c", "/as/")
    assert "import" not in css and "behavior" not in css and "-moz" not in css and 'url("/as/t/i.png")' in css and css.count('url("data:,")') == 2
    assert "vbscript" not in sanitize.safe_css("a{b:vbscript:x}", "", "")
    raw = """<html lang="pt"><head><title>old</title><link rel="stylesheet" href="s.css"><link rel="icon" href="i.ico"><meta charset="x"><script>bad()</script></head>
    <body onload="x()"><a href="c2.xhtml#p" onclick="y()">n</a><a href="javascript:z()">j</a><a href="mailto:a@b">m</a><img src="../img/a b.png" srcset="http://h/x 1x, y.png 2x"><img src="https://h/x.png"><iframe src="x"></iframe>tail<img src="../../../../etc"></body></html>"""
    out = sanitize.safe_html(raw, "text/ch", "/as/", "/ch/", title="new")
    assert out.startswith('<html lang="pt"><head><style id="reader-base">') and "old" not in out and "bad()" not in out and "onload" not in out and "onclick" not in out
    assert 'href="/as/text/ch/s.css"' in out and "i.ico" not in out and 'href="/ch/text/ch/c2.xhtml"' in out and "javascript" not in out and 'href="mailto:a@b"' in out
    assert 'src="/as/text/img/a%20b.png"' in out and 'srcset="/as/text/ch/y.png 2x"' in out and "https://h" not in out and "tail" in out and "etc" not in out


def test_dealt_by_size(spark, tmp_path):
    """A task's part is bounded by bytes, and a key's rows are together."""
    at = str(tmp_path / "rows")
    spark.range(200_000).selectExpr("id % 1000 AS doc", "id").write.parquet(at)
    size = sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet"))
    few, many = (dealt(spark.read.parquet(at), "doc", share=share) for share in (size, size // 40))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() >= 40
    placed = many.select("doc", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == 1000
    shown = lines.reading_order(many.selectExpr("doc", "1 AS page", "0D AS x0", "9D AS x1", "id * 1D AS y0", "id + 1D AS y1", "id AS line", "CAST(NULL AS double) AS gutter"))
    assert shown._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pages_come_in_small_batches(spark):
    """A worker holds few pages at a time, however many a task has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spread(spark.range(0, 5000, 1, 1))
    sizes = rows.select(F.pandas_udf(lambda ids: ids * 0 + len(ids), "long")("id").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 200
