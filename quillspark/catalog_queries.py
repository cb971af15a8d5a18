"""Registered queries: catalog pages as documents, settings and options, profiles, and where columns of a page part."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import lines
from quillspark.operators import catalog, upkeep
from quillspark.page_queries import _LINES, _boxes
from quillspark.queries import _BOOKS, _LINKS, _PLAIN_RANKED, books, derived_books, query, table
from quillspark.sources import catalogs

_PAGE = """page AS (SELECT id AS work_id FROM books ORDER BY added_at DESC, id LIMIT 40 OFFSET 40), shown AS (SELECT l.* FROM l JOIN page USING (work_id) WHERE n = 1), totals AS (SELECT count(*) AS total FROM books)"""
_NEXT = "CASE WHEN total > 80 THEN '{}' ELSE '' END"


def _page_of_works(spark, sf_dir):
    """The second page of all works, newest first: its totals and links, and the offers of its works."""
    q = catalog.BookQuery(page=2, per_page=40)
    rows, totals = catalog.page(books(spark, sf_dir), q)
    offers = catalog.acquisition_links(derived_books(spark, sf_dir)).join(F.broadcast(rows.select(F.col("id").alias("work_id"))), "work_id", "left_semi")
    return offers, catalogs.page_links(totals, "/opds/all", 2, 40)


_ATOM_LINK = '<link rel="{}" href="{}" type="' + catalogs.ACQUISITION + '"/>'


@query(f"""WITH {_BOOKS}, {_PLAIN_RANKED}, {_LINKS}, {_PAGE}, e AS (SELECT work_id, '<entry><title>' || replace(replace(replace(coalesce(arg_min(title, rank), ''), '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</title>' || string_agg('<link rel="http://opds-spec.org/acquisition" type="' || format || '" href="/opds/file/' || id || '"/>', '' ORDER BY rank) || '</entry>' AS xml FROM shown GROUP BY work_id)
  SELECT '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><id>urn:all</id><title>All &amp; new</title><updated>2024-02-15T00:00:00Z</updated>{_ATOM_LINK.format("self", "/opds/all?page=2")}<author><name>Desk</name></author>'
    || '{_ATOM_LINK.format("previous", "/opds/all?page=1")}' || {_NEXT.format(_ATOM_LINK.format("next", "/opds/all?page=3"))} || '<opensearch:totalResults>' || total || '</opensearch:totalResults><opensearch:startIndex>41</opensearch:startIndex>' || coalesce((SELECT string_agg(xml, '' ORDER BY work_id) FROM e), '') || '</feed>' AS xml FROM totals""")
def opds_feed(spark, sf_dir):
    offers, links = _page_of_works(spark, sf_dir)
    return catalogs.atom_feed(catalogs.atom_entries(offers), links, "All & new", "urn:all", "/opds/all?page=2", "2024-02-15T00:00:00Z", "Desk")


_JSON_LINK = '{{"rel":"{}","href":"/opds/all?page={}","type":"application/opds+json"}}'


@query(f"""WITH {_BOOKS}, {_PLAIN_RANKED}, {_LINKS}, {_PAGE}, e AS (SELECT work_id, to_json({{'metadata': {{'title': arg_min(title, rank), 'author': arg_min(coalesce(nullif(author, ''), '?'), rank)}}, 'links': list({{'rank': rank, 'href': '/opds/file/' || id, 'format': format, 'file_size': file_size}} ORDER BY rank)}})::VARCHAR AS json FROM shown GROUP BY work_id)
  SELECT '{{"metadata":{{"title":"All","numberOfItems":' || total || '}},"links":[{_JSON_LINK.format("self", 2)}' || {_NEXT.format("," + _JSON_LINK.format("next", 3))} || ',{_JSON_LINK.format("previous", 1)}],"publications":[' || coalesce((SELECT string_agg(json, ',' ORDER BY work_id) FROM e), '') || ']}}' AS json FROM totals""")
def opds2_feed(spark, sf_dir):
    offers, links = _page_of_works(spark, sf_dir)
    return catalogs.publications_feed(catalogs.publications(offers), links, "All", "/opds/all?page=2")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN 'over' ELSE json_extract_string(props, '$.k') END AS held FROM events""")
def options_merged(spark, sf_dir):
    """An event's properties are the options asked for; some are added, some replaced."""
    i = F.col("event_id")
    added = F.when(i % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"))))
    out = table(spark, sf_dir, "events").withColumn("m", upkeep.merged_options("props", added)).withColumn("o", upkeep.merged_options("props", F.when(i % 5 == 0, '{"k": "over"}').when(i % 5 == 1, "")))
    return out.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("o", F.lit("k")).alias("held"))


@query("""WITH s AS (SELECT l_partkey AS k, max(l_quantity)::INT::VARCHAR AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY l_partkey) SELECT p_partkey AS key, coalesce(v, p_brand) AS value FROM part LEFT JOIN s ON p_partkey = k""")
def settings_overlaid(spark, sf_dir):
    """A part's brand is its default, its largest returned lot what is stored."""
    c = F.col
    stored = table(spark, sf_dir, "lineitem").filter((c("l_returnflag") == "R") & (c("l_quantity") > 40)).groupBy(c("l_partkey").alias("key")).agg(F.max("l_quantity").cast("int").cast("string").alias("value"))
    return upkeep.overlaid(table(spark, sf_dir, "part").select(c("p_partkey").alias("key"), c("p_brand").alias("value")), stored)


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size * 20 END AS screen_width, p_partkey % 2 = 0 AS reflow_text, [p_type, 'epub'] AS native_formats, CASE WHEN p_partkey % 3 > 0 THEN (p_size * 20) || '×' || (p_size * 30) ELSE 'qualquer tela' END || CASE WHEN p_partkey % 3 > 0 THEN ' · ' || (p_size * 6) || ' ppi' ELSE '' END AS screen FROM part""")
def profiles_read(spark, sf_dir):
    """Parts are profiles, written as JSON with a key that no profile has."""
    c, k = F.col, F.col("p_partkey")
    made = F.to_json(F.struct(c("p_name").alias("name"), F.when(k % 3 > 0, c("p_size") * 20).alias("screen_width"), (c("p_size") * 30).alias("screen_height"), (c("p_size") * 6).alias("ppi"), (k % 2 == 0).alias("reflow_text"), F.array("p_type", F.lit("epub")).alias("native_formats"), c("p_brand").alias("brand")))
    read = table(spark, sf_dir, "part").select("p_partkey", upkeep.profile(made).alias("p"))
    return read.select("p_partkey", "p.name", "p.screen_width", "p.reflow_text", "p.native_formats", upkeep.screen_label(c("p.screen_width"), c("p.screen_height"), c("p.ppi"), F.lit(False)).alias("screen"))


@query(f"""WITH {_LINES}, m AS (SELECT l_partkey AS doc, CASE WHEN kind = 'R' THEN x0 % 150 ELSE 300 + x0 % 150 END::DOUBLE AS x0, q::DOUBLE * 3 + 20 AS w FROM boxes), b AS (SELECT doc, x0, x0 + w AS x1 FROM m),
  e AS (SELECT doc, min(x0) AS l, max(x1) - min(x0) AS span, count(*) AS n FROM b GROUP BY doc), bins AS (SELECT doc, l, span, n, span / 60 AS step, unnest(range(60)) AS k FROM e WHERE span > 0),
  cover AS (SELECT bins.doc, bins.l, step, span, n, k, count(b.doc) FILTER (k BETWEEN least(59, greatest(0, floor((x0 - bins.l) / step))) AND least(59, greatest(0, floor((x1 - bins.l) / step)))) AS c FROM bins JOIN b USING (doc) GROUP BY ALL),
  low AS (SELECT *, k - row_number() OVER (PARTITION BY doc ORDER BY k) AS island FROM cover WHERE c <= greatest(1, round_even(n * 0.05::DOUBLE, 0)) AND k BETWEEN 12 AND 47), runs AS (SELECT doc, l, step, span, min(k) AS first, count(*) AS len FROM low GROUP BY doc, l, step, span, island),
  best AS (SELECT doc, any_value(l) AS l, any_value(step) AS step, any_value(span) AS span, arg_max(first, (len, -first)) AS first, max(len) AS len FROM runs GROUP BY doc),
  found AS (SELECT doc, l + (first + len / 2) * step AS gutter FROM best WHERE len * step >= greatest(10.0, 0.04::DOUBLE * span)), good AS (SELECT doc, gutter FROM b JOIN found USING (doc) GROUP BY doc, gutter HAVING count(*) FILTER ((x0 + x1) / 2 < gutter) >= 2 AND count(*) FILTER ((x0 + x1) / 2 >= gutter) >= 2)
  SELECT doc, round(gutter, 6) AS gutter FROM e LEFT JOIN good USING (doc)""")
def page_gutters(spark, sf_dir):
    """Boxes as lines in two columns of a page, returned ones on the left."""
    c = F.col
    x0 = F.when(c("kind") == "R", c("x0") % 150).otherwise(300 + c("x0") % 150).cast("double")
    placed = _boxes(spark, sf_dir).select(c("l_partkey").alias("doc"), F.lit(0).alias("page"), x0.alias("x0"), (x0 + c("q").cast("double") * 3 + 20).alias("x1"))
    return lines.gutters(placed).select("doc", F.round("gutter", 6).alias("gutter"))
