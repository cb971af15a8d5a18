"""Catalog documents: JSON publications and feeds, Atom entries, and the pages' links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import display, given

_NULLS = {"ignoreNullFields": "false"}


def summary_json(books: DataFrame) -> DataFrame:
    """One JSON document a book, nulls kept."""
    return books.select("id", F.to_json(F.struct(*[F.col(c) for c in sorted(books.columns)]), _NULLS).alias("json"))


def display_title(title: Column, series: Column, number: Column) -> Column:
    shown = F.when(given(series).isNotNull(), F.concat_ws(" ", given(series), F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("long").cast("string")))))
    return F.concat_ws(" — ", shown, title)


def published_date(value: Column) -> Column:
    """A year as its first day; a longer value as it is (a full date is not made malformed)."""
    return F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01T00:00:00Z"))).otherwise(value)


def publications(links: DataFrame) -> DataFrame:
    """work_id and its JSON publication: metadata and one link a variant, by rank."""
    link = F.struct("rank", F.concat(F.lit("/opds/file/"), F.col("id").cast("string")).alias("href"), "format", "file_size")
    grouped = links.groupBy("work_id").agg(F.min_by("title", "rank").alias("title"), F.min_by(display("author", "?"), F.col("rank")).alias("author"), F.array_sort(F.collect_list(link)).alias("links"))
    return grouped.select("work_id", F.to_json(F.struct(F.struct("title", "author").alias("metadata"), "links"), _NULLS).alias("json"))


def atom_entries(links: DataFrame) -> DataFrame:
    """work_id and its Atom entry."""
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit('<link rel="http://opds-spec.org/acquisition" type="'), escape(F.col("format")), F.lit('" href="/opds/file/'), escape(F.col("id")), F.lit('"/>'))
    grouped = links.groupBy("work_id").agg(F.min_by("title", "rank").alias("title"), F.array_sort(F.collect_list(F.struct("rank", link.alias("x")))).alias("x"))
    return grouped.select("work_id", F.concat(F.lit("<entry><title>"), escape(F.col("title")), F.lit("</title>"), F.array_join("x.x", ""), F.lit("</entry>")).alias("xml"))


def page_links(totals: DataFrame, base: str, page: int, per_page: int) -> DataFrame:
    """total, first item and links of a page; previous and next only where there are such pages."""
    href = lambda n: F.concat(F.lit(f"{base}?page="), n.cast("string"))
    return totals.select(
        "total",
        F.lit((page - 1) * per_page + 1).cast("long").alias("start"),
        F.when(F.col("has_prev"), href(F.lit(page - 1))).alias("previous"),
        F.when(F.col("has_next"), href(F.lit(page + 1))).alias("next"),
    )


#: Kinds of catalog documents.
ACQUISITION, NAVIGATION, OPDS2 = "application/atom+xml;profile=opds-catalog;kind=acquisition", "application/atom+xml;profile=opds-catalog;kind=navigation", "application/opds+json"


def _xml(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def atom_feed(entries: DataFrame, links: DataFrame, title: str, feed_id: str, self_href: str, updated: str, author: str) -> DataFrame:
    """One Atom document of a page of entries (work_id, xml) with the page's links and total.

    A page has as many entries as it shows, so they fit in one row.
    """
    page = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("work_id", "xml"))), lambda e: e["xml"]), "").alias("entries"))
    l = lambda rel, href, kind: F.concat(F.lit(f'<link rel="{rel}" href="'), _xml(href), F.lit(f'" type="{kind}"/>'))  # noqa: E731, E741
    head = F.concat(F.lit("<id>"), _xml(F.lit(feed_id)), F.lit("</id><title>"), _xml(F.lit(title)), F.lit("</title><updated>"), F.lit(updated), F.lit("</updated>"), l("self", F.lit(self_href), ACQUISITION), F.lit("<author><name>"), _xml(F.lit(author)), F.lit("</name></author>"))
    more = F.concat_ws("", F.when(F.col("previous").isNotNull(), l("previous", F.col("previous"), ACQUISITION)), F.when(F.col("next").isNotNull(), l("next", F.col("next"), ACQUISITION)))
    total = F.concat(F.lit("<opensearch:totalResults>"), F.col("total").cast("string"), F.lit("</opensearch:totalResults><opensearch:startIndex>"), F.col("start").cast("string"), F.lit("</opensearch:startIndex>"))
    opened = '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/">'
    return links.join(page, F.lit(True)).select(F.concat(F.lit(opened), head, more, total, F.col("entries"), F.lit("</feed>")).alias("xml"))


def publications_feed(publications: DataFrame, links: DataFrame, title: str, self_href: str) -> DataFrame:
    """One JSON document of a page of publications (work_id, json) with its links."""
    page = publications.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("work_id", "json"))), lambda e: e["json"]), ",").alias("publications"))
    link = lambda rel, href: F.to_json(F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit(OPDS2).alias("type")))
    all_links = F.concat_ws(",", link("self", F.lit(self_href)), F.when(F.col("next").isNotNull(), link("next", F.col("next"))), F.when(F.col("previous").isNotNull(), link("previous", F.col("previous"))))
    about = F.to_json(F.struct(F.lit(title).alias("title"), F.col("total").alias("numberOfItems")))
    return links.join(page, F.lit(True)).select(F.concat(F.lit('{"metadata":'), about, F.lit(',"links":['), all_links, F.lit('],"publications":['), F.col("publications"), F.lit("]}")).alias("json"))
