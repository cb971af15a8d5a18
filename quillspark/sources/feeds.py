"""Feeds and sitemaps: XML to rows, a tree walk over sitemaps, and what to do with an entry."""

from __future__ import annotations

import json
from hashlib import sha1
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import given
from quillspark.functions.urls import AUDIO, COMICS, DOCUMENTS, EBOOKS, IMAGES, post_parts, slug_title
from quillspark.functions.udf import vectorised

ENTRY_DDL = "array<struct<guid:string,title:string,url:string,summary:string,published:string,content_type:string,extensions:array<string>,inline_html:string>>"


def sitemap_locations(xml: Column) -> Column:
    """All loc texts; the expression's XPath does not mind a default namespace."""
    return F.transform(F.xpath(xml, F.lit("//loc/text()")), lambda x: F.trim(x))


def sitemap_rows(sitemaps: DataFrame) -> DataFrame:
    """url of the sitemap, loc, whether it is a child sitemap, and a post's parts or null."""
    locs = sitemaps.select(F.col("url").alias("sitemap"), F.explode(sitemap_locations(F.col("xml"))).alias("loc"))
    return locs.withColumn("child", F.lower("loc").rlike(r"\.xml(\?.*)?$")).withColumn("post", F.when(~F.col("child"), post_parts("loc")))


def posts(rows: DataFrame) -> DataFrame:
    """Posts by address, oldest first among equal ones, with title and date (null if there is no such day)."""
    p = rows.filter("post IS NOT NULL").select(F.col("loc").alias("url"), "post.*").distinct()
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", "year", "month", "day"), "yyyy-MM-dd")
    return p.select("url", slug_title("slug").alias("title"), "year", "month", "day", day.alias("date"))


def walk(sitemaps: DataFrame, roots: DataFrame, budget: int = 20) -> DataFrame:
    """Sitemaps reached from the roots breadth first, at most so many that exist; each once.

    One join a level; what is missing is passed over and costs no budget.  Only
    the addresses of those reached, ``budget`` at most, come to the driver, so
    the plan doesn't grow with the levels.
    """
    table = sitemaps.select("url", "xml")
    level, reached = roots.select("url"), []
    while len(reached) < budget:
        there = table.select("url").join(level, "url", "left_semi").filter(~F.col("url").isin(reached)).distinct()
        found = [r["url"] for r in there.orderBy("url").limit(budget - len(reached)).collect()]
        if not found:
            break
        reached += found
        level = sitemap_rows(table.filter(F.col("url").isin(found))).filter("child").select(F.col("loc").alias("url"))
    return table.filter(F.col("url").isin(reached))


def within_days(posts: DataFrame, days: int, today: str) -> DataFrame:
    """Posts of the last so many days: 0 none, -1 all."""
    if days == 0:
        return posts.limit(0)
    return posts if days < 0 else posts.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(today)), days))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _extension(url: str | None) -> str:
    last = (url or "").split("?")[0].split("#")[0].rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""


def _json_entries(document: dict, base: str) -> list[dict]:
    """Entries of a JSON feed."""
    out = []
    for item in document.get("items") or []:
        text = lambda *names, item=item: next((str(item[n]) for n in names if item.get(n)), None)
        html, bare = text("content_html") or "", text("content_text", "summary") or ""
        inline = html if len(html) >= len(bare) else bare
        files = [a for a in item.get("attachments") or [] if isinstance(a, dict) and a.get("url")]
        best = next((a for a in files if _extension(a["url"]) in [*EBOOKS, *COMICS, *DOCUMENTS, *AUDIO] or str(a.get("mime_type") or "").startswith(("audio/", "application/"))), None)
        url, mime = (best["url"], best.get("mime_type")) if best else (text("url", "external_url"), None)
        guid = text("id", "url")
        if not guid and not inline:
            continue
        guid = guid or "urn:sha1:" + sha1(((text("title") or "") + inline[:500]).encode("utf-8", "replace")).hexdigest()
        out.append({"guid": guid, "title": text("title"), "url": urljoin(base, url) if url else None, "summary": text("summary"), "published": text("date_published", "date_modified"), "content_type": mime or None, "extensions": [x for x in (_extension(a["url"]) for a in files) if x], "inline_html": inline or None})
    return out


def feed_error(data: bytes | str | None) -> str | None:
    """Why a feed can't be read; null for one that can, with entries or without."""
    text = data.decode("utf-8", "replace") if isinstance(data, bytes | bytearray) else data or ""
    if not text.strip():
        return "empty document"
    if text.lstrip().startswith("{"):
        try:
            return None if isinstance(json.loads(text).get("items"), list) else "no items"
        except ValueError as e:
            return str(e)
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        return str(e)
    return None if _local(root.tag) in ("rss", "feed", "rdf") else "no feed"


def read_feed(data: bytes | str | None, base: str) -> list[dict]:
    """Entries of an RSS, Atom or JSON document; none if it can't be read (``feed_error`` says why)."""
    text = data.decode("utf-8", "replace") if isinstance(data, bytes | bytearray) else data or ""
    if text.lstrip().startswith("{"):
        return _json_entries(json.loads(text), base) if feed_error(text) is None else []
    try:
        root = ElementTree.fromstring(data or b"")
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        text: dict[str, list[str]] = {}
        links, enclosures = [], []
        for child in node:
            name, value = _local(child.tag), "".join(child.itertext()).strip()
            if name == "link" and child.get("href"):
                (enclosures if child.get("rel") == "enclosure" else links).append((child.get("href"), child.get("type") or ""))
            elif name == "link" and value:
                links.append((value, ""))
            elif name == "enclosure" and child.get("url"):
                enclosures.append((child.get("url"), child.get("type") or ""))
            elif value:
                text.setdefault(name, []).append(value)
        first = lambda *names: next((text[n][0] for n in names if text.get(n)), None)
        inline = ""
        for value in [*text.get("encoded", []), *text.get("content", []), first("summary", "description") or ""]:
            inline = value if len(value) > len(inline) else inline
        guid = first("id", "guid") or (links[0][0] if links else None)
        if not guid and not inline:
            continue
        guid = guid or "urn:sha1:" + sha1(((first("title") or "") + inline[:500]).encode("utf-8", "replace")).hexdigest()
        useful = [*EBOOKS, *COMICS, *DOCUMENTS, *AUDIO]
        ranked = [
            *[e for e in enclosures if _extension(e[0]) in useful or e[1].startswith(("audio/", "application/"))],
            *[x for x in links if _extension(x[0]) in useful],
            *links,
            *[e for e in enclosures if e[1].startswith("image/") or _extension(e[0]) in IMAGES],
            *enclosures,
        ]
        url, mime = ranked[0] if ranked else (None, None)
        out.append({"guid": guid, "title": first("title"), "url": urljoin(base, url) if url else None, "summary": first("summary", "description"), "published": first("published", "pubdate", "updated", "date"), "content_type": mime or None, "extensions": [x for x in (_extension(e[0]) for e in enclosures) if x], "inline_html": inline or None})
    return out


@vectorised(ENTRY_DDL)
def entries(xml: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([read_feed(x, b or "") for x, b in zip(xml, base, strict=True)])


@vectorised("string")
def errors(xml: pd.Series) -> pd.Series:
    return pd.Series([feed_error(x) for x in xml], dtype=object)


def feed_failures(payloads: DataFrame) -> DataFrame:
    """feed_id and error of the feeds that can't be read."""
    return payloads.select("feed_id", errors(F.col("xml")).alias("error")).filter("error IS NOT NULL")


def feed_entries(payloads: DataFrame) -> DataFrame:
    """payloads: feed_id, url, xml.  One row an entry with its position in the feed."""
    rows = payloads.select("feed_id", F.posexplode(entries(F.col("xml"), F.col("url"))).alias("position", "e"))
    return rows.select("feed_id", "position", "e.*")


def obtain(inline: Column, page_status: Column, page: Column) -> Column:
    """Where an article's text comes from: inline, page, inline_fallback or error.

    A long inline text without images has its page looked at for them; a page
    that fails or is thin leaves the inline text.
    """
    length = F.length(F.coalesce(inline, F.lit("")))
    long = length >= 1000
    has_image = lambda c: F.coalesce(c.rlike(r"(?i)<img\b"), F.lit(False))
    fine = F.coalesce(page_status == "ok", F.lit(False))
    thin = F.octet_length(F.coalesce(page, F.lit(""))) < F.greatest(F.lit(2000), F.floor(length * 0.4))
    return (
        F.when(long & has_image(inline), "inline")
        .when(long & fine & ~thin & has_image(page), "page")
        .when(long, "inline")
        .when(fine & ~(thin & (length > 0)), "page")
        .when(length > 0, "inline_fallback")
        .otherwise("error")
    )


def outcome(kind: Column, source: Column, known_hash: Column) -> Column:
    """Status and reason of an entry: audio first, then no source, then a known content."""
    made = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return F.when(kind == "podcast", made("skipped", "audio")).when(source == "error", made("error", "source")).when(known_hash, made("skipped", "duplicate")).otherwise(made("downloaded", ""))


def guid(entry_id: Column, guid_: Column, link: Column, title: Column, inline: Column) -> Column:
    """An entry's identity: id, guid, link, else a digest of title and inline text; null if it has nothing."""
    seed = F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(inline, F.lit("")), 1, 500))
    made = F.when(given(inline).isNotNull(), F.concat(F.lit("urn:sha1:"), F.sha1(F.encode(seed, "UTF-8"))))
    return F.coalesce(given(entry_id), given(guid_), given(link), made)
