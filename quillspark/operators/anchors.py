"""Links between the chapters of split pages: which chapter owns an anchor, and what becomes of each link.

Tags are told by one pattern and stay in the JVM; anchors form an inverted
index, so that a link finds its owner by a join and not by a search through the
chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.urls import resolve, without_fragment

#: A tag with its quoted values, a comment, or a script or style with what is in it.
TAG = r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z](?:[^<>"']|"[^"]*"|'[^']*')*>"""
#: Fixed value: the file name of a chapter.
FILE = "chapter_%04d.xhtml#%s"


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, null without it; quotes may be of either kind or absent."""
    found = lambda k: F.regexp_extract(tag, rf"""(?is)^<[a-z](?:[^<>"']|"[^"]*"|'[^']*')*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""", k)
    value = F.concat(found(1), found(2), found(3))
    for entity, letter in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(letter))
    return F.when(tag.rlike(rf"""(?is)^<[a-z](?:[^<>"']|"[^"]*"|'[^']*')*?\s{name}\s*=\s*["']?[^\s]"""), value)


def _tags(chapters: DataFrame) -> DataFrame:
    """doc, chapter, place and tag of every opening tag with an attribute that counts."""
    every = chapters.select("doc", "chapter", "page_url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))).alias("place", "tag"))
    return every.filter(F.col("tag").rlike(r"(?is)^<[a-z][^>]*\s(?:id|name|href)\s*="))


def owners(chapters: DataFrame) -> DataFrame:
    """doc, anchor and owner: the first chapter with an element of that id, or a link of that name."""
    tag = F.col("tag")
    names = F.array(attribute(tag, "id"), F.when(tag.rlike(r"(?i)^<a\s"), attribute(tag, "name")))
    every = _tags(chapters).select("doc", "chapter", F.explode(names).alias("anchor")).filter("anchor != ''")
    return every.groupBy("doc", "anchor").agg(F.min("chapter").alias("owner"))


def anchor_links(chapters: DataFrame) -> DataFrame:
    """doc, chapter, place, href, kind and target of every link of the chapters (doc, chapter from 0, page_url, html).

    An address on another page is absolute (kind ``address``).  A link into its
    own page is ``kept`` where its chapter owns the anchor, ``moved`` to the
    first chapter that does, or ``broken`` (target null) where none does.
    ``place`` counts the chapter's tags, comments and scripts.
    """
    tag = F.col("tag")
    links = _tags(chapters).filter(tag.rlike(r"(?i)^<a\s")).select("doc", "chapter", "page_url", "place", attribute(tag, "href").alias("href")).filter("href IS NOT NULL")
    placed = links.withColumn("address", resolve("page_url", "href"))
    fragment = F.regexp_extract("address", r"^[^#]*#(.*)$", 1)
    own = (without_fragment("address") == without_fragment("page_url")) & ((fragment != "") | F.startswith(F.col("href"), F.lit("#")))
    told = placed.withColumn("anchor", F.when(own, F.replace(fragment, F.lit('"'), F.lit(""))))
    # links without an anchor have no owner to look for
    away = told.filter("anchor IS NULL").select("doc", "chapter", "place", "href", F.lit("address").alias("kind"), F.col("address").alias("target"))
    here = told.filter("anchor IS NOT NULL").join(owners(chapters), ["doc", "anchor"], "left")
    kind = F.when(F.col("owner").isNull(), "broken").when(F.col("owner") == F.col("chapter"), "kept").otherwise("moved")
    target = F.when(kind == "kept", F.concat(F.lit("#"), "anchor")).when(kind == "moved", F.format_string(FILE, F.col("owner") + 1, F.col("anchor")))
    return away.unionByName(here.select("doc", "chapter", "place", "href", kind.alias("kind"), target.alias("target")))


def _escaped(value: Column) -> Column:
    for letter, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(letter), F.lit(entity))
    return value


def relinked(chapters: DataFrame) -> DataFrame:
    """The chapters with html whose links lead where ``anchor_links`` says.

    Addresses on the web open apart; a broken link becomes a span round its
    text.  Other tags and all text stay letter by letter.
    """
    links = anchor_links(chapters).groupBy("doc", "chapter").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("kind", "target")))).alias("links"))
    cut = chapters.join(links, ["doc", "chapter"], "left")
    html = F.coalesce("html", F.lit(""))
    both = F.array(F.struct(F.split(html, TAG).alias("texts"), F.regexp_extract_all(html, F.lit(TAG), F.lit(0)).alias("tags"), F.coalesce("links", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<kind:string,target:string>>"))).alias("links")))

    def opened(tag: Column, link: Column) -> Column:
        bare = F.regexp_replace(tag, r"""(?is)\s(?:href|target)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+)""", "")
        apart = F.when(link["target"].rlike("^https?://"), ' target="_blank"').otherwise("")
        return F.concat(F.lit('<a href="'), _escaped(link["target"]), F.lit('"'), apart, F.substring(bare, F.lit(3), F.char_length(bare)))

    def step(state: Column, tag: Column, link: Column) -> Column:
        """state: the tags so far, and whether a span is open in place of a link."""
        broken = link["kind"] == "broken"
        closes = state["span"] & tag.rlike("(?i)^</a")
        new = F.when(broken, "<span>").when(link["kind"].isNotNull(), opened(tag, link)).when(closes, "</span>").otherwise(tag)
        span = F.when(broken, True).when(closes | link["kind"].isNotNull(), False).otherwise(state["span"])
        return F.struct(F.concat(state["tags"], F.array(new)).alias("tags"), span.alias("span"))

    def rebuilt(x: Column) -> Column:
        each = F.transform(x["tags"], lambda t, i: F.struct(t.alias("tag"), F.try_element_at(x["links"], i).alias("link")))
        start = F.struct(F.array().cast("array<string>").alias("tags"), F.lit(False).alias("span"))
        tags = F.aggregate(each, start, lambda s, e: step(s, e["tag"], e["link"]), lambda s: s["tags"])
        return F.array_join(F.zip_with(x["texts"], tags, lambda text, t: F.concat(F.coalesce(text, F.lit("")), F.coalesce(t, F.lit("")))), "")

    new = F.when(F.col("links").isNull(), F.col("html")).otherwise(F.get(F.transform(both, rebuilt), F.lit(0)))
    return cut.withColumn("html", new).select(*chapters.columns)
