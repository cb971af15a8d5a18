"""Addresses: normal forms, file names, posts, sitemap places, audio and file tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import col, given

#: File extensions by what they hold.
AUDIO = ["mp3", "m4b", "m4a", "flac", "ogg", "opus", "aac"]
IMAGES = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "avif", "heic"]
EBOOKS = ["epub", "mobi", "azw", "azw3", "fb2", "txt", "docx", "rtf", "lit", "pdb", "prc"]
COMICS = ["cbz", "cbr", "cb7", "cbt", "zip", "rar", "7z"]
DOCUMENTS = ["pdf", "djvu", "djv"]
WEB = ["html", "htm", "xhtml"]


def normal_form(url: Column | str) -> Column:
    """Authority in lower case without www., and path without slashes at its end; '' if there is neither."""
    u = F.trim(col(url))
    authority = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
    return F.concat(authority, F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", ""))


def file_name(url: Column | str) -> Column:
    """Last path segment, unquoted; download.bin where there is none."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.coalesce(given(F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))), F.lit("download.bin"))


def path_extension(url: Column | str) -> Column:
    """Lower-case extension of the path, '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), r"\.([A-Za-z0-9]{1,5})$", 1))


def is_file(url: Column | str) -> Column:
    return path_extension(url).isin(*EBOOKS, *COMICS, *DOCUMENTS, *AUDIO)


def is_audio(mime: Column | str, extensions: Column | str) -> Column:
    return F.coalesce(F.startswith(col(mime), F.lit("audio/")), F.lit(False)) | F.coalesce(F.arrays_overlap(col(extensions), F.array(*map(F.lit, AUDIO))), F.lit(False))


def post_parts(url: Column | str) -> Column:
    """Year, month, day and slug of /YYYY/MM/DD/slug; null for anything else, page, index and digits included."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "/+$", "")
    # single-valued lists bind the path and its parts once: each use would parse the address again
    parts = F.transform(F.array(path), lambda p: F.array(*[F.regexp_extract(p, r"/(\d{4})/(\d{1,2})/(\d{1,2})/([^/]+)$", k) for k in (1, 2, 3, 4)]))

    def post(p: Column) -> Column:
        slug = F.get(p, F.lit(3))
        fine = (slug != "") & ~slug.isin("page", "index") & ~slug.rlike(r"^\d+$")
        return F.when(fine, F.struct(*[F.get(p, F.lit(k)).try_cast("int").alias(n) for k, n in enumerate(("year", "month", "day"))], slug.alias("slug")))

    return F.get(F.transform(parts, post), F.lit(0))


def slug_title(slug: Column | str, limit: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.url_decode(F.replace(col(slug), F.lit("+"), F.lit("%2B"))), "[-_]+", " ")), 1, limit)


def sitemap_places(feed_url: Column | str, override: Column | str | None = None) -> Column:
    """Where to look for a sitemap: the override alone, or three usual places; none without a host."""
    u = col(feed_url)
    root = F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("AUTHORITY")))
    usual = F.when(root.isNotNull(), F.array(*[F.concat(root, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")])).otherwise(F.array().cast("array<string>"))
    return usual if override is None else F.when(given(override).isNotNull(), F.array(override)).otherwise(usual)


def extension_for(mime: Column | str, current: Column | str) -> Column:
    """The extension that a content type implies where the name has none or bin."""
    #: Extension by content type.
    known = {"application/epub+zip": "epub", "application/pdf": "pdf", "application/zip": "zip", "text/html": "html", "application/xhtml+xml": "html", "text/plain": "txt", "image/jpeg": "jpg", "image/png": "png", "audio/mpeg": "mp3", "application/x-mobipocket-ebook": "mobi"}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    bare = F.lower(F.trim(F.element_at(F.split(col(mime), ";"), 1)))
    return F.when(given(current).isNull() | (col(current) == "bin"), F.coalesce(F.try_element_at(table, bare), F.coalesce(col(current), F.lit("")))).otherwise(col(current))


#: Leading parts of content types and the kind that they tell, tried in this order.
KINDS = [
    (["application/pdf"], "pdf"),
    (["application/epub", "application/x-mobipocket", "application/vnd.amazon"], "ebook"),
    (["image/"], "image"),
    (["application/zip", "application/x-cbz", "application/vnd.comicbook"], "comic"),
]


def kind(mime: Column | str, extensions: Column | str) -> Column:
    """What an entry is: podcast, pdf, ebook, image, comic, file or article."""
    m = F.lower(F.coalesce(col(mime), F.lit("")))
    starts = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.startswith(m, p))
    out = F.when(is_audio(m, extensions), "podcast")
    for parts, name in KINDS:
        out = out.when(starts(parts), name)
    return out.when((m != "") & ~starts(["text/html", "application/xhtml"]), "file").otherwise("article")


def without_fragment(url: Column | str) -> Column:
    return F.substring_index(col(url), "#", 1)


def _undotted(path: Column, joined: bool) -> Column:
    """A path from the root without . and ..; of joined paths the empty parts go too, but the last."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(parts, -1)
    pop = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))

    def step(kept: Column, part: Column) -> Column:
        skipped = part.isin(".", "") if joined else part == "."
        return F.when(part == "..", pop(kept)).when(skipped, kept).otherwise(F.concat(kept, F.array(part)))

    before = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<string>"), step)
    whole = F.when(last == "..", F.concat(pop(before), F.array(F.lit("")))).when(last == ".", F.concat(before, F.array(F.lit("")))).otherwise(F.concat(before, F.array(last)))
    return F.concat(F.lit("/"), F.array_join(whole, "/"))


def resolve(base: Column | str, href: Column | str) -> Column:
    """The address that ``href`` names on the page at ``base``, an http address."""
    base, href = col(base), F.coalesce(col(href), F.lit(""))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    place = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    ours, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(place, r"[^/]*$", "")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), href))
        .when(F.startswith(href, F.lit("#")), F.concat(without_fragment(base), href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, place, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _undotted(ours, False), rest))
        .otherwise(F.concat(root, _undotted(F.concat(F.when(folder == "", "/").otherwise(folder), ours), True), rest))
    )
