"""Upkeep of the library: repairs with a report, expiry, schema growth, dimension rows, settings."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.files import media_type
from quillspark.functions.text import col, given, slugify
from quillspark.functions.udf import vectorised
from quillspark.functions.urls import AUDIO, IMAGES, WEB
from quillspark.operators import lifecycle
from quillspark.operators.lifecycle import at


def repair_media_types(books: DataFrame) -> DataFrame:
    """Books with the content type of their format; repaired tells a change."""
    right = media_type(F.col("format"), F.col("media_type"))
    return books.withColumn("repaired", ~right.eqNullSafe(F.col("media_type"))).withColumn("media_type", right)


def repair_report(**changed: DataFrame) -> DataFrame:
    """rule and fixed: how many rows each repair changed; frames with a boolean ``repaired``, or the changed rows alone."""
    def count(name: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(name).alias("rule"), (F.col("repaired") if "repaired" in frame.columns else F.lit(True)).cast("long").alias("n"))

    rules = reduce(DataFrame.unionByName, [count(n, f) for n, f in changed.items()])
    names = rules.sparkSession.createDataFrame([(n,) for n in changed], "rule string")
    return names.join(rules.groupBy("rule").agg(F.sum("n").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("fixed"))


def without_cover(books: DataFrame) -> DataFrame:
    """Books that have no cover, with the title and author that a made one shows."""
    return books.filter(F.col("cover_path").isNull()).select("id", F.coalesce(given("title"), F.lit("?")).alias("title"), F.coalesce(given("author"), F.lit("")).alias("author"))


def orphan_covers(covers: DataFrame, books: DataFrame) -> DataFrame:
    """Cover files that no book uses; a thumbnail (thumb_<stem>_<size>) goes with its cover."""
    used = books.filter(given("cover_path").isNotNull()).select(F.col("cover_path").alias("__used")).distinct()
    stems = used.select(F.regexp_replace("__used", r"\.[^.]*$", "").alias("__stem")).distinct()
    rest = covers.join(used, covers["name"] == used["__used"], "left_anti")
    owner = F.when(F.startswith(F.col("name"), F.lit("thumb_")), F.regexp_replace(F.substring("name", 7, 1 << 20), r"_[^_]*$", ""))
    return rest.withColumn("__owner", owner).join(stems, F.col("__owner") == F.col("__stem"), "left_anti").drop("__owner")


#: Addresses that lead out of a book.
OUTSIDE = ("http://", "https://", "data:", "mailto:", "#", "javascript:")
_REFERENCE = re.compile(r'\b(src|href)="([^"]+)"')
_PAGE = re.compile(r"\.x?html?$", re.I)


def mended(value: str, entry: str, names: set[str], base: str, anchors: dict[str, str]) -> str:
    """The reference as it must read in ``entry``: to the page that has the anchor, or to the file below the package's folder."""
    path, _, fragment = value.partition("#")
    if value.startswith(OUTSIDE) or not path:
        return value
    here, target = posixpath.dirname(entry), path.lstrip("/")
    if posixpath.normpath(posixpath.join(here, target)) in names:
        return value
    owner = anchors.get(fragment) if fragment else None
    if owner is not None:
        return f"#{fragment}" if owner == entry else f"{posixpath.relpath(owner, here)}#{fragment}"
    below = posixpath.normpath(posixpath.join(base, re.sub(r"^(\.\./)+", "", target)))
    if below not in names:
        return value
    return posixpath.relpath(below, here) + (f"#{fragment}" if fragment else "")


def mend_epub(data: bytes) -> bytes | None:
    """The book with its broken inner references mended; null if nothing was, or it is no EPUB."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        names = book.namelist()
        package = re.search(rb'full-path="([^"]+)"', book.read("META-INF/container.xml"))
        opf = package[1].decode("utf-8", "replace").lstrip("/") if package else ""
        if opf not in names:
            return None
        pages = {n: book.read(n) for n in names if _PAGE.search(n)}
        anchors: dict[str, str] = {}
        for name, raw in pages.items():
            for anchor in re.findall(rb'(?:id|name)="([^"]+)"', raw):
                anchors.setdefault(anchor.decode("utf-8", "replace"), name)
        every, base, fresh = set(names), posixpath.dirname(opf), {}
        for name, raw in pages.items():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            new = _REFERENCE.sub(lambda m, n=name: f'{m[1]}="{mended(m[2], n, every, base, anchors)}"', text)
            if new != text:
                fresh[name] = new.encode()
        if not fresh:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in book.infolist():
                z.writestr(info, fresh.get(info.filename) or book.read(info.filename), compress_type=info.compress_type)
        return out.getvalue()
    except (zipfile.BadZipFile, KeyError, OSError):
        return None


@vectorised("binary")
def repaired_epub(content: pd.Series) -> pd.Series:
    """Books whose references were mended, null for the others."""
    return content.map(lambda c: None if c is None else mend_epub(bytes(c)))


def expired(files: DataFrame, now: datetime, seconds: int = 3600) -> DataFrame:
    """Temporary files older than so many seconds."""
    return files.filter(F.col("modified_at") < at(now) - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def evolve(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The table with the columns that it lacks: name to (type, default)."""
    return table.select("*", *[F.lit(default).cast(kind).alias(name) for name, (kind, default) in columns.items() if name not in table.columns])


def create_or_get(dimension: DataFrame, names: DataFrame, by_slug: bool = True) -> DataFrame:
    """Dimension rows (id, name, slug) with one more for each new name; blank names make none.

    Names with equal slugs (or, for tags, equal names) are one row, the least name's.
    """
    key = "slug" if by_slug else "name"
    trimmed = names.select(F.trim("name").alias("name")).filter("name != ''").distinct().withColumn("slug", slugify("name"))
    fresh = trimmed.groupBy(key).agg(*[F.min(c).alias(c) for c in ("name", "slug") if c != key]).join(dimension.select(key), key, "left_anti")
    return dimension.select(F.col("id").cast("string").alias("id"), "name", "slug").unionByName(fresh.select(F.substring(F.sha2(F.col(key), 256), 1, 32).alias("id"), "name", "slug"))


def system_stats(books: DataFrame, feeds: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: books, feeds, bytes, and jobs by state as a map."""
    by_state = jobs.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("queue"))
    size = books.agg(F.count("*").alias("books"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    return size.join(feeds.agg(F.count("*").alias("feeds")), F.lit(True)).join(by_state, F.lit(True))


def setting(raw: Column | str, kind: str, default: object = None, least: float | None = None, most: float | None = None, choices: list[str] | None = None) -> Column:
    """Struct of a setting's value as text and whether it was refused: bool, choice, int, float or text.

    Numbers are held within their limits, a wrong one becomes the default; a
    wrong choice becomes the first.
    """
    text = F.trim(F.coalesce(col(raw).cast("string"), F.lit("")))
    if kind == "bool":
        value, bad = F.when(F.lower(text).isin("1", "true", "yes", "on", "sim"), "true").otherwise("false"), F.lit(False)
    elif kind == "choice":
        bad = ~F.lower(text).isin(*choices)
        value = F.when(bad, choices[0]).otherwise(F.lower(text))
    elif kind in ("int", "float"):
        number = F.when(text == "", F.lit("0")).otherwise(text).try_cast("bigint" if kind == "int" else "double")
        bad = number.isNull()
        held = number
        if least is not None:
            held = F.greatest(held, F.lit(least).cast("bigint" if kind == "int" else "double"))
        if most is not None:
            held = F.least(held, F.lit(most).cast("bigint" if kind == "int" else "double"))
        value = F.when(bad, F.lit(None if default is None else str(default))).otherwise(held.cast("string"))
    else:
        value, bad = text, F.lit(False)
    return F.struct(value.alias("value"), bad.alias("refused"))


def overlaid(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """key and value of the settings: the stored one where there is one."""
    s = stored.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    return defaults.join(s, defaults["key"] == s["__key"], "left").select("key", F.coalesce("__value", "value").alias("value"))


def merged_options(base: Column | str, extra: Column | str) -> Column:
    """Two JSON objects of options as a map; the second's values hold."""
    read = lambda c: F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(read(base), lambda k, v: ~F.array_contains(F.map_keys(read(extra)), k)), read(extra))


#: Types of a device profile's columns; other keys of a profile are ignored.
PROFILE_DDL = "slug string, name string, screen_width int, screen_height int, ppi int, preferred_format string, native_formats array<string>, comic_output string, reflow_text boolean, manga_rtl boolean, preserve_resolution boolean, notes string"


def profile(json: Column | str) -> Column:
    return F.from_json(col(json), PROFILE_DDL)


def can_open(native_formats: Column | str, fmt: Column | str) -> Column:
    return F.array_contains(F.transform(col(native_formats), lambda f: F.lower(f)), F.regexp_replace(F.lower(col(fmt)), r"^\.+", ""))


def screen_label(width: Column, height: Column, ppi: Column, whole: Column) -> Column:
    """The screen as width×height and density; any screen for a profile without one."""
    size = F.concat(width.cast("string"), F.lit("×"), height.cast("string"))
    none = F.coalesce(whole, F.lit(False)) | (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    return F.when(none, "qualquer tela").when(F.coalesce(ppi, F.lit(0)) == 0, size).otherwise(F.concat(size, F.lit(" · "), ppi.cast("string"), F.lit(" ppi")))


def maintenance(tables: dict[str, DataFrame], now: datetime, cleanup_days: int | None = None) -> dict[str, DataFrame]:
    """One pass of upkeep over the tables: what each step leaves, and a report (rule, fixed).

    tables: jobs, events, books, files (path), temp (modified_at), and for
    retention feeds, feed_items and records.  Steps are those of the periodic
    run: jobs whose heart stopped are pending again, attempts that hang are
    interrupted, missing files are marked, old temporary files and idle
    downloads are named.
    """
    stale = tables["jobs"].filter("status = 'running'").join(lifecycle.requeue_stale(tables["jobs"], now, 1800).filter("status = 'running'").select("id"), "id", "left_anti")
    marked = lifecycle.mark_missing(tables["books"], tables["files"])
    recovered = lifecycle.recover(tables["events"], now, 21_600)
    stuck = tables["events"].filter("status = 'started'").join(recovered.filter("status = 'started'").select("event_id"), "event_id", "left_anti")
    temp = expired(tables["temp"], now)
    out = {"jobs": lifecycle.requeue_stale(tables["jobs"], now, 1800), "books": marked.drop("flipped"), "events": recovered, "temp": temp}
    changed = {"temp_removed": temp, "resumed": stale.select("id"), "missing": marked.filter("missing").select("id"), "stuck_downloads": stuck.select("event_id")}
    if "feeds" in tables:
        out["retention"] = changed["feed_retention"] = lifecycle.feed_retention(tables["feeds"], tables["feed_items"], tables["books"], tables["records"], tables["jobs"], now)
    if cleanup_days is not None:
        out["cleanup"] = changed["downloads_cleaned"] = lifecycle.cleanup_candidates(tables["records"], tables["books"], now, cleanup_days)
    out["report"] = repair_report(**{name: frame.select(F.lit(1)) for name, frame in changed.items()})
    return out


#: Who reads a format, the first that names it.
READERS = [
    ("epub", ["epub", "kepub"]),
    ("pdf", ["pdf"]),
    ("comic", ["cbz", "cbt", "cbr", "cb7", "zip", "rar", "7z"]),
    ("image", IMAGES),
    ("text", ["txt"]),
    ("fb2", ["fb2"]),
    ("markup", WEB),
    ("native_convert", ["mobi", "azw", "azw3", "pdb", "prc", "docx", "rtf"]),
    ("calibre", ["lit"]),
    ("audio", AUDIO),
    ("document", ["djvu", "djv"]),
]


def reader_of(fmt: Column | str) -> Column:
    """The reader that opens a format; null if none does."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(fmt), F.lit(""))), r"^\.+", "")
    return F.coalesce(*[F.when(plain.isin(*formats), name) for name, formats in READERS])
