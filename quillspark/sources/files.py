"""Files: a folder as rows, their first bytes, text decoding, EPUB and archive contents."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.files import extension, resolve, supported
from quillspark.functions.udf import vectorised

#: Names that operating systems leave behind.
JUNK = ["thumbs.db", "desktop.ini", ".ds_store"]
BOOK_DDL = "title string, author string, language string, publisher string, description string, spine int, image_only boolean"


def scan(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Supported files below a folder, without dot files and junk; contents only if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), "length", "modificationTime", *(["content"] if content else [])).withColumn("ext", extension("name"))
    return out.filter(~F.startswith("name", F.lit(".")) & ~F.lower("name").isin(*JUNK) & supported("ext"))


def detect(files: DataFrame) -> DataFrame:
    """Files with format and corrected, from extension and first bytes."""
    return files.withColumn("detected", resolve("ext", F.substring("content", 1, 4096))).select("*", "detected.*").drop("detected")


def _windows() -> tuple[str, str]:
    """The characters that Latin-1 has for 0x80 to 0x9F, and those of Windows-1252, where it has any."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where that is valid, else Windows-1252; without a byte order mark."""
    narrow = F.translate(F.decode(content, "ISO-8859-1"), *_windows())
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(narrow)
    return F.regexp_replace(text, "^﻿", "")


@vectorised("array<string>")
def archive_images(content: pd.Series) -> pd.Series:
    """Names of the images in a ZIP archive in natural order; null for what is no archive."""
    def names(data):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                found = [n for n in z.namelist() if re.search(r"\.(jpe?g|png|gif|bmp|webp|tiff?|avif)$", n, re.I)]
        except (zipfile.BadZipFile, TypeError):
            return None
        return sorted(found, key=lambda n: [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", n) if p])

    return content.map(names)


def read_epub(data: bytes) -> dict:
    """Metadata of an EPUB's package document; blank where there is none."""
    blank = {"title": None, "author": None, "language": None, "publisher": None, "description": None, "spine": 0, "image_only": False}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            path = next(n.get("full-path") for n in container.iter() if n.tag.endswith("rootfile"))
            package = ElementTree.fromstring(z.read(path))
            texts = {}
            for n in package.iter():
                name = n.tag.rsplit("}", 1)[-1]
                if name in ("title", "creator", "language", "publisher", "description") and (n.text or "").strip():
                    texts.setdefault(name, n.text.strip())
            spine = sum(n.tag.endswith("itemref") for n in package.iter())
            pages = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
            bodies = [re.sub(rb"(?s)<head.*?</head>|<[^>]+>|\s+", b"", z.read(n)) for n in pages[:20]]
            images = sum(b"<img" in z.read(n) or b"<image" in z.read(n) for n in pages[:20])
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError):
        return blank
    return {"title": texts.get("title"), "author": texts.get("creator"), "language": texts.get("language"), "publisher": texts.get("publisher"), "description": texts.get("description"), "spine": spine, "image_only": bool(pages) and images > 0 and sum(map(len, bodies)) < 40 * len(bodies)}


@vectorised(BOOK_DDL)
def epub_metadata(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_epub(c) for c in content], columns=["title", "author", "language", "publisher", "description", "spine", "image_only"], dtype=object)


def write_epub(title: str, author: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A small EPUB 3 of XHTML chapters."""
    out = io.BytesIO()
    x = lambda s: (s or "").replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        z.writestr("book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{x(title)}</dc:identifier><dc:title>{x(title)}</dc:title><dc:creator>{x(author)}</dc:creator><dc:language>{x(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>')
        nav = "".join(f'<li><a href="c{i}.xhtml">{x(t)}</a></li>' for i, (t, _) in enumerate(chapters))
        z.writestr("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{x(title)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        for i, (t, body) in enumerate(chapters):
            z.writestr(f"c{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{x(t)}</title></head><body><h1>{x(t)}</h1>{body}</body></html>')
    return out.getvalue()


@vectorised("binary")
def epub(title: pd.Series, author: pd.Series, language: pd.Series, chapters: pd.Series) -> pd.Series:
    return pd.Series([write_epub(t, a, g, [(c["title"], c["body"]) for c in (cs if isinstance(cs, list | np.ndarray) else [])]) for t, a, g, cs in zip(title, author, language, chapters, strict=True)])


def chapters_text(chapters: Column) -> Column:
    """Plain text of chapters: titles and bodies without markup."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c["body"], r"(?i)</(p|div|h\d|li)>", "\n"), "<[^>]+>", ""))
    return F.array_join(F.transform(chapters, lambda c: F.concat_ws("\n\n", c["title"], bare(c))), "\n\n")
