"""Whole conversions to EPUB: web pages, plain text and FictionBooks, one row in and one book out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import chapters, html
from quillspark.functions.text import given
from quillspark.functions.udf import spread
from quillspark.sources import books, files, office


def _made(title: Column, author: Column, language: Column, parts: Column) -> Column:
    return files.epub(title, F.coalesce(author, F.lit("")), F.coalesce(given(language), F.lit("en")), parts)


def pages_to_epub(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, author, tags, images and epub of web pages (html, url): cleaned, split and written."""
    read = spread(pages).select(key, html.page(F.col("html"), F.col("url")).alias("p"))
    return read.select(key, F.col("p.title").alias("title"), F.col("p.author").alias("author"), F.col("p.tags").alias("tags"), F.col("p.images").alias("images"), _made(F.col("p.title"), F.col("p.author"), F.col("p.language"), F.col("p.chapters")).alias("epub"))


def texts_to_epub(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, title and epub of plain texts (text, title, author, language): chapters by their headings."""
    parts = chapters.plain_chapters(F.col("text"))
    return texts.select(key, "title", _made(F.col("title"), F.col("author"), F.col("language"), parts).alias("epub"))


def fictionbooks_to_epub(content: DataFrame, key: str = "id") -> DataFrame:
    """key, title, author and epub of FictionBooks (content); null epub where the bytes are none."""
    read = content.select(key, books.fictionbook(F.col("content")).alias("b"))
    whole = _made(F.coalesce(F.col("b.title"), F.lit("?")), F.col("b.author"), F.col("b.language"), F.col("b.chapters"))
    return read.select(key, F.col("b.title").alias("title"), F.col("b.author").alias("author"), F.when(F.col("b.chapters").isNotNull(), whole).alias("epub"))


def docx_to_epub(content: DataFrame, key: str = "id") -> DataFrame:
    """key, title, author and epub of DOCX files (content); null epub where the bytes are none."""
    read = content.select(key, office.docx(F.col("content")).alias("d"))
    whole = _made(F.coalesce(F.col("d.title"), F.lit("?")), F.col("d.author"), F.col("d.language"), F.col("d.chapters"))
    return read.select(key, F.col("d.title").alias("title"), F.col("d.author").alias("author"), F.when(F.col("d.chapters").isNotNull(), whole).alias("epub"))


def rtf_to_epub(content: DataFrame, key: str = "id") -> DataFrame:
    """key, title and epub of RTF files (content, title, author, language): chapters by their headings."""
    return texts_to_epub(content.withColumn("text", office.rtf(F.col("content"))), key)


def chapters_to_docx(books_: DataFrame, key: str = "id") -> DataFrame:
    """key and docx of books (title, author, chapters)."""
    return books_.select(key, office.docx_file(F.col("title"), F.col("author"), F.col("chapters")).alias("docx"))
