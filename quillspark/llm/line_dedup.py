"""Line deduplication by sorted hashes; only DataFrame functions.

Each line's key becomes a pair of 64-bit hashes.  The hashes are dealt out by
range of (hash, document), so a line that stands in a third of all documents is
spread over many tasks, and are sorted by document and place within.  Reading a
task's lines in that order, the first line of each (hash, document) is the
document's first occurrence; these are counted.  What a hash takes from a
document is a bitmap of its lines, 64 to a word, of which only the words that
lose a line are kept.  Only hashes and bitmaps are sorted and counted: a text
moves once, to its own bitmap.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import session, stage, unstage

#: A key in this many documents is repeated.
MIN_DOCS = 10
#: Repeated keys that are broadcast (24 bytes each); of more, only those in the most documents.
MAX_BROADCAST_KEYS = 1 << 19
_BLANK = " \t\n\x0b\x0c\r"
_WHO = ["none", "who"]
_ROW = [*_WHO, "version"]
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_BLANK))
    # an ASCII line has as many characters as bytes
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text; none and who name the document, version its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("version", F.xxhash64("text"))
    return rows.select("doc_id", "text", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "version").alias("who"), "version")


def _marks(rows: DataFrame) -> DataFrame:
    """Per hash and document: bitmap words of the lines, and which holds the document's first occurrence."""
    lines = rows.select(*_ROW, F.posexplode(F.split("text", "\n")).alias("place", "line")).select(*_ROW, "place", line_key(F.col("line")).alias("key"))
    # two hashes of different seeds: neither follows from the other
    hashed = lines.filter("key != ''").select(*_ROW, "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    order = [*_KEY, *_WHO, "version", "place"]
    ranged = hashed.repartitionByRange(*_KEY, *_WHO).sortWithinPartitions(*order)
    first = F.row_number().over(Window.partitionBy(*_KEY, *_WHO).orderBy("version", "place")) == 1
    bit = F.expr("shiftleft(1L, place & 63)")
    return ranged.withColumn("first", first).groupBy(*_KEY, *_ROW, F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.max("first").alias("first"))


def _of_repeated(marks: DataFrame, repeated: DataFrame, limit: int) -> DataFrame:
    """The marks of repeated keys: keys of very many documents are broadcast, the rest joined."""
    n, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if n <= limit:
        return marks.join(F.broadcast(repeated.select(*_KEY)), _KEY, "left_semi")
    # at most ``limit`` keys can be in more documents than this
    often = F.col("n_docs") > total // limit
    heavy = F.broadcast(repeated.filter(often).select(*_KEY))
    light = repeated.filter(~often).select(*_KEY)
    return marks.join(heavy, _KEY, "left_semi").unionByName(marks.join(heavy, _KEY, "left_anti").join(light, _KEY, "left_semi"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """none, who, version, n_dropped and ``keep`` of every text that loses a line.

    ``keep`` lists (word, bits): bit b of word w is 0 where line 64 w + b goes;
    a word that is not listed keeps all its lines.
    """
    marks = stage(_marks(_rows(docs)), "marks")
    repeated = stage(marks.filter("first").groupBy(*_KEY).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs), "repeated")
    words = _of_repeated(marks, repeated, max_broadcast).groupBy(*_ROW, "word").agg(F.bit_or("bits").alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("bits"))
    bitmaps = stage(words.groupBy(*_ROW).agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(entry)).alias("keep")), "bitmaps")
    unstage(marks)
    unstage(repeated)
    return bitmaps


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps."""
    lines = F.split(text, "\n")
    by_word = F.map_from_entries(keep)
    # one word per 64 lines, so that each line finds its own by place
    dense = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")))

    def stays(words: Column, place: Column) -> Column:
        bit = F.call_function("shiftright", F.get(words, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63)))
        return bit.bitwiseAND(F.lit(1)) == 1

    # an array of one: the lambda holds lines and words, so that neither is made again for each line
    both = F.array(F.struct(lines.alias("lines"), dense.alias("words")))
    kept = F.transform(both, lambda x: F.filter(x["lines"], lambda _, place: stays(x["words"], place)))
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep and kept of every text: lines in ``min_docs`` documents or more go.

    Null or empty text is one empty line, and lines without a key stay.  Rows
    that share a doc_id are one document; without a doc_id equal texts are one.
    Each row loses its own lines.  An empty table gives no rows.
    """
    session(docs)
    bitmaps = keep_bitmaps(docs, min_docs, max_broadcast)
    joined = _rows(docs).join(bitmaps.hint("shuffle_hash"), _ROW, "left")
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep")))
    out = joined.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"), "keep")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "keep", "kept")
