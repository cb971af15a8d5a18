"""Files into the catalog: what is known of each from its name and from what it carries, its outcome, and its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import files as formats
from quillspark.functions.text import given
from quillspark.operators.reports import import_outcomes

#: What a file may carry about itself.
CARRIED = ["title", "author", "series", "series_index", "publisher", "language", "description", "isbn", "page_count", "subject", "age_rating", "reading_direction", "genre"]
MERGED = ["title", "author", "series", "series_index", "published", "publisher", "language", "description", "isbn", "page_count", "reading_direction", "age_rating", "tags"]


def merged_metadata(files: DataFrame, carried: DataFrame) -> DataFrame:
    """files (file_id, stem, format, comic) with what their names and the files themselves (file_id and CARRIED) tell, field by field.

    What a file carries comes before what its name suggests, a blank is nothing
    and so is a number 0.  An EPUB gives its own fields; a PDF title, author and
    subject, without placeholders; a comic archive all fields, its genres as
    tags, and reads from right to left unless it says otherwise.  Other files
    tell nothing; their title is the name's.
    """
    own = carried.select("file_id", F.struct(*[F.col(c) for c in CARRIED]).alias("own"))
    rows = files.join(own, "file_id", "left").withColumn("name", formats.parse_name("stem"))
    kind = F.lower("format")
    epub, pdf, archive = kind == "epub", kind == "pdf", kind.isin("cbz", "zip") & F.coalesce("comic", F.lit(False))
    comic, image = F.coalesce("comic", F.lit(False)) & ~epub & ~pdf, formats.content_type("format") == "image"
    said = {c: given(F.col(f"own.{c}")) for c in ("title", "author", "series", "publisher", "language", "description", "isbn", "subject", "age_rating", "reading_direction", "genre")}
    number = F.nullif(F.col("own.series_index"), F.lit(0.0))
    read = epub | archive

    def first(carried_value: Column, when: Column, otherwise: Column) -> Column:
        return F.coalesce(F.when(when, carried_value), otherwise)

    none = F.lit(None).cast("string")
    title = first(said["title"], read, first(formats.placeholder_free("own.title"), pdf, F.coalesce("name.title", "stem")))
    author = first(said["author"], read, first(formats.placeholder_free("own.author"), pdf, F.col("name.author")))
    genres = F.filter(F.transform(F.split(said["genre"], ","), lambda g: F.trim(g)), lambda g: g != "")
    direction = F.when(archive, F.coalesce(said["reading_direction"], F.lit("rtl"))).when(comic, "rtl").when(image, "ltr")
    return rows.select(
        *files.columns, title.alias("title"), author.alias("author"), first(said["series"], read, F.col("name.series")).alias("series"), first(number, read, F.col("name.series_index")).alias("series_index"),
        F.col("name.published").alias("published"), F.when(read, said["publisher"]).alias("publisher"), F.when(read, said["language"]).alias("language"),
        F.when(read, said["description"]).when(pdf, said["subject"]).otherwise(none).alias("description"), F.when(epub, formats.isbn("own.isbn")).alias("isbn"),
        F.when(epub | pdf | archive, F.nullif(F.col("own.page_count"), F.lit(0))).alias("page_count"), direction.alias("reading_direction"), F.when(archive, said["age_rating"]).alias("age_rating"),
        F.coalesce(F.when(archive, genres), F.array().cast("array<string>")).alias("tags"),
    )


def catalog_rows(merged: DataFrame) -> DataFrame:
    """Rows of new books: the sort title is the title in lower case, comics read from right to left by default."""
    kind = F.when(F.coalesce("comic", F.lit(False)), "comic").otherwise(formats.content_type("format"))
    rest = [c for c in merged.columns if c not in ("reading_direction", "comic")]
    direction = F.coalesce("reading_direction", F.when(kind == "comic", "rtl").otherwise("ltr"))
    return merged.select(*rest, kind.alias("content_type"), F.lower("title").alias("sort_title"), direction.alias("reading_direction"), formats.media_type("format").alias("media_type"), formats.metadata_name("title", "author", "series", "series_index").alias("stored_name"))


def import_files(files: DataFrame, carried: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcome of each file (file_id, stem, format, comic, content_hash, readable), and the catalog rows of those imported.

    Unsupported files are skipped, unreadable ones fail, and of equal contents,
    here or in the catalog (content_hash), one is kept.
    """
    judged = import_outcomes(files, catalog, formats.supported("format"), ~F.coalesce("readable", F.lit(False)))
    new = judged.filter("outcome = 'imported'").select("file_id", "stem", "format", "comic", "content_hash")
    return judged, catalog_rows(merged_metadata(new, carried))
