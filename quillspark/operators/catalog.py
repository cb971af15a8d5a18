"""Catalog: search, pages, facets, variants and visibility."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import col, contains, given

#: States that hide a file from the catalog.
HIDDEN = ["blocked", "deleted"]
#: Formats in the order in which variants are offered.
FORMAT_ORDER = ["epub", "azw3", "mobi", "pdf", "cbz", "cbr", "fb2", "docx", "txt"]

_SORTS: dict[str, list[tuple[str, bool]]] = {
    "added_desc": [("added_at", False)],
    "added_asc": [("added_at", True)],
    "title": [("lower(title)", True)],
    "title_asc": [("lower(title)", True)],
    "title_desc": [("lower(title)", False)],
    "author": [("lower(author)", True), ("series_index", True)],
    "author_asc": [("lower(author)", True), ("series_index", True)],
    "size_desc": [("file_size", False)],
}


@dataclass(frozen=True)
class BookQuery:
    """What to search for; empty, zero and None values do not filter."""

    q: str = ""
    category_id: int | None = None
    author: str | None = None
    series: str | None = None
    content_type: str | None = None
    format: str | None = None
    source: str | None = None
    tag: str | None = None
    exclude_states: tuple[str, ...] = ()
    collapse_variants: bool = False
    sort: str = "added_desc"
    page: int = 1
    per_page: int = 40
    columns: tuple[str, ...] = field(default=("title", "author", "series", "description"))

    def normalized(self) -> BookQuery:
        return replace(self, page=max(1, self.page or 1), per_page=min(200, max(1, self.per_page or 1)), sort=self.sort if self.sort in _SORTS else "added_desc")


def order_of(sort: str) -> list[Column]:
    """Columns of a named sort; the id breaks ties, nulls come first upwards."""
    return [F.expr(e).asc() if up else F.expr(e).desc() for e, up in _SORTS[sort]] + [F.col("id").asc()]


def collapse_variants(books: DataFrame) -> DataFrame:
    """Books without an origin, originals, and those whose origin is gone."""
    derived = F.col("b.origin_book_id").isNotNull() & ~F.coalesce(F.col("b.is_original"), F.lit(False))
    return books.alias("b").join(books.select(F.col("id").alias("__origin")).alias("o"), derived & (F.col("b.origin_book_id") == F.col("o.__origin")), "left_anti")


def hide_states(books: DataFrame, records: DataFrame, states: list[str] = HIDDEN, key: str = "id") -> DataFrame:
    """Books without a record in one of the states; a book without any record is offered."""
    hidden = records.filter(F.col("state").isin(*states) & F.col("book_id").isNotNull()).select(F.col("book_id").alias("__hidden"))
    return books.join(hidden, books[key] == hidden["__hidden"], "left_anti")


def with_tag(books: DataFrame, book_tags: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    tagged = book_tags.join(tags.filter(F.col("name") == name), book_tags["tag_id"] == tags["id"], "left_semi").select(F.col("book_id").alias("__tagged"))
    return books.join(tagged, books["id"] == tagged["__tagged"], "left_semi")


def search(books: DataFrame, query: BookQuery, records: DataFrame | None = None, book_tags: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """All books that match; no order, no page."""
    query = query.normalized()
    out = books
    if query.q and query.q.strip():
        out = out.filter(contains([c for c in query.columns if c in books.columns], query.q))
    for name in ("category_id", "author", "series", "content_type", "format", "source"):
        value = getattr(query, name)
        if value:
            out = out.filter(F.col(name) == value)
    if query.tag and book_tags is not None and tags is not None:
        out = with_tag(out, book_tags, tags, query.tag)
    if query.exclude_states and records is not None:
        out = hide_states(out, records, list(query.exclude_states))
    if query.collapse_variants:
        derived = F.col("origin_book_id").isNotNull() & ~F.coalesce(F.col("is_original"), F.lit(False))
        origins = books.select(F.col("id").alias("__origin"))
        out = out.join(origins, derived & (F.col("origin_book_id") == origins["__origin"]), "left_anti")
    return out


def recent(books: DataFrame, n: int) -> DataFrame:
    """The n books that came last."""
    return books.orderBy(*order_of("added_desc")).limit(n)


def page(found: DataFrame, query: BookQuery) -> tuple[DataFrame, DataFrame]:
    """The page's rows, and one row of total, pages, has_prev and has_next."""
    query = query.normalized()
    rows = found.orderBy(*order_of(query.sort)).offset((query.page - 1) * query.per_page).limit(query.per_page)
    pages = F.greatest(F.lit(1), F.ceil(F.count("*") / query.per_page)).cast("long")
    totals = found.agg(F.count("*").alias("total"), pages.alias("pages"))
    return rows, totals.select("total", "pages", F.lit(query.page > 1).alias("has_prev"), (F.lit(query.page) < F.col("pages")).alias("has_next"))


def facet(books: DataFrame, name: str, limit: int | None = 500) -> DataFrame:
    """Books by a column's values, without nulls, by lower-case value."""
    out = books.filter(col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("books"))
    return out if limit is None else out.orderBy(F.lower("value"), "value").limit(limit)


def histogram(books: DataFrame, name: str, absent: str = "unknown") -> DataFrame:
    return books.groupBy(F.coalesce(given(name), F.lit(absent)).alias("value")).agg(F.count("*").alias("books"))


def facets(books: DataFrame, names: list[str]) -> DataFrame:
    """Counts and total size of all the facets' values in one pass; the null value too."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])
    return books.select(F.explode(pairs).alias("f"), "file_size").groupBy("f.facet", "f.value").agg(F.count("*").alias("books"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))


def outer_counts(dimension: DataFrame, key: str, facts: DataFrame, foreign: str, counted: str) -> DataFrame:
    """Every row of the dimension with the number of its facts, zero included.

    Facts are counted before the join, so only one row a key moves.
    """
    counts = facts.groupBy(F.col(foreign).alias("__key")).agg(F.count(counted).alias("n"))
    return dimension.join(counts, dimension[key] == counts["__key"], "left").drop("__key").withColumn("n", F.coalesce("n", F.lit(0)))


def zero_filled(frame: DataFrame, name: str, values: list[str], *sums: str) -> DataFrame:
    """Counts (and sums) by each of the given values, zero where there are none."""
    spark = frame.sparkSession
    table = spark.createDataFrame([(v,) for v in values], f"{name} string")
    aggs = [F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums]]
    return table.join(frame.groupBy(name).agg(*aggs), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(s, F.lit(0)).alias(s) for s in sums])


def variants(books: DataFrame) -> DataFrame:
    """Every work with its files: the origin itself and all conversions, as (work_id, book)."""
    return books.withColumn("work_id", F.coalesce("origin_book_id", "id"))


def format_rank(fmt: Column | str) -> Column:
    at = F.array_position(F.array(*map(F.lit, FORMAT_ORDER)), F.lower(col(fmt)))
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(FORMAT_ORDER) + 1).otherwise(at)


#: Profiles whose files fit any device.
UNIVERSAL = ["", "generic_epub", "manga_epub"]


def ranked_variants(books: DataFrame, device: str | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Variants of each work by rank: by format, universal ones first, originals first.

    With a device its own files come before all, then universal ones, then the
    rest.  Blocked variants go; a work whose variants are all blocked keeps its
    own book.
    """
    out = variants(books)
    if blocked is not None:
        marked = out.join(hide_states(out, blocked).select(F.col("id").alias("__seen")), F.col("id") == F.col("__seen"), "left")
        some = F.max(F.col("__seen").isNotNull()).over(Window.partitionBy("work_id"))
        out = marked.withColumn("__some", some).filter(F.col("__seen").isNotNull() | (~F.col("__some") & (F.col("id") == F.col("work_id")))).drop("__seen", "__some")
    universal = F.coalesce("device_profile", F.lit("")).isin(*UNIVERSAL)
    group = F.lit(0) if device is None else F.when(F.col("device_profile") == device, 0).when(universal, 1).otherwise(2)
    original = F.when(F.coalesce("is_original", F.lit(False)), 0).otherwise(1)
    w = Window.partitionBy("work_id").orderBy(group, format_rank("format"), F.when(universal, 0).otherwise(1), original, "id")
    return out.withColumn("rank", F.row_number().over(w))


def acquisition_links(books: DataFrame) -> DataFrame:
    """One link for each work, format and device: the best ranked."""
    ranked = ranked_variants(books)
    w = Window.partitionBy("work_id", "format", F.coalesce("device_profile", F.lit(""))).orderBy("rank")
    return ranked.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def usage(files: DataFrame, limit: int) -> DataFrame:
    """Bytes and files by top directory, and the share of the limit; a file at the root is its own key."""
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("top")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).withColumn("percent", F.when(F.lit(limit) > 0, F.bround(100.0 * F.col("bytes") / limit, 1)).otherwise(0.0))


def has_room(used: Column, extra: Column, limit: Column) -> Column:
    return (limit <= 0) | (used + extra <= limit)
