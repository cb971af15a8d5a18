"""Conversion plans: what a file becomes on a device, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import given

PLAN_DDL = "struct<target:string,page_pipeline:boolean,optimize:boolean,explicit:boolean>"


def plan(explicit: Column | None = None) -> Column:
    """Target and flags over format, content_type, image_only, pages and the profile's columns.

    An explicit target wins.  Comics and image pages keep their layout, text is
    reflowed, and a format that only an EPUB can become goes through EPUB first.
    """
    def made(target, pipeline=False, optimize=False, named=False):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(target).alias("target"), lit(pipeline).alias("page_pipeline"), lit(optimize).alias("optimize"), lit(named).alias("explicit"))

    kind, fmt, preferred = F.col("content_type"), F.col("format"), F.col("preferred_format")
    paged = F.when(F.col("comic_output") == "epub_images", "epub").otherwise(F.col("comic_output"))
    image_only = F.coalesce("image_only", F.lit(False))
    page_like = kind.isin("comic", "image") | (kind.isin("document", "ebook") & image_only)
    auto = (
        F.when(kind == "image", made("jpg"))
        .when((kind == "comic") | F.coalesce("pages", F.lit(False)), made(paged, pipeline=True))
        .when((kind == "document") & (image_only | ~F.coalesce("reflow_text", F.lit(False))), made(paged, pipeline=True))
        .when(kind == "document", made(F.when(preferred.isin("pdf", "cbz", "jpg", "png"), "epub").otherwise(preferred)))
        .when((kind == "ebook") & (preferred == "epub") & (fmt == "epub"), made("epub", optimize=True))
        .when((kind == "ebook") & (preferred != "epub") & (fmt != "epub"), made("epub"))
        .otherwise(made(preferred))
    )
    if explicit is None:
        return auto
    target = F.lower(given(explicit))
    asked = F.when(target.isin("epub_optimized", "epub-optimized"), made("epub", optimize=True, named=True)).otherwise(made(target, pipeline=page_like & target.isin("epub", "cbz", "pdf"), named=True))
    return F.when(target.isNotNull(), asked).otherwise(auto)


def plan_jobs(jobs: DataFrame, books: DataFrame, profiles: DataFrame, limit: int = 4096) -> DataFrame:
    """Jobs with their plan; the profile table is small, and joined by broadcast only up to ``limit`` rows."""
    small = profiles.limit(limit + 1).count() <= limit
    joined = jobs.join(books, "book_id").join(F.broadcast(profiles) if small else profiles, "profile", "left")
    return joined.withColumn("plan", plan(F.col("target_format")))


def text_mode(value: Column) -> Column:
    """Option for the text of comic pages: booleans, names and aliases to off, experimental, ocr or ocr_font."""
    v = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(v.isin("true", "1", "yes", "on", "experimental"), "experimental").when(v.isin("ocr", "ocr_font"), v).otherwise("off")


def fit(width: Column, height: Column, max_width: int, max_height: int, enlarge: bool = False) -> Column:
    """Size that fits the frame in proportion; never larger unless asked."""
    scale = F.least(F.lit(max_width) / width, F.lit(max_height) / height)
    scale = scale if enlarge else F.least(scale, F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.bround(width * scale)).cast("int").alias("width"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int").alias("height"))


def gamma_table(gamma: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.bround(F.pow(i / F.lit(255.0), F.lit(1 / gamma)) * 255).cast("int"))


def grey_levels(value: Column, levels: int) -> Column:
    """Nearest of so many evenly spaced grey values."""
    step = 255.0 / (levels - 1)
    return F.bround(F.bround(value / step) * step).cast("int")


#: From more than this a page is a spread, and from this on turning it is better than cutting it.
SPREAD, LONG_SPREAD = 1.16, 1.8


def spread(width: Column, height: Column, wide: float = SPREAD, double: float = LONG_SPREAD) -> Column:
    """What becomes of a wide page on an upright screen: split a spread, rotate a very wide one, keep the rest."""
    ratio = width / height
    return F.when((height <= 0) | (width <= 0) | (ratio <= wide), "keep").when(ratio >= double, "rotate").otherwise("split")


def expand_spreads(pages: DataFrame, target_width: int, target_height: int, mode: str = "auto", rotate_right: bool = False) -> DataFrame:
    """Pages (doc, page, width, height, right_to_left) as the pages that they become, numbered anew in each document.

    kind is whole, left, right or rotated; x0 and x1 are what of the width is
    cut out, angle the turn to the left, width and height the size afterwards.
    ``mode`` is none, auto, split, rotate or both; only pages that lie across
    the screen's own way are touched.  Read from right to left, the right half
    comes first.
    """
    if mode not in ("none", "auto", "split", "rotate", "both"):
        mode = "none"
    w, h = F.col("width"), F.col("height")
    across = (w > 0) & (h > 0) & ((w > h) != F.lit(target_width > target_height)) & (w / h > SPREAD)
    long = w / h >= LONG_SPREAD
    cut = across & {"auto": ~long, "split": ~long, "both": F.lit(True)}.get(mode, F.lit(False))
    turned = across & {"auto": long, "rotate": F.lit(True), "both": F.lit(True)}.get(mode, F.lit(False))
    half = F.floor(w / 2).cast("int")
    part = lambda kind, x0, x1, angle, width, height: F.struct(F.lit(kind).alias("kind"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"), F.lit(angle).alias("angle"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    zero = F.lit(0)
    left, right = part("left", zero, half, 0, half, h), part("right", half, w, 0, w - half, h)
    halves = F.when(F.coalesce(F.col("right_to_left"), F.lit(False)), F.array(right, left)).otherwise(F.array(left, right))
    none = F.slice(F.array(left), 1, 0)
    parts = F.concat(F.when(cut, halves).otherwise(none), F.when(turned, F.array(part("rotated", zero, w, -90 if rotate_right else 90, h, w))).otherwise(none))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(part("whole", zero, w, 0, w, h)))
    rows = pages.select("doc", "page", F.posexplode(parts).alias("part", "p")).select("doc", "page", "part", "p.*")
    # a document's pages in order
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("page", "part")) - 1)
