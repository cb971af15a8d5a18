"""What a file can become: the targets of each input, who makes them, and in what order a device wants them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets of each kind of input, in order.
OF_IMAGE, OF_PAGES = ["jpg", "png", "cbz", "epub"], ["epub", "cbz", "pdf"]
OF_EPUB = ["epub_optimized", "kepub", "azw3", "mobi", "pdf", "docx", "fb2", "txt"]
OF_PDF, OF_SCANNED_PDF, OF_TEXT = ["epub", "pdf"], ["epub"], ["epub"]
TEXTS = ["txt", "fb2", "docx", "rtf", "mobi", "azw", "azw3", "pdb", "prc"]
#: Who makes an EPUB of a format, and who makes a target of an EPUB.
TO_EPUB = {
    **dict.fromkeys(("html", "htm", "xhtml"), "webpage_to_epub"), "pdf": "pdf_to_epub", "txt": "text_to_epub", "rtf": "text_to_epub", "fb2": "fb2_to_epub", "docx": "docx_to_epub",
    **dict.fromkeys(("mobi", "azw", "azw3", "pdb", "prc"), "kindle_to_epub"),
}
MAKERS = {"azw3": "epub_to_kindle", "mobi": "epub_to_kindle", "kepub": "epub_to_kepub", "docx": "epub_to_docx", "fb2": "epub_to_fb2", "txt": "epub_to_text", "jpg": "compress_image", "png": "compress_image", "epub_optimized": "epub_optimize"}
PAGED = ["epub", "cbz", "pdf"]
#: Targets and inputs that need a library, by its name.
NEEDS = {"docx": "docx", "kindle": "mobi", "pdf": "pdf"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def candidates() -> Column:
    """Targets of an input, over format, content_type, pages and image_only."""
    fmt, kind = F.col("format"), F.col("content_type")
    made = lambda values: F.array(*map(F.lit, values))
    return (
        F.when(kind == "image", made(OF_IMAGE))
        .when(F.coalesce("pages", F.lit(False)) | (kind == "comic"), made(OF_PAGES))
        .when(fmt == "epub", made(OF_EPUB))
        .when(fmt == "pdf", F.when(F.coalesce("image_only", F.lit(False)), made(OF_SCANNED_PDF)).otherwise(made(OF_PDF)))
        .when(fmt.isin(*TEXTS) | kind.isin("ebook", "document"), made(OF_TEXT))
        .otherwise(F.array().cast("array<string>"))
    )


def maker(target: Column) -> Column:
    """Who makes a target of the input."""
    fmt = F.col("format")
    special = F.when((target == "pdf") & (fmt == "epub") & ~F.coalesce("image_only", F.lit(False)), "epub_to_pdf").when((target == "epub") & F.try_element_at(_map(TO_EPUB), fmt).isNotNull(), F.try_element_at(_map(TO_EPUB), fmt))
    return special.when(target.isin(*PAGED), F.concat(F.lit("images_to_"), target)).otherwise(F.coalesce(F.try_element_at(_map(MAKERS), target), target))


def targets(inputs: DataFrame, lacking: list[str] | None = None) -> DataFrame:
    """Inputs with one row a target: target, converter, place (1 is recommended).

    Columns native_formats, preferred_format and comic_output tell the device,
    null for none.  ``lacking`` names libraries that are not there (pdf, docx,
    mobi): what needs one is left out.
    """
    rows = inputs.select("*", F.posexplode(candidates()).alias("__at", "target")).withColumn("converter", maker(F.col("target")))
    for library in lacking or []:
        needs = [x for x in ("pdf_to_epub", "epub_to_pdf", "docx_to_epub", "epub_to_docx", "kindle_to_epub") if library in (NEEDS[k] for k in NEEDS if k in x)]
        rows = rows.filter(~F.col("converter").isin(*needs))
    plain = F.when(F.col("target") == "epub_optimized", "epub").otherwise(F.col("target"))
    opens = F.array_contains(F.transform(F.coalesce("native_formats", F.array().cast("array<string>")), lambda f: F.lower(f)), plain)
    bonus = F.when((F.col("comic_output") == "epub_images") & (plain == "epub"), -1).otherwise(0)
    known = F.col("native_formats").isNotNull()
    rank = F.when(known, F.struct((bonus + F.when(opens, 0).otherwise(1)).alias("a"), F.when(plain == F.col("preferred_format"), 0).otherwise(1).alias("b"), F.col("__at").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("__at").alias("c")))
    # an input has eight targets at most
    gathered = rows.withColumn("__t", F.struct(rank.alias("rank"), "target", "converter")).groupBy(*[c for c in inputs.columns]).agg(F.array_sort(F.collect_list("__t")).alias("__t"))
    return gathered.select(*inputs.columns, F.posexplode("__t").alias("place", "t")).select(*inputs.columns, (F.col("place") + 1).alias("place"), F.col("t.target").alias("target"), F.col("t.converter").alias("converter"))
