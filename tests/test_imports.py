"""Imports field by field, and pages that become several."""

from pyspark.sql import functions as F

from quillspark.operators import imports
from quillspark.plans import planner

FILES = "file_id long, stem string, format string, comic boolean, content_hash string, readable boolean"
OWN = "file_id long, title string, author string, series string, series_index double, publisher string, language string, description string, isbn string, page_count int, subject string, age_rating string, reading_direction string, genre string"


def own(file_id, **fields):
    return tuple(fields.get(c) if c != "file_id" else file_id for c in (x.split()[0] for x in OWN.split(", ")))


def rows_of(spark, files, carried, known=()):
    judged, rows = imports.import_files(spark.createDataFrame(files, FILES), spark.createDataFrame(carried, OWN), spark.createDataFrame([(k,) for k in known], "content_hash string"))
    return {r.file_id: r.outcome for r in judged.collect()}, {r.file_id: r for r in rows.collect()}


def test_what_a_file_carries_comes_first(spark):
    files = [(1, "Deep Sea Vol. 03 (Ana Silva)", "epub", False, "a", True), (2, "Deep Sea Vol. 03 (Ana Silva)", "pdf", False, "b", True), (3, "Saga - 07 - Return", "cbz", True, "c", True), (4, "Saga - 07 - Return", "cbr", True, "d", True), (5, "photo (2020)", "jpg", False, "e", True), (6, "Bare", "epub", False, "f", True)]
    carried = [
        own(1, title="", author="Own", series_index=0.0, isbn="978-0-1234-5678-9", language="pt", description="d", page_count=0, genre="x"),
        own(2, title="Unknown title", author=" Real ", subject="s", language="pt", page_count=12, series="no"),
        own(3, title="T", genre=" a, ,b ", reading_direction="ltr", age_rating="Teen", series_index=9.0),
        own(4, title="ignored", reading_direction="ltr"), own(6, isbn="123"),
    ]
    outcomes, rows = rows_of(spark, files, carried)
    assert set(outcomes.values()) == {"imported"}
    fields = lambda i, *names: tuple(getattr(rows[i], n) for n in names)
    assert fields(1, "title", "author", "series", "series_index", "isbn", "language", "description", "page_count", "tags", "reading_direction") == ("Deep Sea 3", "Own", "Deep Sea", 3.0, "9780123456789", "pt", "d", None, [], "ltr")
    assert fields(2, "title", "author", "series", "description", "language", "page_count") == ("Deep Sea 3", "Real", "Deep Sea", "s", None, 12)
    assert fields(3, "title", "series", "series_index", "tags", "reading_direction", "age_rating", "content_type") == ("T", "Saga", 9.0, ["a", "b"], "ltr", "Teen", "comic")
    assert fields(4, "title", "reading_direction", "sort_title") == ("Saga 7 - Return", "rtl", "saga 7 - return")
    assert fields(5, "title", "published", "reading_direction", "content_type") == ("photo (2020)", "2020", "ltr", "image")
    assert fields(6, "title", "isbn", "author") == ("Bare", None, None)


def test_outcomes(spark):
    files = [(1, "a", "epub", False, "same", True), (2, "b", "epub", False, "same", True), (3, "c", "exe", False, "x", True), (4, "d", "pdf", False, "y", False), (5, "e", "pdf", False, "known", True), (6, "f", "pdf", None, None, None)]
    outcomes, rows = rows_of(spark, files, [], ["known"])
    assert outcomes == {1: "imported", 2: "duplicate", 3: "skipped", 4: "error", 5: "duplicate", 6: "error"} and set(rows) == {1}
    assert rows_of(spark, [], []) == ({}, {})


def spreads(spark, pages, **options):
    frame = spark.createDataFrame(pages, "doc int, page int, width int, height int, right_to_left boolean")
    return [tuple(r) for r in planner.expand_spreads(frame, 600, 800, **options).orderBy("doc", "number").select("page", "kind", "x0", "x1", "angle", "width", "height", "number").collect()]


def test_spreads(spark):
    pages = [(1, 1, 600, 900, False), (1, 2, 1301, 900, False), (1, 3, 1300, 900, True), (1, 4, 2000, 900, None), (1, 5, 1000, 900, False), (1, 6, 0, 900, False)]
    whole = lambda page, w, n, h=900: (page, "whole", 0, w, 0, w, h, n)
    assert spreads(spark, pages) == [
        whole(1, 600, 0), (2, "left", 0, 650, 0, 650, 900, 1), (2, "right", 650, 1301, 0, 651, 900, 2), (3, "right", 650, 1300, 0, 650, 900, 3), (3, "left", 0, 650, 0, 650, 900, 4),
        (4, "rotated", 0, 2000, 90, 900, 2000, 5), whole(5, 1000, 6), whole(6, 0, 7),
    ]
    assert [r[1] for r in spreads(spark, pages, mode="none")] == [r[1] for r in spreads(spark, pages, mode="what")] == ["whole"] * 6
    assert [r[1] for r in spreads(spark, pages, mode="split")] == ["whole", "left", "right", "right", "left", "whole", "whole", "whole"]
    assert [(r[1], r[4]) for r in spreads(spark, pages[1:4], mode="both", rotate_right=True)] == [("left", 0), ("right", 0), ("rotated", -90), ("right", 0), ("left", 0), ("rotated", -90), ("left", 0), ("right", 0), ("rotated", -90)]
    assert [r[1] for r in spreads(spark, pages[1:4], mode="rotate")] == ["rotated"] * 3
    frame = spark.createDataFrame([(1, 1, 600, 900, False)], "doc int, page int, width int, height int, right_to_left boolean")
    assert planner.expand_spreads(frame, 800, 600).select(F.col("kind")).first()[0] == "whole"
