"""Boxes on drawn pages: regions that are one, free space, words and their lines, and text fitted into a box.

Boxes are (x0, y0, x1, y1) in whole pixels, the right and lower edge outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.udf import vectorised
from quillspark.operators.components import components
from quillspark.shared import drop, settle

BOX = ["x0", "y0", "x1", "y1"]
#: Share of the smaller region at which two are one; least width of free space; ink that is noise; margin round text.
SHARE, LEAST_WIDTH, NOISE, MARGIN = 0.35, 6, 6, 2
#: Shares of a line's height for the gap between words and between lines, and of a row's for lines beside each other.
WORD_GAP, LINE_GAP, BESIDE = 0.35, 0.2, 0.5
#: Padding of a box, scales that are of use, and steps of the search for one.
PADDING, MIN_SCALE, MAX_SCALE, STEPS = 0.06, 1.06, 2.0, 20
#: Pixels of a grid cell; boxes beyond which a cell is divided, and into how many a side.
CELL, CROWDED, PARTS = 256, 200, 8
#: Boxes of a page up to which its merging is one task's; and pairs of boxes that are looked at together.
ONE_TASK, TOGETHER = 512, 1 << 18


def _area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0), x1 - x0).cast("long") * F.greatest(F.lit(0), y1 - y0)


# ------------------------------------------------------------ regions that are one


def _in_cells(boxes: DataFrame, cell: int, crowded: int) -> DataFrame:
    """Boxes with each grid cell (size, cx, cy) that they touch; crowded cells are divided."""

    def touched(frame: DataFrame, size: int, low_x=None, low_y=None, high_x=None, high_y=None) -> DataFrame:
        start = lambda c, low: F.floor(c / size) if low is None else F.greatest(F.floor(c / size), low)
        stop = lambda c, high: F.floor((c - 1) / size) if high is None else F.least(F.floor((c - 1) / size), high)
        out = frame.withColumn("cx", F.explode(F.sequence(start(F.col("x0"), low_x), stop(F.col("x1"), high_x))))
        return out.withColumn("cy", F.explode(F.sequence(start(F.col("y0"), low_y), stop(F.col("y1"), high_y)))).withColumn("size", F.lit(size))

    coarse = touched(boxes.filter("x1 > x0 AND y1 > y0"), cell)
    small = cell // PARTS
    many = coarse.groupBy("page", "cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("page", "cx", "cy", F.lit(True).alias("many"))
    told = coarse.join(many, ["page", "cx", "cy"], "left")
    full = told.filter("many").withColumnRenamed("cx", "wx").withColumnRenamed("cy", "wy").drop("size")
    inner = touched(full, small, F.col("wx") * PARTS, F.col("wy") * PARTS, F.col("wx") * PARTS + PARTS - 1, F.col("wy") * PARTS + PARTS - 1)
    return told.filter("many IS NULL").drop("many").unionByName(inner.drop("many", "wx", "wy"))


def overlapping(boxes: DataFrame, share: float = SHARE, cell: int = CELL, crowded: int = CROWDED) -> DataFrame:
    """Pairs (page, a, b) of boxes (page, region, x0, y0, x1, y1) that overlap in ``share`` of the smaller one.

    Boxes meet in the grid cells of their page; a pair counts in the cell of
    the upper left corner of what they share, which is one cell.
    """
    placed = _in_cells(boxes.select("page", "region", *BOX), cell, crowded)
    a, b = placed.alias("a"), placed.alias("b")
    x0, y0 = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    both = _area(x0, y0, F.least("a.x1", "b.x1"), F.least("a.y1", "b.y1"))
    smaller = F.least(*[_area(*[F.col(f"{s}.{c}") for c in BOX]) for s in "ab"])
    here = (F.floor(x0 / F.col("a.size")) == F.col("a.cx")) & (F.floor(y0 / F.col("a.size")) == F.col("a.cy"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "size", "cx", "cy")]
    on = same[0] & same[1] & same[2] & same[3] & (F.col("a.region") < F.col("b.region"))
    return a.join(b, on & (both > 0) & here & (both / F.greatest(F.lit(1), smaller) >= share)).select("a.page", F.col("a.region").alias("a"), F.col("b.region").alias("b"))


def _united(boxes: DataFrame, *keys: str) -> DataFrame:
    """One box for each group: the least region's number, the outline, area and kind of the largest member (of equal ones the least)."""
    largest = F.max_by(F.struct("area", "kind"), F.struct("area", -F.col("region")))
    out = boxes.groupBy(*keys).agg(F.min("region").alias("region"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], largest.alias("largest"), F.sum("members").alias("members"))
    return out.select("page", "region", *BOX, "largest.area", "largest.kind", "members")


def _linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number that links (i, j) lead to, for each of n."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _merged(page: np.ndarray, box: dict[str, np.ndarray], share: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Boxes of many pages, a page's together, merged until none of a page overlap; ``kind`` is the number of the box that has it."""
    done = []
    while len(page):
        opens = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        ends = np.repeat(np.r_[opens[1:], len(page)], np.diff(np.r_[opens, len(page)]))
        # each box with those after it on its page
        partners = ends - np.arange(len(page)) - 1
        i = np.repeat(np.arange(len(page)), partners)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
        wide, high = (np.minimum(box[f"{a}1"][i], box[f"{a}1"][j]) - np.maximum(box[f"{a}0"][i], box[f"{a}0"][j]) for a in "xy")
        meet = (wide > 0) & (high > 0)
        i, j, both = i[meet], j[meet], (wide * high)[meet]
        size = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
        one = both / np.maximum(1, np.minimum(size[i], size[j])) >= share
        i, j = i[one], j[one]
        again = np.isin(page, page[i])
        done.append((page[~again], {c: v[~again] for c, v in box.items()}))
        if not len(i):
            break
        root = _linked(i, j, len(page))
        # a group's largest box first, of equal ones the least
        order = np.lexsort((box["region"], -box["area"], root))
        order = order[again[order]]
        starts = np.flatnonzero(np.r_[True, root[order][1:] != root[order][:-1]])
        how = {"region": np.minimum, "x0": np.minimum, "y0": np.minimum, "x1": np.maximum, "y1": np.maximum, "members": np.add}
        page, box = page[order][starts], {c: how[c].reduceat(v[order], starts) if c in how else v[order][starts] for c, v in box.items()}
    return np.concatenate([p for p, _ in done]), {c: np.concatenate([b[c] for _, b in done]) for c in done[0][1]}


def _merge_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, share: float) -> Iterator[pa.RecordBatch]:
    """Pages (page, boxes: list of structs) to their merged boxes, as many pages at once as have ``TOGETHER`` pairs."""
    for batch in batches:
        pages, lists = batch.column("page"), batch.column("boxes")
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        of = np.repeat(np.arange(len(pages)), sizes)
        box = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("region", *BOX, "area", "members")}
        box |= {c: box[c].astype("int64") for c in BOX} | {"kind": np.arange(len(of))}
        part = np.cumsum(sizes.astype("int64") * (sizes - 1) // 2) // TOGETHER
        for k in np.unique(part):
            mine = part[of] == k
            page, out = _merged(of[mine], {c: v[mine] for c, v in box.items()}, share)
            columns = {c: pa.array(v) for c, v in out.items()} | {"page": pages.take(pa.array(page)), "kind": flat.field("kind").take(pa.array(out["kind"]))}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def merge_regions(regions: DataFrame, share: float = SHARE, cell: int = CELL, crowded: int = CROWDED, one_task: int = ONE_TASK) -> DataFrame:
    """Regions (page, region, x0, y0, x1, y1, area, kind), region being their own number in the table, as merged ones with members.

    Regions that overlap in ``share`` of the smaller one are one, with all that
    links lead to; merged boxes that overlap again merge again, until none do.
    Which region comes first doesn't matter.  Equal boxes of a page are one
    beforehand; a page without links is left alone from then on.  Pages of at
    most ``one_task`` boxes are merged where they are put together; boxes of
    fuller pages meet in cells, round after round.
    """
    first = settle(_united(regions.withColumn("members", F.lit(1).cast("long")).withColumns({f"__{c}": F.col(c) for c in BOX}), "page", *[f"__{c}" for c in BOX]), "regions")
    fields = {f.name: f for f in first.schema}
    whole = all(fields[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in ("region", *BOX))
    unknown = F.lit(False)
    for c in ("page", "region", *BOX, "area"):
        unknown = unknown | F.col(c).isNull()
    full = settle(first.groupBy("page").agg(F.count("*").alias("n"), F.max(unknown).alias("unknown")).filter(F.lit(not whole) | (F.col("n") > one_task) | F.col("unknown")).select("page"), "pages")
    if full.isEmpty():
        return _merge_small(first, share)
    same = F.col("page").eqNullSafe(F.col("__page"))
    full = full.withColumnRenamed("page", "__page")
    return _merge_small(first.join(full, same, "left_anti"), share).unionByName(_merge_large(first.join(full, same, "left_semi"), share, cell, crowded))


def _merge_small(boxes: DataFrame, share: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(boxes.schema)
    pages = boxes.groupBy("page").agg(F.collect_list(F.struct(*[c for c in boxes.columns if c != "page"])).alias("boxes"))
    return pages.mapInArrow(lambda batches: _merge_batches(batches, schema, share), boxes.schema)


def _merge_large(boxes: DataFrame, share: float, cell: int, crowded: int) -> DataFrame:
    now = settle(boxes, "regions")
    done: list[DataFrame] = []
    while True:
        links = settle(overlapping(now, share, cell, crowded), "overlaps")
        if links.isEmpty():
            drop(links)
            break
        touched = links.select("page").distinct()
        done.append(settle(now.join(touched, "page", "left_anti"), "regions"))
        roots = components(links.select("a", "b"))
        again = now.join(touched, "page", "left_semi").join(roots, F.col("region") == F.col("node"), "left")
        merged = settle(_united(again.withColumn("root", F.coalesce("root", "region")), "page", "root"), "regions")
        for old in (links, now):
            drop(old)
        now = merged
    out = now
    for rest in done:
        out = out.unionByName(rest)
    return out


# ------------------------------------------------------------------- free space


def free_space(texts: DataFrame, obstacles: DataFrame, band: int = 64, least_width: int = LEAST_WIDTH) -> DataFrame:
    """region, x0, y0, x1, y1: the largest box round a text's centre without ink, inside its region.

    texts (page, region, rx0, ry0, rx1, ry1, tx0, ty0, tx1, ty1), obstacles
    (page, x0, y0, x1, y1).  Region and obstacle meet once for each band of
    rows, and a region holds its own ink as an array.  Rows are then taken in
    pairs around the centre, those with the same ink at once, while the least
    room of all of them shrinks, and the first of the largest areas wins.  The
    text itself, with a margin, and noise don't bound it.  Regions below 8
    pixels or without room stay as they are.
    """
    c = F.col
    inside = lambda value, size: F.least(F.greatest(value, F.lit(0)), size - 1)
    sized = texts.withColumn("w", c("rx1") - c("rx0")).withColumn("h", c("ry1") - c("ry0"))
    large = sized.filter("w >= 8 AND h >= 8").select(
        "page", "region", "rx0", "ry0", "w", "h",
        *[F.greatest(F.lit(0), c(f"t{a}0") - c(f"r{a}0") - MARGIN).alias(f"m{a}0") for a in "xy"], *[F.least(c(s), c(f"t{a}1") - c(f"r{a}0") + MARGIN).alias(f"m{a}1") for a, s in (("x", "w"), ("y", "h"))],
        *[inside(F.floor((c(f"t{a}0") + c(f"t{a}1")) / 2).cast("int") - c(f"r{a}0"), c(s)).alias(f"c{a}") for a, s in (("x", "w"), ("y", "h"))],
    )
    bands = lambda low, high: F.explode(F.sequence(F.floor(low / band), F.floor((high - 1) / band)))
    ours = large.withColumn("band", bands(c("ry0"), c("ry0") + c("h"))).alias("t")
    ink = obstacles.filter((c("x1") - c("x0")) * (c("y1") - c("y0")) >= NOISE).select("page", *BOX).withColumn("band", bands(c("y0"), c("y1"))).alias("i")
    meet = (c("x0") < c("rx0") + c("w")) & (c("x1") > c("rx0")) & (c("y0") < c("ry0") + c("h")) & (c("y1") > c("ry0"))
    met = ours.join(ink, (c("t.page") == c("i.page")) & (c("t.band") == c("i.band")) & meet, "left")
    # the part of the ink that is in the region, in this band and in the region's own pixels
    low = (c("t.band") * band).cast("int")
    # null where a region meets no ink in the band
    top, end = F.when(c("y0").isNotNull(), F.greatest(c("y0"), c("ry0"), low) - c("ry0")), F.least(c("y1"), c("ry0") + c("h"), low + band) - c("ry0")
    left, right = F.greatest(c("x0") - c("rx0"), F.lit(0)), F.least(c("x1") - c("rx0"), c("w"))
    shown = ["region", "rx0", "ry0", "w", "h", "cx", "cy"]
    clipped = met.select(*shown, "mx0", "mx1", "my0", "my1", top.alias("top"), end.alias("end"), left.alias("a"), right.alias("b"))
    piece = lambda top, end, a, b: F.struct(top.alias("top"), end.alias("end"), a.alias("a"), b.alias("b"))
    inner, whole = (F.greatest("top", "my0"), F.least("end", "my1")), piece(c("top"), c("end"), c("a"), c("b"))
    round_text = F.array(piece(c("top"), F.least("end", "my0"), c("a"), c("b")), piece(F.greatest("top", "my1"), c("end"), c("a"), c("b")), piece(*inner, c("a"), F.least("b", "mx0")), piece(*inner, F.greatest("a", "mx1"), c("b")))
    beside = (c("end") <= c("my0")) | (c("top") >= c("my1")) | c("top").isNull()
    cut = clipped.select(*shown, F.explode(F.when(beside, F.array(whole)).otherwise(round_text)).alias("p"))
    over = (c("p.a") <= c("cx")) & (c("cx") < c("p.b"))
    nearest = F.struct("p.top", "p.end", F.when(over, c("cx")).when(c("p.b") <= c("cx"), c("p.b") - 1).otherwise(-1).alias("left"), F.when(over, c("cx")).when(c("p.a") > c("cx"), c("p.a")).otherwise(c("w")).alias("right"))
    solid = (c("p.top") < c("p.end")) & (c("p.a") < c("p.b"))
    # a region's ink, an entry for each obstacle and band
    held = cut.groupBy("region").agg(*[F.first(x).alias(x) for x in shown[1:]], F.collect_list(F.when(solid, nearest)).alias("ink"))
    reach = F.least("cy", c("h") - 1 - c("cy"))
    # how far from the centre the ink of a pair of rows changes: between two of these all pairs have the same room
    turns = F.flatten(F.transform("ink", lambda p: F.array(p["top"] - c("cy"), p["end"] - c("cy"), c("cy") - p["end"] + 1, c("cy") - p["top"] + 1)))
    held = held.withColumn("reach", reach).withColumn("turns", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(turns, lambda d: (d > 0) & (d <= reach))))))
    start = F.struct(F.lit(-1).alias("left"), c("w").alias("right"))
    room = lambda y: F.aggregate("ink", start, lambda s, p: F.when((p["top"] <= y) & (y < p["end"]), F.struct(F.greatest(s["left"], p["left"]).alias("left"), F.least(s["right"], p["right"]).alias("right"))).otherwise(s), lambda s: s["right"] - s["left"] - 2)
    pairs = F.transform("turns", lambda d, i: F.struct(F.coalesce(F.get("turns", i + 1) - 1, c("reach")).alias("half"), F.least(room(c("cy") + d), room(c("cy") - d)).alias("room")))
    first = F.struct(c("w").alias("room"), F.lit(0).alias("area"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("half"))

    def widen(best: Column, pair: Column) -> Column:
        width = F.least(best["room"], pair["room"])
        area = width * (2 * pair["half"] + 1)
        larger = (width >= least_width) & (area > best["area"])
        return F.struct(width.alias("room"), *[F.when(larger, new).otherwise(best[n]).alias(n) for n, new in (("area", area), ("width", width), ("half", pair["half"]))])

    best = held.withColumn("best", F.aggregate(pairs, first, widen))
    x, y = F.greatest(F.lit(0), c("cx") - F.floor(c("best.width") / 2).cast("int")), F.greatest(F.lit(0), c("cy") - c("best.half"))
    found = [c("rx0") + x, c("ry0") + y, c("rx0") + F.least("w", x + c("best.width")), c("ry0") + F.least("h", y + 2 * c("best.half") + 1)]
    unbound = [c("rx0"), c("ry0"), c("rx0") + c("w"), c("ry0") + c("h")]
    boxed = best.select("region", *[F.when(c("best.width").isNull(), w).otherwise(f).cast("int").alias(b) for b, w, f in zip(BOX, unbound, found, strict=True)])
    small = sized.filter("NOT coalesce(w >= 8 AND h >= 8, false)").select("region", *[c(f"r{b}").cast("int").alias(b) for b in BOX])
    return boxed.unionByName(small)


# ---------------------------------------------------------------- words and lines


def _bands(boxes: DataFrame, keys: list[str], low: str, high: str, gap: Column | int, name: str) -> DataFrame:
    """Boxes with the number of their band: one ends where nothing follows within ``gap`` pixels."""
    ordered = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col(low) - before > gap, F.lit(True))
    return boxes.withColumn("__opens", opens.cast("int")).withColumn(name, F.sum("__opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def segment_words(ink: DataFrame, right_to_left: Column | None = None) -> DataFrame:
    """Words of ink (page, x0, y0, x1, y1): page, line, word, x0, y0, x1, y1, line_height, line_gap, word_gap.

    Rows of ink, one empty row apart at most, are a line; ink of a line that is
    a share of its height apart is two words.  Lines count from the top, words
    in the order of reading.  Pages below 512 pixels are looked at twice as
    large, as small gaps are told better so.
    """
    c = F.col
    rtl = F.lit(False) if right_to_left is None else right_to_left
    page = Window.partitionBy("page")
    marks = ink.filter("x1 > x0 AND y1 > y0").select("page", *BOX, rtl.alias("rtl"))
    # windows of a page only: its ink is dealt once, and a window's order serves the next ones
    rows = _bands(marks, ["page"], "y0", "y1", 1, "band")
    extent = F.greatest(F.max("x1").over(page) - F.min("x0").over(page), F.max("y1").over(page) - F.min("y0").over(page))
    zoomed = rows.withColumn("zoom", F.when(extent < 512, 2).otherwise(1))
    across = Window.partitionBy("page", "band").orderBy("x0", "x1")
    band = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lined = zoomed.withColumn("top", F.min("y0").over(band)).withColumn("bottom", F.max("y1").over(band))
    tolerance = F.greatest(F.lit(2), F.bround(F.lit(WORD_GAP) * c("zoom") * (c("bottom") - c("top"))).cast("int"))
    apart = _bands(lined.withColumn("limit", F.floor(tolerance / c("zoom"))), ["page", "band"], "x0", "x1", c("limit"), "island")
    words = apart.groupBy("page", "band", "island").agg(F.min("x0").alias("x0"), F.first("top").alias("y0"), F.max("x1").alias("x1"), F.first("bottom").alias("y1"), F.first("rtl").alias("rtl"))
    # islands are numbered from the left; bands from the top
    line, left = Window.partitionBy("page", "band"), Window.partitionBy("page", "band").orderBy("island")
    down = Window.partitionBy("page").orderBy("band", "island")
    told = words.withColumn("next_top", F.lead("y0").over(down)).withColumn("space", F.lead("x0").over(left) - c("x1")).withColumn("n", F.count(F.lit(1)).over(line))
    # below the lowest line there is no gap: zero
    last = c("island") == c("n")
    height, gap = F.when(last, c("y1") - c("y0")), F.when(last, F.greatest(F.lit(0), c("next_top") - c("y1")))
    # of the sorted values the upper middle: from the largest, the first that half of them reach
    middle = lambda v: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC)").over(page).cast("int")
    rhythm = told.withColumn("__h", height).withColumn("__g", gap).withColumn("__s", F.when(c("space") > 0, c("space")))
    sized = rhythm.withColumn("line_height", F.greatest(F.lit(1), middle("__h"))).withColumn("__gap", F.coalesce(middle("__g"), F.lit(0))).withColumn("word_gap", F.greatest(F.lit(2), F.coalesce(middle("__s"), F.lit(0))))
    least_gap = F.greatest(F.lit(1), F.bround(F.lit(LINE_GAP) * c("line_height")).cast("int"))
    word = F.when(c("rtl"), c("n") - c("island")).otherwise(c("island") - 1).cast("int")
    return sized.select("page", (c("band") - 1).cast("int").alias("line"), word.alias("word"), *BOX, "line_height", F.greatest(least_gap, "__gap").alias("line_gap"), "word_gap")


def reading_rows(lines: DataFrame, least: float = BESIDE) -> DataFrame:
    """Lines (page, line, x0, y0, x1, y1) with row and place: rows from the top, lines from the left.

    From the top down, a line joins the first row whose first line it overlaps
    in ``least`` of the lower one's height, else opens a row.  Lines without
    area have none.  Of lines at one place the one with the least number is
    first.  A page's lines are folded in order; the open rows are the state.
    """
    one = F.struct("y0", "x0", "line", "x1", "y1")
    pages = lines.filter("x1 > x0 AND y1 > y0").groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    element = pages.schema["lines"].dataType.elementType.simpleString()
    empty = F.array().cast(f"array<array<{element}>>")

    def joins(row: Column, line: Column) -> Column:
        head = F.get(row, F.lit(0))
        shared = F.least(head["y1"], line["y1"]) - F.greatest(head["y0"], line["y0"])
        return shared / F.least(head["y1"] - head["y0"], line["y1"] - line["y0"]) >= least

    def step(rows: Column, line: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(rows, lambda r: joins(r, line)), True), F.lit(0))
        opened = F.concat(rows, F.array(F.array(line)))
        joined = F.transform(rows, lambda r, i: F.when(i + 1 == at, F.concat(r, F.array(line))).otherwise(r))
        return F.when(at == 0, opened).otherwise(joined)

    rows = pages.select("page", F.posexplode(F.aggregate("lines", empty, step)).alias("row", "members"))
    across = F.array_sort(F.transform("members", lambda m, i: F.struct(m["x0"].alias("x0"), i.alias("i"), m["line"].alias("line"))))
    return rows.select("page", "row", F.posexplode(across).alias("place", "m")).select("page", "m.line", "row", "place")


# ------------------------------------------------------------------- fitted text


def _wrapped(widths: list[float], capacity: float, space: float) -> list[int]:
    """Words of each line of a greedy break at ``capacity``."""
    lines, n, width = [], 0, 0.0
    for w in widths:
        if n and width + (w + space) <= capacity:
            n, width = n + 1, width + (w + space)
        else:
            lines.append(n)
            n, width = 1, w
    return [*lines[1:], n]


def _line_count(widths: list[float], spaced: list[float], capacity: float) -> int:
    """How many lines ``_wrapped`` makes; spaced: widths with the space before them."""
    n, width = 1, widths[0]
    for k in range(1, len(widths)):
        width += spaced[k]
        if width > capacity:
            n += 1
            width = widths[k]
    return n


@vectorised("scale double, lines array<int>")
def _fitted(widths: pd.Series, low: pd.Series, high: pd.Series, line: pd.Series, space: pd.Series, gap: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    """The largest scale that fits, by halving, and its lines; nulls without widths."""

    def one(words, lowest, highest, line, space, gap, w, h):
        if words is None:
            return None, None
        words, best = words.tolist(), None
        spaced = [x + space for x in words]
        for _ in range(STEPS):
            middle = (lowest + highest) / 2
            n = _line_count(words, spaced, w / middle)
            if n * line * middle + (n - 1) * gap * middle <= h + 0.5:
                lowest = best = middle
            else:
                highest = middle
        return best, None if best is None else _wrapped(words, w / best, space)

    return pd.DataFrame([one(*row) for row in zip(widths, low, high, line, space, gap, w, h, strict=True)], columns=["scale", "lines"]).astype({"scale": "float64"})


def fit_words(blocks: DataFrame, max_scale: float = MAX_SCALE, min_scale: float = MIN_SCALE) -> DataFrame:
    """blocks with scale, lines (words of each), gap and height: the largest scale at which the words, broken anew, fit their box.

    A block has widths (of its words, in the order of reading), line_height,
    word_gap, box_w and box_h.  Twenty halvings of the scale, each a walk over
    the words.  Fewer than two words, or no scale of use: nulls.  Room that is left widens the gaps by half a line at most.
    """
    c = F.col
    pad = F.greatest(F.lit(2), F.floor(F.least("box_w", "box_h") * PADDING).cast("int"))
    sized = blocks.withColumn("__w", F.greatest(F.lit(1), c("box_w") - 2 * pad)).withColumn("__h", F.greatest(F.lit(1), c("box_h") - 2 * pad))
    sized = sized.withColumn("__gap", F.greatest(F.lit(1), F.bround(F.lit(LINE_GAP) * c("line_height")).cast("int"))).withColumn("__cap", F.least(F.lit(max_scale), c("__w") / F.array_max("widths")))
    able = (F.size("widths") >= 2) & (c("__cap") >= min_scale)
    words = F.when(able, c("widths").cast("array<double>"))
    fitted = _fitted(words, F.lit(float(min_scale)), *[c(x).cast("double") for x in ("__cap", "line_height", "word_gap", "__gap", "__w", "__h")])
    found = sized.withColumn("__fitted", fitted).withColumn("scale", c("__fitted.scale")).withColumn("lines", c("__fitted.lines"))
    n, line = F.size("lines"), c("line_height") * c("scale")
    left = c("__h") - (n * line + F.greatest(F.lit(0), n - 1) * (c("__gap") * c("scale")))
    gap = c("__gap") * c("scale") + F.when((n > 1) & (left > 0), F.least(left / (n - 1), 0.5 * line)).otherwise(0.0)
    found = found.withColumn("gap", F.when(c("scale").isNotNull(), gap))
    return found.withColumn("height", F.when(c("scale").isNotNull(), n * line + F.greatest(F.lit(0), n - 1) * c("gap"))).drop("__w", "__h", "__gap", "__cap", "__fitted")
