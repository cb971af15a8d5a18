"""Boxes on drawn pages against plain versions on pixels and lists."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import components as comp
from quillspark.operators import regions

BOXES = "page int, region long, x0 int, y0 int, x1 int, y1 int, area long, kind string"


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 400)] + [(7, 7), (8, 9), (9, 8), (8, 9)] + [tuple(rng.sample(range(1000, 1400), 2)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def overlaps(a, b, share):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w > 0 and h > 0 and w * h / min(area(a), area(b)) >= share


def merged(rows, share=0.35):
    """Components of overlapping boxes, round after round."""
    boxes = [[page, region, (x0, y0, x1, y1), area, kind, 1] for page, region, x0, y0, x1, y1, area, kind in rows]
    while True:
        groups = [{i} for i in range(len(boxes))]
        for i, a in enumerate(boxes):
            for j in range(i):
                b = boxes[j]
                if a[0] == b[0] and (a[2] == b[2] or overlaps(a[2], b[2], share)):
                    x, y = next(g for g in groups if i in g), next(g for g in groups if j in g)
                    if x is not y:
                        x |= y
                        groups.remove(y)
        if len(groups) == len(boxes):
            return sorted((b[0], b[1], *b[2], b[3], b[4], b[5]) for b in boxes)
        after = []
        for g in groups:
            of = [boxes[i] for i in g]
            top = max(of, key=lambda b: (b[3], -b[1]))
            after.append([of[0][0], min(b[1] for b in of), (min(b[2][0] for b in of), min(b[2][1] for b in of), max(b[2][2] for b in of), max(b[2][3] for b in of)), top[3], top[4], sum(b[5] for b in of)])
        boxes = after


def test_overlapping_regions_are_one_and_touching_ones_not(spark):
    rows = [(0, 1, 0, 0, 100, 100, 1000, "bubble"), (0, 2, 30, 30, 130, 130, 800, "caption"), (1, 3, 0, 0, 100, 100, 1000, "bubble"), (1, 4, 200, 0, 300, 100, 900, "bubble"), (2, 5, 0, 0, 100, 100, 1000, "bubble"), (2, 6, 90, 0, 190, 100, 900, "bubble"), (3, 7, 5, 5, 5, 9, 1, "flat"), (3, 8, 5, 5, 5, 9, 2, "same")]
    got = {(r.page, r.region): (r.x0, r.y0, r.x1, r.y1, r.area, r.kind, r.members) for r in regions.merge_regions(spark.createDataFrame(rows, BOXES)).collect()}
    assert got[0, 1] == (0, 0, 130, 130, 1000, "bubble", 2) and got[3, 7] == (5, 5, 5, 9, 2, "same", 2)
    assert set(got) == {(0, 1), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7)}


@pytest.mark.parametrize("cell, crowded", [(256, 200), (64, 5), (16, 1)])
def test_merged_regions(spark, cell, crowded):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        page = rng.choice([1, 1, 1, 2, 3])
        x, y = rng.randrange(-100, 500), rng.randrange(500)
        rows.append((page, i, x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 90), rng.randrange(5), rng.choice("ab")))
    rows += [(1, 200 + i, *rows[0][2:6], 9, "c") for i in range(20)]
    got = sorted((r.page, r.region, r.x0, r.y0, r.x1, r.y1, r.area, r.kind, r.members) for r in regions.merge_regions(spark.createDataFrame(rows, BOXES), cell=cell, crowded=crowded).collect())
    assert got == merged(rows)


def test_no_regions(spark):
    assert regions.merge_regions(spark.createDataFrame([], BOXES)).count() == 0


def roomy(text, ink):
    """The largest free box, pixel by pixel."""
    rx0, ry0, rx1, ry1, tx0, ty0, tx1, ty1 = text
    w, h = rx1 - rx0, ry1 - ry0
    if w < 8 or h < 8:
        return rx0, ry0, rx1, ry1
    dark = {(x, y) for x0, y0, x1, y1 in ink if (x1 - x0) * (y1 - y0) >= 6 for x in range(max(x0, rx0), min(x1, rx1)) for y in range(max(y0, ry0), min(y1, ry1))}
    dark = {(x - rx0, y - ry0) for x, y in dark if not (tx0 - 2 <= x < tx1 + 2 and ty0 - 2 <= y < ty1 + 2)}
    cx, cy = min(max((tx0 + tx1) // 2 - rx0, 0), w - 1), min(max((ty0 + ty1) // 2 - ry0, 0), h - 1)
    free = []
    for y in range(h):
        left = right = cx
        while left >= 0 and (left, y) not in dark:
            left -= 1
        while right < w and (right, y) not in dark:
            right += 1
        free.append((cx - left - 1) + (right - cx - 1))
    best, least = (0, 0, 0), 1 << 30
    for half in range(min(cy, h - 1 - cy) + 1):
        least = min(least, free[cy - half], free[cy + half])
        if least >= 6 and least * (2 * half + 1) > best[0]:
            best = (least * (2 * half + 1), least, half)
    if best[1] < 6:
        return rx0, ry0, rx1, ry1
    x, y = max(0, cx - best[1] // 2), max(0, cy - best[2])
    return rx0 + x, ry0 + y, rx0 + min(w, x + best[1]), ry0 + min(h, y + 2 * best[2] + 1)


@pytest.mark.parametrize("band", [64, 7])
def test_free_space(spark, band):
    rng = random.Random(6)
    texts, ink = [], []
    for region in range(60):
        x, y, w, h = rng.randrange(-20, 100), rng.randrange(-20, 100), rng.choice([5, 9, 40, 80]), rng.choice([6, 8, 50, 90])
        a, b = x + rng.randrange(-5, w), y + rng.randrange(-5, h)
        texts.append((region % 4, region, x, y, x + w, y + h, a, b, a + rng.randrange(30), b + rng.randrange(30)))
    for _ in range(40):
        x, y = rng.randrange(-20, 180), rng.randrange(-20, 180)
        ink.append((rng.randrange(5), x, y, x + rng.randrange(1, 12), y + rng.randrange(1, 12)))
    frame = spark.createDataFrame(texts, "page int, region long, rx0 int, ry0 int, rx1 int, ry1 int, tx0 int, ty0 int, tx1 int, ty1 int")
    got = {r.region: (r.x0, r.y0, r.x1, r.y1) for r in regions.free_space(frame, spark.createDataFrame(ink, "page int, x0 int, y0 int, x1 int, y1 int"), band).collect()}
    assert got == {t[1]: roomy(t[2:], [i[1:] for i in ink if i[0] == t[0]]) for t in texts}


def test_free_space_has_no_row_for_a_pixel_row(spark):
    texts = spark.createDataFrame([(1, 1, 0, 0, 100, 100, 40, 40, 60, 60), (1, 2, 0, 0, 5, 5, 1, 1, 2, 2), (2, 3, None, 0, 90, 90, 1, 1, 2, 2)], "page int, region long, rx0 int, ry0 int, rx1 int, ry1 int, tx0 int, ty0 int, tx1 int, ty1 int")
    ink = spark.createDataFrame([(1, 10, 20, 30, 40), (1, 80, 45, 90, 50)], "page int, x0 int, y0 int, x1 int, y1 int")
    found = regions.free_space(texts, ink)
    # region and ink meet, and that is all
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.region: tuple(r)[1:] for r in found.collect()} == {1: roomy((0, 0, 100, 100, 40, 40, 60, 60), [(10, 20, 30, 40), (80, 45, 90, 50)]), 2: (0, 0, 5, 5), 3: (None, 0, 90, 90)}


def runs(flags, gap):
    out, start, last = [], None, None
    for i, flag in enumerate(flags):
        if flag:
            if start is None:
                start = i
            elif i - last - 1 > gap:
                out.append((start, last))
                start = i
            last = i
    return out + ([(start, last)] if start is not None else [])


def words_of(ink, right_to_left):
    """Bands of rows, then of columns, on the page's pixels, twice as large where it is small."""
    x1, y1 = max(b[2] for b in ink), max(b[3] for b in ink)
    zoom = 2 if max(x1 - min(b[0] for b in ink), y1 - min(b[1] for b in ink)) < 512 else 1
    dark = {(x, y) for a, b, c, d in ink for x in range(a * zoom, c * zoom) for y in range(b * zoom, d * zoom)}
    out = []
    for top, bottom in runs([any((x, y) in dark for x in range(x1 * zoom)) for y in range(y1 * zoom)], zoom):
        gap = max(2, round(0.35 * (bottom - top + 1)))
        columns = runs([any((x, y) in dark for y in range(top, bottom + 1)) for x in range(x1 * zoom)], gap)
        out.append([(a // zoom, top // zoom, (b + 1) // zoom, (bottom + 1) // zoom) for a, b in columns])
    middle = lambda values: sorted(values)[len(values) // 2] if values else 0
    height = max(1, middle([line[0][3] - line[0][1] for line in out]))
    gap = max(1, round(0.2 * height), middle([max(0, b[0][1] - a[0][3]) for a, b in zip(out, out[1:], strict=False)]))
    space = max(2, middle([s for line in out for a, b in zip(line, line[1:], strict=False) if (s := b[0] - a[2]) > 0]))
    return [(n, k, *box, height, gap, space) for n, line in enumerate(out) for k, box in enumerate(sorted(line, reverse=right_to_left))]


def test_words_of_ink(spark):
    rng = random.Random(8)
    pages = {}
    for page in range(12):
        size = 700 if page % 3 == 0 else 90
        pages[page] = [(x, y, x + rng.randrange(1, 8), y + rng.randrange(1, 5)) for x, y in ((rng.randrange(size), rng.choice([0, 2, 9, 11, 30, 33, 34, 60])) for _ in range(40))]
    frame = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs] + [(0, 5, 5, 5, 9)], "page int, x0 int, y0 int, x1 int, y1 int")
    got = sorted(tuple(r) for r in regions.segment_words(frame, F.col("page") % 2 == 0).collect())
    assert got == sorted((p, *w) for p, bs in pages.items() for w in words_of(bs, p % 2 == 0))
    first, second = (next(r for r in got if r[0] == 0 and r[2] == k) for k in (0, 1))
    assert first[3] > second[3]  # right to left: the first word is the one on the right


def test_rows_of_lines(spark):
    rng = random.Random(9)
    lines = [(i % 5, i, *(lambda x, y: (x, y, x + rng.randrange(0, 40), y + rng.randrange(0, 15)))(rng.choice([0, 50, 100]), rng.randrange(80))) for i in range(120)]
    lines += [(9, 500, 0, 0, 5, 5), (9, 501, 0, 0, 5, 5), (9, 499, 0, 0, 5, 5)]
    got = sorted(tuple(r) for r in regions.reading_rows(spark.createDataFrame(lines, "page int, line long, x0 int, y0 int, x1 int, y1 int")).collect())
    want = []
    for page in {line[0] for line in lines}:
        rows = []
        for line in sorted((b for b in lines if b[0] == page and b[4] > b[2] and b[5] > b[3]), key=lambda b: (b[3], b[2], b[1])):
            for row in rows:
                head = row[0]
                if (min(head[5], line[5]) - max(head[3], line[3])) / min(head[5] - head[3], line[5] - line[3]) >= 0.5:
                    row.append(line)
                    break
            else:
                rows.append([line])
        want += [(page, line[1], r, k) for r, row in enumerate(rows) for k, line in enumerate(sorted(row, key=lambda b: b[2]))]
    assert got == sorted(want)


def wrapped(widths, capacity, space):
    lines, width = [], 0.0
    for w in widths:
        extra = w + (space if lines else 0)
        if not lines or width + extra > capacity:
            lines.append(1)
            width = w
        else:
            lines[-1] += 1
            width += extra
    return lines


def test_fitted_words(spark):
    rng = random.Random(10)
    rows = [(i, [rng.uniform(3, 60) for _ in range(rng.choice([0, 1, 2, 10, 60]))], rng.randrange(6, 20), rng.randrange(1, 6), rng.choice([10, 100, 300, 900]), rng.choice([8, 60, 200, 700])) for i in range(80)]
    got = {r.id: r for r in regions.fit_words(spark.createDataFrame(rows, "id int, widths array<double>, line_height int, word_gap int, box_w int, box_h int")).collect()}
    fitted = 0
    for i, widths, line, space, w, h in rows:
        pad = max(2, int(min(w, h) * 0.06))
        w, h, gap = max(1, w - 2 * pad), max(1, h - 2 * pad), max(1, round(0.2 * line))
        low, best = 1.06, None
        high = min(2.0, w / max(widths)) if len(widths) > 1 else 0
        for _ in range(20 if high >= low else 0):
            middle = (low + high) / 2
            n = len(wrapped(widths, w / middle, space))
            if n * line * middle + max(0, n - 1) * gap * middle <= h + 0.5:
                best = low = middle
            else:
                high = middle
        assert got[i].scale == best
        if best:
            fitted += 1
            lines = wrapped(widths, w / best, space)
            assert got[i].lines == lines and sum(lines) == len(widths)
            assert got[i].height <= h + 0.5 + 1e-9 and got[i].gap >= gap * best
    assert 20 < fitted < 70


def test_long_text_is_fitted_in_arrow_batches(spark):
    rows = [(1, [float(3 + k % 17) for k in range(40_000)], 10, 3, 500, 20_000), (2, None, 10, 3, 500, 100), (3, [5.0], 10, 3, 500, 100)]
    fitted = regions.fit_words(spark.createDataFrame(rows, "id int, widths array<double>, line_height int, word_gap int, box_w int, box_h int"))
    # a fold of the JVM takes each word and halving through an interpreted lambda
    assert "aggregate(" not in fitted._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in fitted.collect()}
    assert sum(got[1].lines) == 40_000 and got[1].lines == wrapped(rows[0][1], 440 / got[1].scale, 3) and got[2].scale is got[3].scale is None


def test_words_of_dealt_pages_stay(spark):
    """A page's steps follow each other without an exchange, and no step is done twice."""
    ink = spark.createDataFrame([(1, 0, 0, 4, 8), (1, 20, 0, 24, 8), (1, 0, 30, 4, 38)], "page int, x0 int, y0 int, x1 int, y1 int").repartition(3, "page")
    words = regions.segment_words(ink)
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r.line, r.word, r.line_height, r.line_gap, r.word_gap) for r in words.orderBy("line", "word").collect()] == [(0, 0, 8, 22, 16), (0, 1, 8, 22, 16), (1, 0, 8, 22, 16)]


@pytest.mark.parametrize("one_task, cell, crowded", [(0, 64, 5), (40, 256, 200), (512, 256, 200)])
def test_merged_on_one_task_or_in_cells(spark, one_task, cell, crowded):
    """Pages below the bound and above it, ties in area over several rounds, and a page whose area isn't known."""
    rng = random.Random(7)
    rows = []
    for i in range(200):
        page = rng.choice([1, 1, 1, 2, 3, 4])
        x, y = rng.randrange(-100, 400), rng.randrange(400)
        rows.append((page, i, x, y, x + rng.randrange(-2, 90), y + rng.randrange(-2, 90), rng.randrange(3), rng.choice("abc")))
    frame = spark.createDataFrame([*rows, (9, 900, 0, 0, 5, 5, None, "a"), (9, 901, 0, 0, 6, 5, None, "a")], BOXES)
    got = [(r.page, r.region, r.x0, r.y0, r.x1, r.y1, r.area, r.kind, r.members) for r in regions.merge_regions(frame, cell=cell, crowded=crowded, one_task=one_task).collect()]
    assert sorted(r for r in got if r[0] != 9) == merged(rows)
    assert [r for r in got if r[0] == 9] == [(9, 900, 0, 0, 6, 5, None, "a", 2)]
