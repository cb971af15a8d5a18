"""Laid-out pages: figure labels, title blocks, table grids, and the boxes of figures.

Clusters depend on the order of the lines of one page or table, which is small.
"""

from __future__ import annotations

import html
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.udf import vectorised

#: What a label is not, how a sentence ends, and a table's caption.
META, TERMINAL, CAPTION = r"[@:/\\]|^\[\d", r"[.!?;:»\"')\]…]$", r"(?i)^\s*(tabela|table)\s*\d"
#: Columns of a table, least distance of two, and shares of a line's height that keep cells and rows together.
COLUMNS, APART, CELL, ROW = (2, 14), 12, 0.8, 0.9
#: Gaps within which labels are one figure, and captions below and above one.
LABEL_GAP, LABEL_SIDE, BELOW, ABOVE = 110, 60, 110, 40


def figure_labels(lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Lines (doc, page, text, x0, y0, x1, y1, size, body_size, heading) with label: text that is drawn inside a figure.

    Short, smaller and narrower than the page's widest line, no footnote and no
    sentence, and not within one of the ``regions`` (doc, page, x0, y0, x1, y1)
    of captioned tables.
    """
    column = F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc", "page"))
    text = F.trim("text")
    small = (F.col("body_size") > 0) & (column >= 120) & (F.col("size") < F.col("body_size") * 0.94) & (F.col("x1") - F.col("x0") <= column * 0.5)
    wordy = (text != "") & (F.length(text) <= 40) & ~text.rlike(META) & ~text.rlike(TERMINAL) & text.rlike(r"[\p{L}\p{N}_]{4,}")
    out = lines.withColumn("label", F.coalesce(~F.col("heading") & small & wordy, F.lit(False)))
    if regions is None:
        return out
    kept = regions.select("doc", "page", F.struct("x0", "y0", "x1", "y1").alias("r")).groupBy("doc", "page").agg(F.collect_list("r").alias("__r"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.exists(F.col("__r"), lambda r: x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"]))
    return out.join(kept, ["doc", "page"], "left").withColumn("label", F.col("label") & ~F.coalesce(inside, F.lit(False))).drop("__r")


def table_regions(drawings: DataFrame, lines: DataFrame) -> DataFrame:
    """Drawn boxes (doc, page, x0, y0, x1, y1) beside a table's caption, a little larger."""
    captions = lines.filter(F.col("text").rlike(CAPTION)).select("doc", "page", F.col("y0").alias("__y0"), F.col("y1").alias("__y1"))
    large = drawings.filter((F.col("x1") - F.col("x0") >= 60) & (F.col("y1") - F.col("y0") >= 20))
    near = (F.col("__y0") - F.col("y1")).between(-70, 90) | (F.col("y0") - F.col("__y1")).between(-90, 70)
    found = large.join(captions, ["doc", "page"]).filter(near).select("doc", "page", "x0", "y0", "x1", "y1").distinct()
    return found.select("doc", "page", (F.col("x0") - 6).alias("x0"), (F.col("y0") - 6).alias("y0"), (F.col("x1") + 6).alias("x1"), (F.col("y1") + 6).alias("y1"))


def title_block(lines: DataFrame, first_page: int = 0, tie: str = "line") -> DataFrame:
    """Lines (doc, page, text, heading) with front: those before the first heading of the first page, if they look like a title.

    An address or a star among them tells a title page, or that they are fewer than four.
    """
    first = F.col("page") == first_page
    w = Window.partitionBy("doc", "page").orderBy(tie)
    before = first & (F.max(F.col("heading").cast("int")).over(w) == 0)
    every = Window.partitionBy("doc", "page")
    some = F.max(F.col("heading")).over(every)
    marked = lines.withColumn("__b", before).withColumn("__h", some)
    looks = F.max(F.col("__b") & F.col("text").rlike(r"[@*]")).over(every) | (F.count_if(F.col("__b")).over(every) < 4)
    return marked.withColumn("front", F.coalesce(F.col("__b") & F.col("__h") & looks, F.lit(False))).drop("__b", "__h")


def grid(lines: list[tuple[float, float, float, str]]) -> list[list[str]] | None:
    """Rows of a table from its lines (x0, y0, y1, text), or None if they are none.

    Columns begin at least ``APART`` from each other; lines of a column that
    follow closely are one cell; cells with nearly the same centre are a row.
    """
    solid = [(x, y0, y1, t.strip()) for x, y0, y1, t in lines if t and t.strip()]
    starts: list[float] = []
    for x in sorted(x for x, *_ in solid):
        if not starts or x - starts[-1] > APART:
            starts.append(x)
    if len(solid) < 2 * COLUMNS[0] or not COLUMNS[0] <= len(starts) <= COLUMNS[1]:
        return None
    tall = median([y1 - y0 for _, y0, y1, _ in solid if y1 > y0] or [8.0]) or 8.0
    placed = sorted(((y0 + y1) / 2, min(range(len(starts)), key=lambda k, x=x: abs(starts[k] - x)), t) for x, y0, y1, t in solid)
    cells: list[tuple[float, int, str]] = []
    for centre, column, t in placed:
        if cells and cells[-1][1] == column and centre - cells[-1][0] <= CELL * tall:
            centre, t = (cells[-1][0] + centre) / 2, f"{cells.pop()[2]} {t}"
        cells.append((centre, column, t))
    rows: list[tuple[float, list[tuple[int, str]]]] = []
    for centre, column, t in sorted(cells, key=lambda c: c[0]):
        at = next((k for k, (y, _) in enumerate(rows) if abs(y - centre) <= ROW * tall), None)
        if at is None:
            rows.append((centre, [(column, t)]))
        else:
            rows[at] = (rows[at][0] + centre) / 2, [*rows[at][1], (column, t)]
    out = [[" ".join(t for c, t in sorted(row, key=lambda x: x[0]) if c == k) for k in range(len(starts))] for _, row in rows]
    return out if len(out) >= 2 and max(sum(map(bool, row)) for row in out) >= COLUMNS[0] else None


def table_xhtml(rows: list[list[str]], header: bool) -> str:
    cell = lambda kind, t: f"<{kind}>{html.escape(t)}</{kind}>"
    return "<table>" + "".join("<tr>" + "".join(cell("th" if header and not k else "td", t) for t in row) + "</tr>" for k, row in enumerate(rows)) + "</table>"


@vectorised("n_rows int, n_columns int, xhtml string")
def _grids(x0: pd.Series, y0: pd.Series, y1: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = (grid(list(zip(*(c.tolist() for c in line), strict=True))) for line in zip(x0, y0, y1, text, strict=True))
    return pd.DataFrame([(len(g), len(g[0]), table_xhtml(g, True)) if g else (None, None, None) for g in found], columns=["n_rows", "n_columns", "xhtml"]).astype({"n_rows": "Int32", "n_columns": "Int32"})


def tables(lines: DataFrame) -> DataFrame:
    """doc, page, table, n_rows, n_columns, xhtml of the lines (doc, page, table, x0, y0, y1, text) that make a grid.

    A table is a row of arrays, so that many small tables share a batch.
    """
    held = lines.groupBy("doc", "page", "table").agg(F.collect_list(F.struct("x0", "y0", "y1", "text")).alias("l"))
    made = held.select("doc", "page", "table", _grids(*[F.col(f"l.{c}") for c in ("x0", "y0", "y1", "text")]).alias("g"))
    return made.select("doc", "page", "table", "g.n_rows", "g.n_columns", "g.xhtml").filter("n_rows IS NOT NULL")


def boxes(labels: list[tuple[float, float, float, float]], captions: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """One box a figure from its labels' boxes, grown to a caption (its y0, y1) just below or above."""
    out: list[tuple[float, float, float, float]] = []
    for x0, y0, x1, y1 in sorted(labels, key=lambda b: b[1]):
        at = next((k for k, b in enumerate(out) if y0 - b[3] <= LABEL_GAP and x0 <= b[2] + LABEL_SIDE and x1 >= b[0] - LABEL_SIDE), None)
        if at is None:
            out.append((x0, y0, x1, y1))
        else:
            a = out[at]
            out[at] = min(a[0], x0), min(a[1], y0), max(a[2], x1), max(a[3], y1)

    def grown(box):
        x0, y0, x1, y1 = box
        for top, bottom in captions:
            if 0 <= top - y1 <= BELOW:
                return x0, y0, x1, max(y1, top - 4)
            if 0 <= y0 - bottom <= ABOVE:
                return x0, min(y0, top - 6), x1, y1
        return box

    return [grown(b) for b in out]


def _boxes(part: pd.DataFrame) -> pd.DataFrame:
    of = part[part["label"]]
    captions = part[part["caption"]].sort_values("y0")
    found = boxes(list(zip(of["x0"], of["y0"], of["x1"], of["y1"], strict=True)), list(zip(captions["y0"], captions["y1"], strict=True)))
    return pd.DataFrame([(part["doc"].iloc[0], part["page"].iloc[0], *b) for b in found], columns=["doc", "page", "x0", "y0", "x1", "y1"])


def figure_boxes(lines: DataFrame) -> DataFrame:
    """doc, page and box of each figure from lines (doc, page, x0, y0, x1, y1, label, caption)."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return lines.groupBy("doc", "page").applyInPandas(_boxes, f"doc {kinds['doc']}, page {kinds['page']}, x0 double, y0 double, x1 double, y1 double")
