"""Page layout: lines in regions, clean-up of candidate boxes, block classes, reading order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box

# --- fixed values: detector labels by region type ---------------------------------------------------------------------
LABELS = {
    "title": ["doc_title", "title"],
    "heading": ["paragraph_title", "section_title"],
    "text": ["text", "plain_text", "abstract", "content", "reference", "reference_content", "aside_text", "vertical_text", "formula_number"],
    "list": ["list"],
    "table": ["table"],
    "formula": ["formula", "display_formula", "inline_formula", "isolate_formula"],
    "image": ["image", "figure"],
    "chart": ["chart"],
    "caption": ["figure_title", "table_title", "chart_title", "figure_table_chart_title", "figure_caption", "table_caption"],
    "footnote": ["vision_footnote", "table_footnote", "footnote", "footnotes"],
    "header": ["header", "header_image"],
    "footer": ["footer", "footer_image"],
    "page_number": ["number", "page_number"],
    "seal": ["seal"],
    "code": ["algorithm", "code"],
}
CONTAINERS = ("table", "chart", "image", "formula", "seal")
FURNITURE = ("header", "footer", "page_number")
MATH_FONT = r"(math|cmmi|cmsy|cmex|symbol|stix|cambria ?math)"
PAGE_NUMBER = r"(?i)^[-–\s]*(?:(?:page|trang)\s*)?\d{1,4}(?:\s*(?:/|of|trên)\s*\d{1,4})?\s*(?:ページ|頁)?[-–\s]*$"
CAPTION = r"(?i)^\s*(figure|fig\.|table|chart|hình|bảng|biểu đồ|sơ đồ|図|表|グラフ)\s*[0-9０-９]*"
# --- end of fixed values --------------------------------------------------------------------------------------------------


def region_type(label: Column) -> Column:
    """FLT-03."""
    key = F.translate(F.lower(F.trim(label)), " -", "__")
    out = F.lit("other")
    for kind, labels in LABELS.items():
        out = F.when(key.isin(*labels), kind).otherwise(out)
    return out


def page_kind(chars: Column, garbled: Column, coverage: Column, trusted: Column, least: int = 20, most: float = 0.02) -> Column:
    """FLT-01."""
    return F.when((chars < least) | (garbled > most), "scanned").when((coverage > 0.85) & ~trusted, "scanned").otherwise("digital")


def lines_in(lines: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """JN-01: lines whose centre lies in a region of the same page; the page is the equi key, so never a cross join."""
    at = Box.of("l_")
    inside = Box.of("r_").contains(at.cx(), at.cy())
    return lines.join(regions, keys).where(inside)


def orphans(lines: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """JN-02: lines whose centre lies in no region of their page."""
    at = Box.of("l_")
    same = [lines[k] == regions[k] for k in keys]
    condition = Box.of("r_").contains(at.cx(), at.cy())
    for k in same:
        condition &= k
    return lines.join(regions, condition, "left_anti")


def without_contained(boxes: DataFrame, keys: list[str], share: float = 0.85) -> DataFrame:
    """JN-04: without the boxes (no containers or captions) that a container of their page covers beyond the share."""
    names = [f"c_{c}" for c in ("x0", "y0", "x1", "y1")]
    containers = boxes.where(F.col("type").isin(*CONTAINERS)).select(*[F.col(k).alias(f"c_{k}") for k in keys], *[F.col(n[2:]).alias(n) for n in names])
    condition = ~F.col("type").isin(*CONTAINERS, "caption") & (Box.of().coverage_by(Box.of("c_")) > share)
    for k in keys:
        condition &= F.col(k) == F.col(f"c_{k}")
    return boxes.join(containers, condition, "left_anti")


def by_page(boxes: DataFrame, keys: list[str], work: Callable[[list[dict]], list[dict]], schema: T.StructType) -> DataFrame:
    """work over the rows of each page. Pages are dealt out and sorted by key and read as a stream: a call for each page would cost
    more than its few boxes. A page is never cut between tasks; one page is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        key, page = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key and page:
                    out += work(page)
                    page = []
                key = own
                page.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if page:
            yield pa.RecordBatch.from_pylist(work(page), arrow)

    return boxes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def without_near_duplicates(boxes: DataFrame, keys: list[str], most: float = 0.8) -> DataFrame:
    """JN-03: greedy by score (null counts as 1), then by place; a box goes if it overlaps one kept before it."""

    def work(page: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for box in sorted(page, key=lambda b: (-(1.0 if b["score"] is None else b["score"]), b["idx"])):
            if not any(_iou(box, other) > most for other in kept):
                kept.append(box)
        return kept

    return by_page(boxes, keys, work, boxes.schema)


def _iou(a: dict, b: dict) -> float:
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    common = max(0.0, w) * max(0.0, h)
    size = lambda r: max(0.0, r["x1"] - r["x0"]) * max(0.0, r["y1"] - r["y0"])
    both = size(a) + size(b) - common
    return common / both if both > 0 else 0.0


def beside_figures(blocks: DataFrame, figures: DataFrame, keys: list[str], gap: float = 36.0) -> DataFrame:
    """JN-05: blocks with a figure of their page close above or below."""
    condition = Box.of().near(Box.of("f_"), gap)
    for k in keys:
        condition &= F.col(k) == F.col(f"f_{k}")
    return blocks.join(figures, condition, "left_semi")


def is_math_line(fonts: Column) -> Column:
    """FLT-05."""
    return F.exists(fonts, lambda f: F.lower(f).rlike(MATH_FONT))


def figure_images(images: DataFrame, tables: DataFrame, keys: list[str], page_area: float) -> DataFrame:
    """FLT-04: embedded images that are neither background nor decoration (0.2 % to 95 % of the page) nor half inside a table."""
    own, table = Box.of(), Box.of("t_")
    condition = own.coverage_by(table) > 0.5
    for k in keys:
        condition &= F.col(k) == F.col(f"t_{k}")
    named = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*keys, "x0", "y0", "x1", "y1")])
    return images.where(own.area().between(0.002 * page_area, 0.95 * page_area)).join(named, condition, "left_anti")


def figure_drawings(items: DataFrame, keys: list[str], page_area: float, most_text: int = 400) -> DataFrame:
    """FLT-04: drawings that are charts: of 2 % of the page and 40 points a side, in no candidate by half nor half around one, with at
    most `most_text` characters inside. items: keys, idx, kind (candidate, drawing, line), box, chars. A drawing that is taken is a
    candidate for those after it, in the order of idx."""

    def share(a: dict, b: dict) -> float:
        size = max(0.0, a["x1"] - a["x0"]) * max(0.0, a["y1"] - a["y0"])
        w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        return max(0.0, w) * max(0.0, h) / size if size > 0 else 0.0

    def holds(a: dict, b: dict) -> bool:
        return a["x0"] <= (b["x0"] + b["x1"]) / 2 <= a["x1"] and a["y0"] <= (b["y0"] + b["y1"]) / 2 <= a["y1"]

    def work(page: list[dict]) -> list[dict]:
        taken = [x for x in page if x["kind"] == "candidate"]
        lines = [x for x in page if x["kind"] == "line"]
        out = []
        for x in sorted((x for x in page if x["kind"] == "drawing"), key=lambda x: x["idx"]):
            w, h = max(0.0, x["x1"] - x["x0"]), max(0.0, x["y1"] - x["y0"])
            if w * h < 0.02 * page_area or w < 40 or h < 40 or any(share(x, c) > 0.5 or share(c, x) > 0.5 for c in taken):
                continue
            if sum(line["chars"] or 0 for line in lines if holds(x, line)) <= most_text:
                taken.append(x)
                out.append(x)
        return out

    return by_page(items, keys, work, items.schema)


def block_class(text: Column, n_lines: Column, size: Column, body: Column, largest: Column, box: Box, page_height: Column, page: Column, math_lines: Column, all_bold: Column, list_lines: Column, near_figure: Column) -> Column:
    """FLT-02: rules in order."""
    short = (F.length(text) <= 150) & (n_lines <= 3)
    margin = 0.07 * page_height
    top, bottom = box.y1 <= margin, box.y0 >= page_height - margin
    ends = lambda signs: F.substring(text, -1, 1).isin(*signs)
    return (
        F.when(short & (top | bottom) & text.rlike(PAGE_NUMBER), "page_number")
        .when(short & top, "header")
        .when(short & bottom, "footer")
        .when(math_lines > 0.5 * n_lines, "formula")
        .when(text.rlike(CAPTION) & near_figure, "caption")
        .when(short & (size >= 1.15 * body) & ~ends(".,;") & (page == 1) & (size >= largest - 0.5) & (size >= 1.5 * body) & (box.y0 < 0.4 * page_height), "title")
        .when(short & (size >= 1.15 * body) & ~ends(".,;"), "heading")
        .when(short & (n_lines <= 2) & all_bold & ~ends(".,;:"), "heading")
        .when(list_lines >= F.greatest(F.lit(1.0), 0.5 * n_lines), "list")
        .otherwise("text")
    )


def body_font_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """AG-02: the size with most characters; on ties the one met first."""
    by = lines.groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("w"), F.min("line_no").alias("first"))
    return by.groupBy(*keys).agg(F.max_by("size", F.struct("w", -F.col("first"), "size")).alias("body_size"))


# --- reading order ----------------------------------------------------------------------------------------------------------


def _rows(items: list[dict]) -> list[dict]:
    """Rows from the top; boxes that share most of their height are one row, read from the left."""
    rows: list[list[dict]] = []
    for b in sorted(items, key=lambda b: (b["y0"], b["x0"])):
        if rows:
            top, bottom = min(r["y0"] for r in rows[-1]), max(r["y1"] for r in rows[-1])
            if min(bottom, b["y1"]) - max(top, b["y0"]) > 0.5 * min(b["y1"] - b["y0"], bottom - top):
                rows[-1].append(b)
                continue
        rows.append([b])
    return [b for row in rows for b in sorted(row, key=lambda b: b["x0"])]


def _ordered(items: list[dict], gap: float, depth: int = 0) -> list[dict]:
    if len(items) < 2 or depth > 6:
        return _rows(items)
    columns: list[list[dict]] = []
    edge = float("-inf")
    for b in sorted(items, key=lambda b: b["x0"]):
        if b["x0"] > edge + gap:
            columns.append([])
        columns[-1].append(b)
        edge = max(edge, b["x1"])
    if len(columns) > 1:
        return [b for c in columns for b in _ordered(c, gap, depth + 1)]
    extent = max(1e-6, max(b["x1"] for b in items) - min(b["x0"] for b in items))
    wide = sorted((b for b in items if b["x1"] - b["x0"] >= 0.6 * extent), key=lambda b: b["y0"])
    rest = [b for b in items if b["x1"] - b["x0"] < 0.6 * extent]
    if not wide or not rest:
        return _rows(items)
    out: list[dict] = []
    middle = lambda b: (b["y0"] + b["y1"]) / 2
    for w in wide:
        above = [b for b in rest if middle(b) < middle(w)]
        rest = [b for b in rest if middle(b) >= middle(w)]
        out += _ordered(above, gap, depth + 1) + [w]
    return out + _ordered(rest, gap, depth + 1)


def order_boxes(boxes: list[dict], page_width: float | None = None) -> list[dict]:
    """WN-02 for one page: headers, then columns between wide blocks, then footers and page numbers."""
    if not boxes:
        return []
    gap = max(2.0, 0.01 * (page_width or max(b["x1"] for b in boxes)))
    first = [b for b in boxes if b["type"] == "header"]
    last = [b for b in boxes if b["type"] in ("footer", "page_number")]
    return _rows(first) + _ordered([b for b in boxes if b["type"] not in FURNITURE], gap) + _rows(last)


def reading_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """WN-01, WN-02: boxes with `order` (from 1) and `region_id`."""

    def work(page: list[dict]) -> list[dict]:
        return [box | {"order": i} for i, box in enumerate(order_boxes(sorted(page, key=lambda b: b["idx"])), 1)]

    schema = T.StructType([*boxes.schema.fields, T.StructField("order", T.IntegerType())])
    return by_page(boxes, keys, work, schema).withColumn("region_id", F.concat(F.lit("p"), F.col(keys[-1]), F.lit("-r"), F.col("order")))
