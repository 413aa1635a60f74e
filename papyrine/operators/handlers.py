"""Execution around the engines as relations: tables from ruled lines, readings and their evidence, layout fallbacks, retries, isolation,
batches of pages, and the answers of the job interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import Box

# --- fixed values -----------------------------------------------------------------------------------------------------------
FIGURES = ("chart", "image", "seal")
VLM_TASKS = {"table": "table", "formula": "formula", "chart": "chart", "image": "image"}
RETRYABLE = (429, 500, 502, 503, 504)
MAX_UPLOAD = 200 * 1024 * 1024
# --- end of fixed values ----------------------------------------------------------------------------------------------------


def ruled_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-06: cells (keys, x0, y0, x1, y1) with `colspan` and `rowspan`: how many distinct column and row starts of their table,
    to one decimal, lie from half a point before the cell's start up to half a point before its end. A table's starts are one row, so
    cells meet them by an equi key and not by a range."""
    starts = cells.groupBy(*keys).agg(F.collect_set(F.round("x0", 1)).alias("_columns"), F.collect_set(F.round("y0", 1)).alias("_rows"))
    inside = lambda found, a, b: F.greatest(F.lit(1), F.size(F.filter(found, lambda s: (a - 0.5 <= s) & (s < b - 0.5))))
    made = cells.join(starts, keys)
    return made.withColumns({"colspan": inside(F.col("_columns"), F.col("x0"), F.col("x1")), "rowspan": inside(F.col("_rows"), F.col("y0"), F.col("y1"))}).drop("_columns", "_rows")


def on_page(box: Box, width: Column, height: Column) -> Box:
    """SRC-07: the part of the box on the page; empty ones (no width or height) are the caller's to drop."""
    return Box(F.greatest(box.x0, F.lit(0.0)), F.greatest(box.y0, F.lit(0.0)), F.least(box.x1, width), F.least(box.y1, height))


def pixel_matrix(rotation: Column, width: Column, height: Column, dpi: Column) -> Column:
    """SRC-24: (a, b, c, d, e, f) from unrotated page points to pixels: the page's turn by 0, 90, 180 or 270 degrees, then dpi / 72."""
    s = dpi / 72
    zero = F.lit(0.0)
    turn = {0: (s, zero, zero, s, zero, zero), 90: (zero, s, -s, zero, height * s, zero), 180: (-s, zero, zero, -s, width * s, height * s), 270: (zero, -s, s, zero, zero, width * s)}
    made = F.array(*turn[0])
    for angle in (90, 180, 270):
        made = F.when(rotation % 360 == angle, F.array(*turn[angle])).otherwise(made)
    return made


def robots_found(tries: DataFrame) -> DataFrame:
    """SRC-26: of each origin, from tries (origin, attempt from 0, status or null for no answer): of the first three the first answer
    under 500 decides: its rules with status 200, else everything allowed; without one nothing is. Also how long the waits were."""
    waits = F.collect_list(F.when(F.col("status").isNull() | (F.col("status") >= 500), F.col("attempt")))  # three at most
    rows = tries.where("attempt < 3").groupBy("origin").agg(F.min(F.when(F.col("status") < 500, F.struct("attempt", "status"))).alias("x"), waits.alias("w"), F.max("attempt").alias("last"))
    before = F.filter("w", lambda a: a < F.coalesce(F.col("x.attempt"), F.lit(9)))
    rows = rows.withColumn("waited", F.aggregate(before, F.lit(0).cast("long"), lambda acc, a: acc + 2 + 4 * a))
    rule = F.when(F.col("x").isNull(), "deny all").when(F.col("x.status") == 200, "rules").otherwise("allow all")
    return rows.select("origin", rule.alias("rule"), (F.coalesce("x.attempt", "last") + 1).alias("tries"), "waited")


def evaluation_jobs(candidates: DataFrame, per_kind: int, least: int = 20, share: float = 0.3) -> DataFrame:
    """SRC-28: candidates (kind, key, chars) with enough text, of each kind the per_kind least hashes, a rounded share of which is dev."""
    from .corpus import dev_test

    place = F.row_number().over(W.partitionBy("kind").orderBy(F.sha1("key"), "key"))
    chosen = candidates.where(F.col("chars") >= least).withColumn("place", place).where(F.col("place") <= per_kind).drop("place")
    return dev_test(chosen, "kind", "key", share)


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def block_html(kind: Column, value: Column, items: Column) -> Column:
    """SNK-12: one block of a ground-truth document as HTML; a table's value is HTML already."""
    listed = F.concat(F.lit("<"), kind, F.lit(">"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), escaped(i), F.lit("</li>"))), ""), F.lit("</"), kind, F.lit(">"))
    plain = F.concat(F.lit("<"), kind, F.lit(">"), escaped(value), F.lit("</"), kind, F.lit(">"))
    table = F.replace(value, F.lit("<table>"), F.lit('<table border="1" cellspacing="0" cellpadding="3">'))
    return F.when(kind.isin("ul", "ol"), listed).when(kind == "table", table).otherwise(plain)


def block_markdown(kind: Column, value: Column, items: Column) -> Column:
    """SNK-12: one block as Markdown."""
    numbered = F.transform(items, lambda i, n: F.concat((n + 1).cast("string"), F.lit(". "), i))
    bullets = F.transform(items, lambda i: F.concat(F.lit("- "), i))
    heading = F.concat(F.repeat(F.lit("#"), F.substring(kind, 2, 1).cast("int")), F.lit(" "), value)
    return F.when(kind == "ul", F.array_join(bullets, "\n")).when(kind == "ol", F.array_join(numbered, "\n")).when(kind.isin("h1", "h2", "h3"), heading).otherwise(value)


def written_blocks(blocks: DataFrame, doc: str, place: str, lang: Column) -> DataFrame:
    """SNK-12: blocks (doc, place, kind, value, items) to one HTML page and one Markdown text for each document, in their order."""
    made = blocks.select(doc, F.struct(F.col(place).alias("place"), block_html(F.col("kind"), F.col("value"), F.col("items")).alias("html"), block_markdown(F.col("kind"), F.col("value"), F.col("items")).alias("markdown"), F.col("value").alias("value"), lang.alias("lang")).alias("b"))
    made = made.groupBy(doc).agg(F.array_sort(F.collect_list("b")).alias("b"))
    head = F.concat(F.lit('<!DOCTYPE html><html lang="'), F.col("b")[0]["lang"], F.lit('"><head><meta charset="utf-8"><title>'), escaped(F.col("b")[0]["value"]), F.lit("</title></head><body>"))
    page = F.concat(head, F.array_join(F.transform("b", lambda x: x.html), "\n"), F.lit("</body></html>"))
    return made.select(doc, page.alias("html"), F.array_join(F.transform("b", lambda x: x.markdown), "\n\n").alias("markdown"))


def crop_size(width: Column, height: Column, least: int = 48, pad: int = 12) -> tuple[Column, Column]:
    """IMG-04: the size of a crop made ready for reading: low ones scaled up to `least`, then a margin."""
    factor = least / F.greatest(height, F.lit(1))
    w = F.when(height < least, F.greatest(F.lit(1), F.bround(width * factor, 0).cast("int"))).otherwise(width)
    return w + 2 * pad, F.greatest(height, F.lit(least)) + 2 * pad


def second_size(width: Column, height: Column) -> tuple[Column, Column]:
    """IMG-04: the size of a crop for the second reading."""
    factor = F.when(F.greatest(width, height) > 2000, 0.75).otherwise(1.5)
    return tuple(F.greatest(F.lit(1), F.bround(x * factor, 0).cast("int")) for x in (width, height))


def reading(lines: Column) -> Column:
    """EX-06, UDF-09: of lines (array of struct text, score): the text, the trusted text (scores of 0.9 and more), scores to 4 digits, and
    the confidence, weighted by the lines' lengths; null without lines."""
    weight = lambda x: F.greatest(F.lit(1), F.length(x.text))
    total = lambda f: F.aggregate(lines, F.lit(0.0), lambda acc, x: acc + f(x))
    confidence = F.when(F.size(lines) > 0, total(lambda x: x.score * weight(x)) / total(lambda x: weight(x).cast("double")))
    return F.struct(
        F.array_join(F.transform(lines, lambda x: x.text), "\n").alias("text"), F.array_join(F.transform(F.filter(lines, lambda x: x.score >= 0.9), lambda x: x.text), " ").alias("trusted_text"),
        F.transform(lines, lambda x: F.round(x.score, 4)).alias("line_scores"), confidence.alias("confidence"),
    )


def table_evidence(kind: Column, confidence: Column, ocr_text: Column, html: Column) -> Column:
    """EX-06: a table engine's result: confidence 0 without a table, its text as evidence if it is trusted."""
    return F.struct(F.when(html.isNull() | (html == ""), 0.0).otherwise(confidence).alias("confidence"), F.when((F.coalesce(confidence, F.lit(0.0)) >= 0.9) & (F.coalesce(html, F.lit("")) != ""), F.nullif(ocr_text, F.lit(""))).alias("trusted_text"), kind.alias("type"))


def figure_text(regions: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """EX-07: regions (region_id, type, status, method, content, text_layer) with `figure_text` of pictures that weren't skipped: a seal's own
    reading, else the text layer, else what `ocr` (region_id, ocr_text, error) read without error; stripped. The VLM is never asked."""
    rows = regions if ocr is None else regions.join(ocr.select("region_id", F.when(F.col("error").isNull(), F.col("ocr_text")).alias("_read")), "region_id", "left")
    read = F.lit(None).cast("string") if ocr is None else F.col("_read")
    text = F.when((F.col("type") == "seal") & (F.col("method") == "ocr"), F.col("content")).when(F.coalesce("text_layer", F.lit("")) != "", F.col("text_layer")).otherwise(read)
    return rows.withColumn("figure_text", F.when(F.col("type").isin(*FIGURES) & (F.col("status") != "skipped"), F.trim(text))).drop("_read")


def needs_table_evidence(kind: Column, text_layer: Column, trusted: Column) -> Column:
    """EX-07: tables read by OCR before the VLM is asked, so that its numbers can be held against something."""
    return (kind == "table") & (F.coalesce(text_layer, F.lit("")) == "") & (F.coalesce(trusted, F.lit("")) == "")


def vlm_request(kind: Column, figure: Column, text_layer: Column) -> Column:
    """EX-14: the task of a region's type and the hint that goes with it."""
    task = F.lit(None).cast("string")
    for name, of in VLM_TASKS.items():
        task = F.when(kind == name, of).otherwise(task)
    return F.struct(task.alias("task"), F.nullif(F.when(kind.isin(*FIGURES), figure).otherwise(text_layer), F.lit("")).alias("hint"))


def with_figure_text(data: Column, text: Column) -> Column:
    """EX-14: a figure's data (a map) with its text."""
    return F.when(text.isNull(), data).otherwise(F.map_concat(F.map_filter(F.coalesce(data, F.create_map().cast("map<string,string>")), lambda k, _: k != "figure_text"), F.create_map(F.lit("figure_text"), F.trim(text))))


def page_layouts(pages: DataFrame, detected: DataFrame | None, heuristic: DataFrame) -> DataFrame:
    """EX-08: candidates (page, type, x0..y1, score, label, backend) of each page: what the model detected, where it answered (detected has
    the page, with a null type for a page without boxes); else the heuristic's on digital pages; else one text region of the whole page."""
    columns = ["page", "type", "x0", "y0", "x1", "y1", "score", "label", "backend"]
    if detected is None:
        answered, out = pages.where("false").select("page"), None
    else:
        answered = detected.select("page").distinct()
        out = detected.where("type is not null").withColumn("score", F.round("score", 4)).withColumn("backend", F.lit("model")).select(*columns)
    rest = pages.join(answered, "page", "left_anti")
    ruled = heuristic.join(rest.where("kind = 'digital'").select("page"), "page").withColumn("backend", F.lit("pdf-heuristic")).select(*columns)
    full = rest.where("kind <> 'digital'").select("page", F.lit("text").alias("type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"), F.lit(None).cast("double").alias("score"), F.lit("full_page").alias("label"), F.lit("full-page").alias("backend"))
    made = ruled.unionByName(full)
    return made if out is None else out.unionByName(made)


def retried(answers: Column, most: int = 2, formatted: Column | None = None) -> Column:
    """EX-09: what comes of a request whose answers are an array of statuses (null: no connection), asked one after the other: struct of
    outcome (ok, error, gave up), retries and seconds waited. The first 400 of a request with a response format only drops
    the format; retryable answers are asked again `most` times after 2^n seconds, at most 30."""
    again = lambda s: s.isNull() | s.isin(*RETRYABLE)
    start = F.struct(F.lit(None).cast("string").alias("outcome"), F.lit(0).alias("retries"), F.lit(0.0).alias("waited"), (F.lit(True) if formatted is None else formatted).alias("formatted"))

    def step(acc, s):
        waits = again(s) & (acc.retries < most)
        over = F.when(again(s) & (acc.retries >= most), "gave up").when(again(s), None).when((s == 400) & acc.formatted, None).when(s < 400, "ok").otherwise("error")
        now = F.struct(over.alias("outcome"), (acc.retries + waits.cast("int")).alias("retries"), (acc.waited + F.when(waits, F.least(F.lit(30.0), F.pow(F.lit(2.0), acc.retries + 1))).otherwise(0.0)).alias("waited"), (acc.formatted & (again(s) | (s != 400))).alias("formatted"))
        return F.when(acc.outcome.isNotNull(), acc).otherwise(now)

    made = F.aggregate(answers, start, step)
    return F.struct(made["outcome"].alias("outcome"), made["retries"].alias("retries"), made["waited"].alias("waited"))


def isolated(runs: DataFrame, worker: str, order: str, memory: float, timeout: float, share: float = 0.88) -> DataFrame:
    """EX-10: runs (worker, order, rss, seconds) with `state` (ok, memory, timeout) and `generation`: the process of the worker that ran it,
    a new one after each breach."""
    state = F.when(F.col("rss") > share * memory, "memory").when(F.col("seconds") > timeout, "timeout").otherwise("ok")
    before = W.partitionBy(worker).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("state", state).withColumn("generation", F.coalesce(F.count_if(F.col("state") != "ok").over(before), F.lit(0)))


def page_batches(pages: DataFrame, doc: str, size: int = 8) -> DataFrame:
    """EX-12: pages (doc, number from 1, ms) with their batch and `duration_ms`, the batch's time shared evenly."""
    rows = pages.withColumn("batch", F.floor((F.col("number") - 1) / size).cast("int"))
    each = rows.groupBy(doc, "batch").agg(F.round(F.sum("ms") / F.count(F.lit(1)), 1).alias("duration_ms"))
    return rows.join(each, [doc, "batch"])


def line_timings(lines: DataFrame, system: str, order: str, warm: int = 8, batch: int = 64) -> DataFrame:
    """EX-15: lines (system, order, ms, error) by system: batches, ms a line after the warm-up, or the first error, which ends the
    system's run but no other's."""
    rows = lines.withColumn("rn", F.row_number().over(W.partitionBy(system).orderBy(order)))
    made = rows.groupBy(system).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("rn"))).alias("error"), F.count(F.lit(1)).alias("lines"), F.avg(F.when(F.col("rn") > warm, F.col("ms"))).alias("ms"))
    good = F.col("error").isNull()
    return made.select(system, F.substring("error", 1, 300).alias("error"), F.when(good, F.ceil(F.col("lines") / batch)).alias("batches"), F.when(good, F.round("ms", 1)).alias("ms_per_line"))


def timed(pages: Column, ms: Column, suffix: Column) -> Column:
    """EX-16: pages (1 for what isn't a PDF), duration and time a page of a comparison system's document."""
    n = F.when(F.lower(suffix) == "pdf", F.coalesce(pages, F.lit(1))).otherwise(1)
    return F.struct(n.alias("pages_processed"), F.round(ms, 1).alias("duration_ms"), F.round(ms / F.greatest(F.lit(1), n), 1).alias("ms_per_page"))


def answer(route: Column, size: Column, supported: Column, pages_ok: Column, state: Column) -> Column:
    """SNK-11: the status that the job interface answers with. route: extract, create, job, markdown; state: of the job asked for, or null."""
    upload = F.when(size == 0, 400).when(size > MAX_UPLOAD, 413).when(~pages_ok, 422)
    return (
        F.when(route == "extract", F.coalesce(upload, F.when(~supported, 415), F.lit(200)))
        .when(route == "create", F.coalesce(upload, F.lit(202)))
        .when(state.isNull(), 404)
        .when((route == "markdown") & (state != "done"), 409)
        .otherwise(200)
    )


def wanted(backend: Column, installed: Column) -> Column:
    """UDF-02: whether a stage's engine is made: never for none and heuristic, else if it is installed; null where one is asked for by
    name that isn't, which is an error."""
    return F.when(backend.isin("none", "heuristic"), False).when((backend == "paddle") & ~installed, None).otherwise(installed)
