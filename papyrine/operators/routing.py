"""Routing of regions to methods, figure policy, and validation of results, as conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx

#: Thresholds. Fixed values.
SETTINGS = {
    "complex_table_cells": 120, "complex_area": 0.45, "min_figure_area": 0.002, "min_image_area": 0.01, "number_match_min": 0.9, "max_garbled": 0.02, "max_dropout": 0.08,
    "min_agreement": 0.9, "min_confidence": 0.85, "low_line": 0.6, "max_low_lines": 0.25, "table_min_confidence": 0.8, "table_max_empty": 0.6, "formula_run": 10, "formula_chars": 3000,
}
TEXT_LIKE = ("title", "heading", "text", "list", "caption", "footnote", "header", "footer", "page_number", "code", "other")
TEXTUAL_KINDS = ("chart", "diagram", "flowchart", "screenshot", "table", "text")
REFUSAL = r"(?i)^(i'?m sorry|sorry,|i cannot|i can't|i am unable|as an ai|unable to (read|process))"
METHODS = ("pdf_text", "pdf_table", "docx", "ocr", "table_recognition", "formula_recognition", "vlm")


def _strings(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def plan(kind: Column, page_kind: Column, area: Column, chars: Column, cells: Column, full_page: Column, available: tuple[str, ...] = METHODS, describe_images: bool = True) -> Column:
    """FLT-06, FLT-07: struct of the methods to try in order (`plan`), `note` and `drop`."""
    has_text = (page_kind == "digital") & (chars > 0)
    source = F.when(has_text, _strings("pdf_text")).otherwise(_strings("ocr"))
    big = (F.coalesce(cells, F.lit(0)) > SETTINGS["complex_table_cells"]) | (area > SETTINGS["complex_area"])
    middle = F.when(big & F.lit("vlm" in available), _strings("vlm", "table_recognition")).otherwise(_strings("table_recognition", "vlm"))
    picture = kind.isin("chart", "image") & ~full_page
    drop = picture & (kind == "image") & (area < SETTINGS["min_figure_area"])
    small = picture & (kind == "image") & (area < SETTINGS["min_image_area"])
    chain = (
        F.when(full_page, _strings("ocr"))
        .when(kind == "table", F.concat(F.when(has_text, _strings("pdf_table")).otherwise(_strings()), middle, source))
        .when(kind == "formula", F.concat(_strings("formula_recognition", "vlm"), source))
        .when(drop | small | (picture & F.lit(not describe_images)), _strings())
        .when(picture, _strings("vlm"))
        .otherwise(F.concat(source, _strings("ocr")))
    )
    methods = F.filter(F.array_distinct(chain), lambda m: m.isin(*available))
    note = (
        F.when(drop, "decorative image")
        .when(picture & F.lit(not describe_images), "kept as figure: image description disabled")
        .when(small, "kept as figure: small image (logo/icon)")
        .when(picture & (F.size(methods) == 0), "kept as figure: no VLM configured")
    )
    return F.struct(methods.alias("plan"), note.alias("note"), drop.alias("drop"))


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def _issues(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(said) if isinstance(said, str) else said) for test, said in pairs]))


def available(method: Column, engines: tuple[str, ...]) -> Column:
    """FLT-07: methods that read the file itself are always there, the others if an engine is registered."""
    return method.isin("pdf_text", "pdf_table", "docx") | method.isin(*engines) if engines else method.isin("pdf_text", "pdf_table", "docx")


def evidence(text_layer: Column, trusted: Column) -> Column:
    """VAL-01: the text to check results against, and whether it is complete: the text layer, else the trusted reading."""
    layer = F.when(tx.strip(text_layer) != "", text_layer)
    return F.struct(F.coalesce(layer, trusted, F.lit("")).alias("text"), layer.isNotNull().alias("complete"))


def number_issues(candidate: Column, reference: Column, complete: Column) -> Column:
    """VAL-02 on NFKC texts: what the candidate lost or added against the evidence; nothing if the evidence has no numbers."""
    signs = F.array_distinct(F.regexp_extract_all(reference, F.lit(f"[{tx.SPECIAL}]"), F.lit(0)))
    times = lambda c, s: F.length(c) - F.length(F.replace(c, s, F.lit("")))
    least = SETTINGS["number_match_min"]

    def shares(x: Column) -> Column:
        lost = F.when(complete, F.filter(signs, lambda s: times(candidate, s) < times(reference, s)))
        return F.struct(tx.multiset_recall(x.ref, x.cand).alias("recall"), F.when(complete & (F.size(x.cand) > 0), tx.multiset_recall(x.cand, x.ref)).alias("precision"), lost.alias("lost"))

    def issues(x: Column) -> Column:
        return _issues(
            (x.recall < least, F.concat(F.lit("numbers missing vs source ("), percent(x.recall), F.lit(" matched)"))),
            (x.precision < least, F.concat(F.lit("numbers not present in source ("), percent(x.precision), F.lit(" supported)"))),
            (F.coalesce(F.size(x.lost), F.lit(0)) > 0, F.concat(F.lit("special characters lost: "), F.array_join(x.lost, ""))),
        )

    numbers = F.struct(tx.numbers(reference, False).alias("ref"), tx.numbers(candidate, False).alias("cand"))
    return tx.let(numbers, lambda x: F.when(F.size(x.ref) == 0, _strings()).otherwise(tx.let(shares(x), issues)))


def text_issues(content: Column, method: Column, confidence: Column, agreement: Column, line_scores: Column) -> Column:
    """VAL-03 on NFC text."""
    ocr = method == "ocr"
    ratios = F.struct(tx.garbled_ratio(content).alias("garbled"), F.when(ocr, tx.dropout_ratio(content)).alias("dropout"))
    return tx.let(ratios, lambda r: _text_issues(r["garbled"], r["dropout"], ocr, confidence, agreement, line_scores))


def _text_issues(garbled: Column, dropout: Column, ocr: Column, confidence: Column, agreement: Column, line_scores: Column) -> Column:
    low = F.when(F.size(line_scores) > 0, F.size(F.filter(line_scores, lambda s: s < SETTINGS["low_line"])) / F.size(line_scores))
    return _issues(
        (garbled > SETTINGS["max_garbled"], F.concat(F.lit("garbled characters ("), percent(garbled), F.lit(")"))),
        (ocr & (dropout > SETTINGS["max_dropout"]), F.concat(F.lit("Vietnamese letters missing ("), percent(dropout), F.lit(" of words without vowels): use the Vietnamese recognition model (ocr_rec_model_dir)"))),
        (ocr & (agreement < SETTINGS["min_agreement"]), F.concat(F.lit("two OCR readings disagree ("), percent(agreement), F.lit(" similar)"))),
        (ocr & (confidence < SETTINGS["min_confidence"]), F.concat(F.lit("low OCR confidence ("), F.format_string("%.2f", confidence), F.lit(")"))),
        (ocr & (low > SETTINGS["max_low_lines"]), F.concat(percent(low), F.lit(f" of lines below confidence {SETTINGS['low_line']}"))),
    )


def table_issues(rows: Column, cols: Column, rectangular: Column, empty: Column, spans: Column, confidence: Column) -> Column:
    """VAL-04 without the checks of its text."""
    cells = rows * cols
    big = (cells > SETTINGS["complex_table_cells"]) | (spans >= 3)
    least = SETTINGS["table_min_confidence"] + F.when(big, 0.1).otherwise(0.0)
    found = _issues(
        ((rows < 2) | (cols < 2), F.concat(F.lit("degenerate table ("), rows.cast("string"), F.lit("x"), cols.cast("string"), F.lit(")"))),
        (~rectangular, "rows have different numbers of cells"),
        (empty > SETTINGS["table_max_empty"], F.concat(percent(empty), F.lit(" empty cells"))),
        (confidence < least, F.concat(F.lit("low table confidence ("), F.format_string("%.2f", confidence), F.when(big, ", complex table").otherwise(""), F.lit(")"))),
    )
    return F.when(F.coalesce(cells, F.lit(0)) == 0, _strings("no table structure recognised")).otherwise(found)


def longest_run(items: Column) -> Column:
    """WN-12: the longest run of equal neighbours (at least 1)."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(acc, x):
        run = F.when(acc.last == x, acc.run + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc.best, run).alias("best"))

    return F.aggregate(items, start, step, lambda acc: acc.best)


def formula_issues(latex: Column) -> Column:
    """VAL-05."""
    n = lambda s: F.regexp_count(latex, F.lit(s))
    parts = F.regexp_extract_all(latex, F.lit(r"\\[a-zA-Z]+|\S"), F.lit(0))
    found = _issues(
        (n(r"\{") != n(r"\}"), "unbalanced braces"),
        (n(r"\\left") != n(r"\\right"), "unbalanced \\left/\\right"),
        (n(r"\\begin") != n(r"\\end"), "unbalanced \\begin/\\end"),
        (longest_run(parts) >= SETTINGS["formula_run"], "repeated tokens (decoder loop)"),
        (F.length(latex) > SETTINGS["formula_chars"], "formula implausibly long"),
    )
    return F.when(F.trim(latex) == "", _strings("empty formula")).otherwise(found)


def verdict(kind: Column, method: Column, content: Column, error: Column, issues: Column, confidence: Column) -> Column:
    """VAL-06, FLT-10: passed, status, score and issues of a result. issues: those of the checks for its kind."""
    content = F.coalesce(content, F.lit(""))
    blank = F.trim(content) == ""
    n = F.size(issues)
    read = method.isin("pdf_text", "ocr")
    picture = kind.isin("chart", "image")
    base = F.when(method == "pdf_text", 0.8).otherwise(0.7)

    def result(passed: bool, status: str, score, found) -> Column:
        score = score if isinstance(score, Column) else F.lit(float(score))
        return F.struct(F.lit(passed).alias("passed"), F.lit(status).alias("status"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), found.alias("issues"))

    said = lambda tail: F.array(F.concat(method, F.lit(tail)))
    fail = lambda score, found: result(False, "needs_review", score, found)
    none = _strings()
    return (
        F.when(error.isNotNull(), fail(0.0, F.array(F.concat(method, F.lit(" failed: "), error))))
        .when(kind.isin("table", "formula") & read & blank, fail(0.0, said(" found no text")))
        .when((kind == "table") & read, result(True, "needs_review", 0.3, _strings("table structure not recovered, plain text kept")))
        .when((kind == "formula") & read, result(True, "needs_review", 0.3, _strings("formula not recovered, plain text kept")))
        .when(picture & read & blank, result(True, "skipped", 0.1, _strings("no VLM available and no text found")))
        .when(picture & read, result(True, "unchecked", 0.4, _strings("no VLM description, only text inside the figure")))
        .when((kind == "table") & (n == 0), result(True, "passed", 1.0, none))
        .when(kind == "table", fail(0.7 - 0.15 * n, issues))
        .when((kind == "formula") & (n == 0), result(True, "unchecked", 1.0, none))
        .when(kind == "formula", fail(0.6 - 0.15 * n, issues))
        .when(picture & (blank | F.trim(content).rlike(REFUSAL)), fail(0.1, _strings("VLM returned no usable description")))
        .when(picture, result(True, "unchecked", 1.0, none))
        .when(blank, fail(0.0, said(" returned no text")))
        .when(n > 0, fail(F.least(base, F.coalesce(confidence, base)) - 0.1 * n, issues))
        .when(kind.isin(*TEXT_LIKE, "seal"), result(True, "passed", 1.0, none))
        .otherwise(result(True, "unchecked", 1.0, none))
    )


def agreement(a: Column, b: Column) -> Column:
    """VAL-07: of two readings, white space aside."""
    a, b = F.regexp_replace(a, r"(?U)\s+", ""), F.regexp_replace(b, r"(?U)\s+", "")
    return 1 - metrics.normalized_distance(a, b)


def ungrounded(labels: Column, printed: Column, least: float = 0.75) -> Column:
    """FLT-09: labels with a word that the printed text lacks, small reading errors aside; on NFC text."""
    known = F.array_distinct(tx.words(printed))
    joined = F.regexp_replace(F.lower(printed), r"(?U)\s+", "")
    similar = lambda w, p: 1 - F.levenshtein(w, p) / F.greatest(F.length(w), F.length(p)) >= least
    grounded = lambda w: F.array_contains(known, w) | (w.rlike(f"[{tx.CJK}]") & joined.contains(w)) | F.exists(known, lambda p: similar(w, p))
    return F.filter(labels, lambda label: F.exists(tx.words(label), lambda w: ~grounded(w)))


def keep_figure(policy: Column, status: Column, kind: Column, description: Column, figure_kind: Column, lossless: Column, figure_text: Column, values: Column, labels: Column) -> Column:
    """FLT-08: whether the picture stays, and why; values and labels: those of the chart's data; texts are NFKC."""
    fk = F.lower(F.coalesce(figure_kind, F.lit("other")))
    chart = (kind == "chart") | (fk == "chart")
    numbers = tx.numbers(F.array_join(values, " "), False)
    missing = ungrounded(labels, F.coalesce(figure_text, F.lit("")))

    def say(keep: bool, reason) -> Column:
        return F.struct(F.lit(keep).alias("keep"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    return (
        F.when(policy == "always", say(True, "figure_policy=always"))
        .when(policy == "never", say(False, "figure_policy=never"))
        .when(status == "needs_review", say(True, "uncertain result: original kept for review"))
        .when(kind == "seal", say(True, "seal/stamp: the picture is the evidence"))
        .when(~kind.isin("image", "chart", "seal"), say(False, "extracted content is verified"))
        .when(status == "skipped", say(False, "decorative image"))
        .when(F.trim(F.coalesce(description, F.lit(""))) == "", say(True, "no structured description"))
        .when(~fk.isin(*TEXTUAL_KINDS), say(True, F.concat(F.lit("visual content ("), fk, F.lit(")"))))
        .when(~F.coalesce(lossless, F.lit(False)), say(True, "description would lose information"))
        .when(figure_text.isNull(), say(True, "text inside the picture was not read by OCR"))
        .when(chart & (F.coalesce(F.size(values), F.lit(0)) <= 0), say(True, "chart without extracted data"))
        .when(chart & F.exists(values, lambda v: F.trim(v).startswith("~")), say(True, "chart values are estimated"))
        .when(chart & (F.size(numbers) > 0) & (tx.multiset_recall(numbers, tx.numbers(figure_text, False)) < SETTINGS["number_match_min"]), say(True, "chart values not found in the text of the picture"))
        .when(chart & (F.size(missing) > 0), say(True, F.concat(F.lit("chart labels not printed in the picture: "), F.array_join(F.slice(missing, 1, 3), "; "))))
        .otherwise(say(False, "fully described by text"))
    )


def prompt(task: Column, hint: Column, language: Column, prompts: dict[str, str], figure_hint: str, other_hint: str, most: int = 4000) -> Column:
    """TXT-27: the task's prompt with {language} filled in, then, if there is a hint, the text that introduces it, with {hint} filled in
    by its first `most` characters."""
    made = F.lit(None).cast("string")
    for name, text in prompts.items():
        made = F.when(task == name, F.lit(text)).otherwise(made)
    intro = F.when(task.isin("chart", "image"), F.lit(figure_hint)).otherwise(F.lit(other_hint))
    tail = F.when(F.coalesce(hint, F.lit("")) != "", F.replace(intro, F.lit("{hint}"), F.substring(hint, 1, most))).otherwise("")
    return F.concat(F.replace(made, F.lit("{language}"), language), tail)
