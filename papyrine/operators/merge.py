"""From regions to a document: heading levels, continuations, Markdown, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from .layout import FURNITURE

# --- fixed values ---------------------------------------------------------------------------------------------------------
LABELS = {
    "vi": {"image": "Hình ảnh", "chart": "Biểu đồ", "seal": "Con dấu", "page": "Trang", "review": "cần kiểm tra", "figure_text": "Chữ trong hình", "original": "Ảnh gốc", "generated": "mô tả tự động"},
    "en": {"image": "Image", "chart": "Chart", "seal": "Seal", "page": "Page", "review": "needs review", "figure_text": "Text in figure", "original": "Original image", "generated": "automatic description"},
    "ja": {"image": "画像", "chart": "グラフ", "seal": "印影", "page": "ページ", "review": "要確認", "figure_text": "図中の文字", "original": "元の画像", "generated": "自動生成の説明"},
}
NUMBERED = r"^\s*((?:[0-9]+\.)*[0-9]+)[.)]?\s+\S"
ROMAN = r"^\s*[IVXLC]+[.)]\s+\S"
CHAPTER = r"(?i)^\s*(chương|phần|chapter|part|mục)(\s|[^\p{L}\p{N}_]|$)|^\s*第\s*[0-9一二三四五六七八九十百]+\s*[章部編]"
SECTION = r"^\s*第\s*[0-9一二三四五六七八九十百]+\s*節"
TERMINAL = ".!?:;。！？」』)）…"
OPENING = "「『（(［[・-–—•"
# --- end of fixed values -----------------------------------------------------------------------------------------------------


def heading_levels(regions: DataFrame, doc: str = "doc") -> DataFrame:
    """WN-03: `level` of titles and headings that have none. Regions: doc, type, level, content (NFKC), font_size."""
    size = F.when((F.col("type") == "heading") & (F.col("font_size") > 0), F.round("font_size", 1))
    ranked = regions.withColumn("_rank", F.dense_rank().over(W.partitionBy(doc, size.isNull()).orderBy(size.desc())))
    text = F.trim(F.col("content"))
    number = F.regexp_extract(text, NUMBERED, 1)
    level = (
        F.when(text.rlike(CHAPTER) | text.rlike(ROMAN), 2)
        .when(text.rlike(SECTION), 3)
        .when(number != "", F.least(F.lit(6), 2 + F.regexp_count(number, F.lit(r"\."))))
        .when(size.isNotNull(), F.least(F.lit(4), 1 + F.col("_rank")))
        .otherwise(2)
    )
    made = F.when(F.col("type") == "title", F.coalesce("level", F.lit(1))).when(F.col("type") == "heading", F.coalesce(F.col("level"), level)).otherwise(F.col("level"))
    return ranked.withColumn("level", made.cast("int")).drop("_rank")


def continues(prev: Column, cur: Column) -> Column:
    """Whether cur goes on with the sentence in which prev stopped."""
    prev, cur = F.regexp_replace(prev, r"(?U)\s+$", ""), F.regexp_replace(cur, r"(?U)^\s+", "")
    last, first = F.right(prev, F.lit(1)), F.left(cur, F.lit(1))
    open_ = (prev != "") & (cur != "") & ~last.isin(*TERMINAL)
    lower = (F.lower(first) == first) & (F.upper(first) != first)
    return open_ & (lower | (tx.is_cjk(last) & tx.is_cjk(first) & ~first.isin(*OPENING)))


def continuations(regions: DataFrame, doc: str = "doc") -> DataFrame:
    """WN-04, WN-05, JN-12: content regions with `chain`, the first region of the chain that each belongs to. Regions: doc, page,
    order, id, type, status, content, n_cols. Chains are runs of neighbours, so a running count finds them."""
    shown = regions.where(~F.col("type").isin(*FURNITURE, "footnote") & (F.coalesce("status", F.lit("")) != "skipped"))
    w = W.partitionBy(doc).orderBy("page", "order")
    before = lambda c: F.lag(c).over(w)
    text = (F.col("type") == "text") & (before("type") == "text") & continues(before("content"), F.col("content"))
    table = (F.col("type") == "table") & (before("type") == "table") & (F.col("page") == before("page") + 1) & (F.col("n_cols") == before("n_cols"))
    joined = shown.withColumn("joined", F.coalesce(text | table, F.lit(False)))
    island = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return joined.withColumn("island", island).withColumn("chain", F.first("id").over(W.partitionBy(doc, "island").orderBy("page", "order")))


def glued(parts: Column) -> Column:
    """WN-05: the text of a chain: a hyphen before a lower-case start goes, CJK parts meet without a space."""

    def step(acc, part):
        first = F.left(part, F.lit(1))
        hyphen = acc.endswith("-") & (F.lower(first) == first) & (F.upper(first) != first)
        return F.when(hyphen, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), part)).otherwise(tx.join_inline(acc, part))

    return F.aggregate(F.transform(parts, lambda x: F.trim(x)), F.lit(""), step)


def list_markdown(content: Column) -> Column:
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")

    def line(x):
        indent = F.repeat(F.lit(" "), F.length(x) - F.length(F.ltrim(x)))
        body = F.trim(x)
        return F.concat(indent, F.when(body.rlike(r"^(?:\d+[.)]|-)\s"), body).when(tx.is_list_item(body), F.concat(F.lit("- "), tx.strip_bullet(body))).otherwise(F.concat(F.lit("- "), body)))

    return F.array_join(F.transform(lines, line), "\n")


def region_markdown(kind: Column, content: Column, level: Column, method: Column, table: Column, figure: Column, figure_text: Column, locale: str = "en") -> Column:
    """SNK-04; table: the rendered table or null."""
    names = LABELS[locale]
    text = F.trim(F.coalesce(content, F.lit("")))
    one = tx.single_line(text)
    depth = F.coalesce(level, F.when(kind == "title", 1).otherwise(2))
    body = (
        F.when(kind == "table", F.coalesce(table, text))
        .when(text == "", "")
        .when(kind.isin("title", "heading"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), one))
        .when((kind == "formula") & ~method.isin("pdf_text", "ocr", "docx"), F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(kind == "list", list_markdown(text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "caption", F.concat(F.lit("*"), one, F.lit("*")))
        .otherwise(text)
    )
    body = F.when(figure.isNotNull(), F.concat(F.when(body == "", "").otherwise(F.concat(body, F.lit("\n\n"))), F.lit(f"![{names['original']}]("), figure, F.lit(")"))).otherwise(body)
    label = F.when(kind == "image", names["image"]).when(kind == "chart", names["chart"]).otherwise(names["seal"])
    tag = F.when(method == "vlm", F.concat(label, F.lit(f" · {names['generated']}"))).otherwise(label)
    said = F.when(text != "", F.concat(F.lit("> **["), tag, F.lit("]** "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
    inside = F.when((F.coalesce(figure_text, F.lit("")) != "") & (kind != "seal"), F.concat(F.lit(f"> {names['figure_text']}: "), tx.single_line(figure_text)))
    alt = F.translate(F.substring(tx.single_line(F.substring_index(text, ". ", 1)), 1, 120), "[]", "()")
    link = F.when(figure.isNotNull(), F.concat(F.lit("!["), label, F.when(alt == "", "").otherwise(F.concat(F.lit(": "), alt)), F.lit("]("), figure, F.lit(")")))
    quote = F.nullif(F.concat_ws("\n>\n", said, inside), F.lit(""))
    return F.when(kind.isin("image", "chart", "seal"), F.concat_ws("\n\n", link, quote)).otherwise(body)


def document_markdown(parts: DataFrame, doc: str = "doc") -> DataFrame:
    """SNK-05: parts (doc, page, order, part) joined in order, empty ones left out."""
    kept = parts.where(F.coalesce("part", F.lit("")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "order", "part"))), lambda x: x.part)
    return kept.groupBy(doc).agg(F.concat(F.trim(F.array_join(ordered, "\n\n")), F.lit("\n")).alias("markdown"))


def histogram(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """AG-01: a map of the values of a column and their numbers."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def best_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """WN-06: of each region, the last attempt if it passed, else the first of the best score. attempts: keys, step, passed, score."""
    last = F.max_by("passed", "step")
    rows = attempts.groupBy(*keys).agg(
        F.when(last, F.max_by("step", "step")).otherwise(F.max_by("step", F.struct("score", -F.col("step")))).alias("step"), F.max("step").alias("steps"), last.alias("passed")
    )
    return rows
