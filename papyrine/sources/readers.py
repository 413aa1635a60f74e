"""Sources: files, their formats, DOCX, TSV, JSON lines, labelled lines."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from ..functions.udf import each

#: Suffixes by what becomes of the file. Fixed values.
SUFFIXES = {
    "direct": ("pdf", "docx", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"),
    "docx": ("doc", "rtf", "odt", "wpd"),
    "pdf": ("ppt", "pptx", "odp", "xls", "xlsx", "ods", "csv", "html", "htm", "txt", "md", "epub"),
}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def is_supported(path: Column) -> Column:
    """Whether the path's suffix is known."""
    known = "|".join(s for group in SUFFIXES.values() for s in group)
    return F.lower(path).rlike(rf"\.({known})$")


def files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: supported files below the path with content and sha256; a missing path is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(is_supported(F.col("path")))
    return found.select("path", F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("sha256"), file_format(F.col("content"), F.col("path")).alias("format"))


@each("boolean")
def _holds_document(content: bytes) -> bool:
    try:
        return "word/document.xml" in zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return False


def file_format(content: Column, path: Column) -> Column:
    """SRC-02: pdf, docx, office:<target>, image, or null, by the first bytes, then the suffix."""
    head = F.hex(F.substring(content, 1, 4))
    pdf = F.hex(F.substring(content, 1, 1024)).contains("255044462D")
    zipped = F.when(head == "504B0304", content)  # only archives go to Python
    image = head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("47494638") | head.isin("49492A00", "4D4D002A") | head.startswith("424D") | (head == "52494646")
    return F.when(pdf, "pdf").when(zipped.isNotNull() & F.coalesce(_holds_document(F.coalesce(zipped, F.lit(b""))), F.lit(False)), "docx").when(office_target(path).isNotNull(), F.concat(F.lit("office:"), office_target(path))).when(image, "image")


def office_target(path: Column) -> Column:
    """SRC-03: what an office file is converted to by an external converter."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(suffix.isin(*SUFFIXES["docx"]), "docx").when(suffix.isin(*SUFFIXES["pdf"]), "pdf")


def _style_level(style: str) -> int | None:
    found = re.search(r"heading\s*([1-9])|heading([1-9])", style, re.I)
    return int(found[1] or found[2]) if found else None


def docx_blocks(data: bytes) -> list[dict]:
    """SRC-08: the blocks of a DOCX body in order: type, level, text, rows (of tables, with merged cells), locator."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{WORD}body")
    out, tables, paragraphs = [], 0, 0
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            paragraphs += 1
            text = "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" if t.tag == f"{WORD}br" else "" for t in node.iter())
            get = lambda path: (x.get(f"{WORD}val") if (x := node.find(path)) is not None else None)  # noqa: B023, E731
            style = get(f"{WORD}pPr/{WORD}pStyle") or ""
            outline = get(f"{WORD}pPr/{WORD}outlineLvl")
            level = _style_level(style) or (int(outline) + 1 if outline and int(outline) < 9 else None)
            listed = node.find(f"{WORD}pPr/{WORD}numPr") is not None or style.lower().startswith("list")
            kind = "title" if style.lower() == "title" else "heading" if level else "list" if listed else "caption" if style.lower() == "caption" else "text"
            if text.strip():
                out.append({"type": kind, "level": level, "text": text.strip(), "rows": None, "locator": f"body/p[{paragraphs}]"})
        elif node.tag == f"{WORD}tbl":
            tables += 1
            out.append({"type": "table", "level": None, "text": None, "rows": _docx_table(node), "locator": f"body/tbl[{tables}]"})
    return out


def _docx_table(node) -> list[list[dict]]:
    """Cells with spans: gridSpan widens, vMerge without restart lengthens the cell above."""
    rows: list[list[dict]] = []
    above: dict[int, dict] = {}
    for tr in node.findall(f"{WORD}tr"):
        row, at = [], 0
        for tc in tr.findall(f"{WORD}tc"):
            span = tc.find(f"{WORD}tcPr/{WORD}gridSpan")
            width = int(span.get(f"{WORD}val")) if span is not None else 1
            merge = tc.find(f"{WORD}tcPr/{WORD}vMerge")
            if merge is not None and merge.get(f"{WORD}val") != "restart" and at in above:
                above[at]["rowspan"] += 1
            else:
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in tc.findall(f"{WORD}p"))
                cell = {"text": text.strip(), "row": len(rows), "col": at, "rowspan": 1, "colspan": width, "header": not rows}
                row.append(cell)
                above[at] = cell
            at += width
        rows.append(row)
    return rows


BLOCK = "array<struct<type:string,level:int,text:string,rows:array<array<struct<text:string,row:int,col:int,rowspan:int,colspan:int,header:boolean>>>,locator:string>>"


@each(BLOCK)
def _docx(content: bytes | None) -> list[dict]:
    return docx_blocks(content) if content else []


def docx(rows: DataFrame, content: str = "content") -> DataFrame:
    """SRC-08, SRC-23: one row for each block of the DOCX files, with its place."""
    blocks = rows.select(*[c for c in rows.columns if c != content], F.posexplode(_docx(F.col(content))).alias("place", "b"))
    return blocks.select("*", "b.*").drop("b")


def merged_lists(blocks: DataFrame, doc: str, place: str = "place") -> DataFrame:
    """SRC-09: neighbouring list blocks become one, their texts a line each."""
    w = W.partitionBy(doc).orderBy(place)
    new = ~((F.col("type") == "list") & (F.coalesce(F.lag("type").over(w), F.lit("")) == "list"))
    rows = blocks.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text), "\n")
    return rows.groupBy(doc, "island").agg(F.min(place).alias(place), F.first("type").alias("type"), text.alias("text")).drop("island")


def page_lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-05: spans (keys, block, line_no, span_no, text, size, bold, font, box) to lines: text in order, largest size, bold if all are,
    fonts, box."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x.text), "")
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    made = spans.groupBy(*keys, "block", "line_no").agg(text.alias("text"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.sort_array(F.collect_set("font")).alias("fonts"), *box)
    return made.where(F.trim("text") != "")


def ground_truth(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-22: text blocks (keys, place, kind, text) in order, white space collapsed, joined by blank lines."""
    rows = blocks.where("kind = 0").withColumn("t", F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).where("t <> ''")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x.t), "\n\n").alias("truth"))


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of small files with the file's number and the line's; a file's order is kept by reading it whole."""
    from functools import reduce

    read = lambda i, p: spark.read.text(p, wholetext=True).select(F.lit(i).alias("file_no"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return reduce(DataFrame.unionByName, [read(i, p) for i, p in enumerate(paths)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-12: JSON lines; a missing file is an empty table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).json(path) if target.getFileSystem(conf).exists(target) else spark.createDataFrame([], schema)


def labelled_lines(lines: DataFrame) -> DataFrame:
    """SRC-14: 'path<TAB>text' lines (value); those that lack either are left out."""
    from ..functions import text as tx

    parts = F.split("value", "\t", 2)
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("path"), tx.normalize(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text")).where("path <> '' and text <> ''")


def article_blocks(blocks: DataFrame, doc: str, budget: int, stop: str = "^(references|external links|see also|notes)$") -> DataFrame:
    """SRC-20: blocks (doc, place, tag, text) up to a stop section and a budget of characters: the block that crosses it is the last."""
    w = W.partitionBy(doc).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = blocks.withColumn("stopped", F.max((F.col("tag").startswith("h") & F.lower(F.trim("text")).rlike(stop)).cast("int")).over(w)).where("stopped = 0")
    return rows.withColumn("before", F.sum(F.length("text")).over(w) - F.length("text")).where(F.col("before") < budget).drop("stopped", "before")
