"""Queries of the extraction core on the derived views: sources, candidate filters, evidence, engines' inputs, tables, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import charsets, images, metrics, tables
from ..functions import text as tx
from ..functions.geometry import Box
from ..functions.udf import vectorised
from ..operators import benchmark, corpus, execute, layout, lines, merge, routing
from ..sources import readers
from .registry import query
from .set_queries import AREA, common, size
from .views import Tables

#: A suffix by the row's number, for paths.
SUFFIXES = ["pdf", "docx", "rtf", "csv", "html", "png", "exe"]
OFFICE = "CASE WHEN s IN ('doc', 'rtf', 'odt', 'wpd') THEN 'docx' WHEN s IN ('ppt', 'pptx', 'odp', 'xls', 'xlsx', 'ods', 'csv', 'html', 'htm', 'txt', 'md', 'epub') THEN 'pdf' END"
SUFFIX_SQL = f"{SUFFIXES!r}[CAST(doc_id % {len(SUFFIXES)} AS INT) + 1]"


def suffix() -> Column:
    return F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))


def path() -> Column:
    return F.concat(F.lit("in/"), F.col("source"), F.lit("/d."), suffix())


# --- sources --------------------------------------------------------------------------------------------------------------


@query("SRC-01", f"SELECT doc_id, 'in/' || source || '/d.' || s AS path FROM (SELECT *, {SUFFIX_SQL} AS s FROM documents) WHERE s <> 'exe'")
def supported(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", path().alias("path")).where(readers.is_supported(F.col("path")))


@query("SRC-02", f"""SELECT doc_id, CASE WHEN head = '%PDF-1.7 ' OR contains(text, '%PDF-') AND strpos(text, '%PDF-') < 1015 THEN 'pdf' WHEN {OFFICE} IS NOT NULL THEN 'office:' || {OFFICE} WHEN head = 'GIF89a' OR head = '' AND (text LIKE 'BM%' OR text LIKE 'GIF8%' OR text LIKE 'RIFF%') THEN 'image' END AS format
FROM (SELECT doc_id, text, ['%PDF-1.7 ', 'GIF89a', ''][CAST(doc_id % 3 AS INT) + 1] AS head, {SUFFIX_SQL} AS s FROM documents)""")
def formats(t: Tables) -> DataFrame:
    head = F.element_at(F.array(F.lit("%PDF-1.7 "), F.lit("GIF89a"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", readers.file_format(F.encode(F.concat(head, "text"), "UTF-8"), path()).alias("format"))


@query("SRC-03", f"SELECT doc_id, {OFFICE} AS target FROM (SELECT doc_id, {SUFFIX_SQL} AS s FROM documents)")
def office_targets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", readers.office_target(path()).alias("target"))


@query("SRC-11", """SELECT id, sector, website FROM (SELECT 's' || doc_id AS id, lang AS sector, 'https://www.' || source || '.example/' || doc_id AS website, row_number() OVER (PARTITION BY source ORDER BY doc_id % 2, doc_id) AS rn FROM documents WHERE lang <> 'es') WHERE rn = 1""")
def seed_rows(t: Tables) -> DataFrame:
    """Spanish lines are comments; two files; the first line of a website counts."""
    line = F.concat_ws("\t", F.concat(F.lit("s"), F.col("doc_id").cast("string")), "lang", F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")))
    rows = t.documents.select((F.col("doc_id") % 2).alias("file_no"), F.col("doc_id").alias("line_no"), F.when(F.col("lang") == "es", F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return corpus.seeds(rows).select("id", "sector", "website")


@query("SRC-13", """SELECT path, stem, CASE WHEN dir IN ('dev', 'test') THEN dir END AS split, CASE WHEN dir IN ('dev', 'test') THEN source ELSE dir || '/' || source END AS category, lang AS truth FROM (
  SELECT doc_id, source, lang, ['dev', 'test', 'more'][CAST(doc_id % 3 AS INT) + 1] AS dir, 'd' || doc_id AS stem, ['dev', 'test', 'more'][CAST(doc_id % 3 AS INT) + 1] || '/' || source || '/d' || doc_id || '.pdf' AS path FROM documents) WHERE lang <> 'es'""")
def truth_pairs(t: Tables) -> DataFrame:
    """Spanish documents have no ground truth."""
    folder = F.element_at(F.array(F.lit("dev"), F.lit("test"), F.lit("more")), (F.col("doc_id") % 3 + 1).cast("int"))
    stem = F.concat_ws("/", folder, "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    docs = t.documents.select(F.concat(stem, F.lit(".pdf")).alias("path"), F.lit(None).cast("string").alias("text"))
    truth = t.documents.where("lang <> 'es'").select(F.concat(stem, F.lit(".gt.md")).alias("path"), F.col("lang").alias("text"))
    return benchmark.dataset(docs.unionByName(truth)).select("path", "stem", "split", "category", "truth")


@query("SRC-14", r"SELECT source || '/' || doc_id AS path, lang || ' x' AS text FROM documents WHERE lang <> 'es'")
def labelled(t: Tables) -> DataFrame:
    """Spanish lines lack their text."""
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return readers.labelled_lines(t.documents.select(F.when(F.col("lang") == "es", name).otherwise(F.concat(name, F.lit("\t "), F.col("lang"), F.lit("  x"))).alias("value")))


@query("SRC-15", """SELECT 'u' || user_id AS log, round(median(v), 6) AS ips, count(*) AS n FROM (SELECT user_id, event_id % 1000 / 10 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn > 3 GROUP BY user_id""")
def speeds(t: Tables) -> DataFrame:
    value = F.format_string("[Train] global_step: %d, avg_reader_cost: 0.01 s, avg_batch_cost: 0.2 s, ips: %.1f samples/s", F.col("event_id"), (F.col("event_id") % 1000 / 10))
    rows = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("log"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "error", "warning").otherwise(value).alias("value"))
    return corpus.speed_log(rows).select("log", F.round("ips", 6).alias("ips"), "n")


@query("SRC-18", """SELECT url, CASE WHEN k = 0 THEN NOT (path LIKE '/a/%' AND NOT path LIKE '/a/1%') WHEN k = 1 THEN NOT path LIKE '%9' ELSE FALSE END AS allowed FROM (
  SELECT page_id % 3 AS k, '/a/' || page_id AS path, 'https://h' || (page_id % 3) || '.example/a/' || page_id AS url FROM pages)""")
def robots_by_origin(t: Tables) -> DataFrame:
    """Three origins: an allowed prefix inside a forbidden one, a pattern with an end, and one that can't be reached."""
    said = {0: ["User-agent: *", "Disallow: /a/", "Allow: /a/1"], 1: ["User-agent: *", "Disallow: /*9$"], 2: ["User-agent: *", "Allow: /"]}
    rules = t.spark.createDataFrame([(f"https://h{k}.example", i, v) for k, vs in said.items() for i, v in enumerate(vs)], "origin string, line_no int, value string")
    origins = t.spark.createDataFrame([(f"https://h{k}.example", k != 2) for k in said], "origin string, reached boolean")
    urls = t.pages.select(F.concat(F.lit("https://h"), (F.col("page_id") % 3).cast("string"), F.lit(".example/a/"), F.col("page_id").cast("string")).alias("url")).distinct()
    return corpus.robots_allowed(urls, corpus.robots_rules(rules, "papyrine"), origins)


@query("SRC-20", """SELECT doc, place, tag FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT conv_id AS doc, turn AS place, CASE WHEN role = 'system' THEN 'h2' ELSE 'p' END AS tag, length(text) AS n FROM conversations)) WHERE before < 600""")
def articles(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), F.when(F.col("role") == "system", "h2").otherwise("p").alias("tag"), "text")
    return readers.article_blocks(rows, "doc", 600).select("doc", "place", "tag")


@query("SRC-21", "SELECT event_id, sha256(event_type || chr(31) || 'v1' || chr(31) || sha1(props) || chr(31) || user_id) AS key FROM events")
def cache_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", execute.cache_key(F.col("event_type"), F.lit("v1"), F.sha1("props"), F.col("user_id").cast("string")).alias("key"))


@query("SRC-25", """SELECT doc_id, CAST(pages AS INT) AS source_pages, CAST(least(pages, CASE kind WHEN 'scan' THEN 5 ELSE 20 END) AS INT) AS pages, kind, sha256 FROM manifest""", "manifest")
def stored(t: Tables) -> DataFrame:
    limit = F.when(F.col("kind") == "scan", 5).otherwise(20)
    return t.manifest.select("doc_id", F.col("pages").alias("source_pages"), F.size(corpus.kept_pages(F.col("sha256"), F.col("pages"), limit)).alias("pages"), "kind", "sha256")


@query("SNK-06", "SELECT page, l_partkey, CASE type WHEN 'image' THEN 'Hình ảnh' WHEN 'chart' THEN 'Biểu đồ' ELSE 'Trang' END AS label FROM boxes", "boxes")
def locale_labels(t: Tables) -> DataFrame:
    names = merge.LABELS["vi"]
    return t.boxes.select("page", "l_partkey", F.coalesce(*[F.when(F.col("type") == k, names[k]) for k in ("image", "chart")], F.lit(names["page"])).alias("label"))


# --- texts ----------------------------------------------------------------------------------------------------------------


@vectorised("array<array<int>>")
def _visual_rows(boxes: pd.Series) -> pd.Series:
    return boxes.map(lambda page: [[x["idx"] for x in row] for row in lines.rows_of(list(page))])


@query("TXT-16", None)
def visual_rows(t: Tables) -> DataFrame:
    """The boxes of each page as rows of fragments."""
    page = t.boxes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "x0", "y0", "x1", "y1"))).alias("b"))
    return page.select("page", _visual_rows(F.col("b")).alias("rows"))


PROMPTS = {"table": "Give the table as HTML.", "image": "Describe the image. {language}"}


@query("TXT-27", """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'Give the table as HTML.' ELSE 'Describe the image. Write in ' || lang || '.' END || CASE WHEN text IS NULL OR text = '' THEN '' WHEN doc_id % 2 = 0 THEN ' Text of the file: ' || substr(text, 1, 4000) ELSE ' Printed: ' || substr(text, 1, 4000) END) AS digest FROM documents""")
def prompts(t: Tables) -> DataFrame:
    task = F.when(F.col("doc_id") % 2 == 0, "table").otherwise("image")
    made = routing.prompt(task, F.col("text"), F.concat(F.lit("Write in "), F.col("lang"), F.lit(".")), PROMPTS, " Printed: {hint}", " Text of the file: {hint}")
    return t.documents.select("doc_id", F.md5(F.encode(made, "UTF-8")).alias("digest"))


@vectorised("array<string>")
def _pieces(text: pd.Series) -> pd.Series:
    return text.map(lambda s: [p for p, _ in lines.pieces([(c, (i, 0, i + 1, 1)) for i, c in enumerate(s)])])


@query("TXT-29", None)
def line_pieces(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", _pieces(F.coalesce("text", F.lit(""))).alias("pieces"))


@vectorised("array<string>")
def _fallbacks(ch: pd.Series) -> pd.Series:
    return ch.map(charsets.fallbacks)


@query("TXT-31", None)
def fallback_characters(t: Tables) -> DataFrame:
    """Each letter beyond ASCII of the corpus with its nearest characters."""
    signs = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch")).distinct()
    return signs.select("ch", _fallbacks(F.col("ch")).alias("near"))


@query("TXT-35", "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS url FROM documents")
def data_urls(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", images.data_url(F.encode("text", "UTF-8")).alias("url"))


# --- geometry, images, filters --------------------------------------------------------------------------------------------


@query("GEO-07", "SELECT doc_id, sha1('RGB' || n_chars || 'x1' || text) AS crop FROM documents")
def crop_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(F.concat(F.lit("RGB"), F.col("n_chars").cast("string"), F.lit("x1"), F.col("text"))).alias("crop"))


@query("GEO-08", f"SELECT page, l_partkey, round(x0 * 2, 2) AS px0, round(y1 * 2, 2) AS py1, round({AREA} / (595.0::DOUBLE * 842), 5) AS area_ratio FROM boxes", "boxes")
def in_pixels(t: Tables) -> DataFrame:
    b = Box.of()
    px = b.mapped((2.0, 0.0, 0.0, 2.0, 0.0, 0.0)).rounded()
    return t.boxes.select("page", "l_partkey", px.x0.alias("px0"), px.y1.alias("py1"), F.round(b.area() / (595 * 842), 5).alias("area_ratio"))


@vectorised("struct<skew:double,inverted:boolean,stretched:boolean>", once=True)
def _cleaned(pixels: pd.Series) -> pd.DataFrame:
    made = []
    for x in pixels:
        grey = images.square(x)
        light = images.dark_on_light(grey)
        made.append((images.skew(grey), light is not grey, images.stretched(light)[1]))
    return pd.DataFrame(made, columns=["skew", "inverted", "stretched"], index=pixels.index)


@query("IMG-02", None)
def cleaned_images(t: Tables) -> DataFrame:
    """Embeddings as small grey images: skew, inversion and contrast."""
    made = _cleaned(F.col("embedding").cast("array<double>")).alias("c")
    return t.embeddings.select("vec_id", made).select("vec_id", "c.*")


H = 842.0
BLOCK_SQL = f"""SELECT page, l_partkey, CASE WHEN short AND (top OR bottom) AND regexp_full_match(text, '[0-9]{{1,4}}') THEN 'page_number' WHEN short AND top THEN 'header' WHEN short AND bottom THEN 'footer' WHEN math > 0.5 * n THEN 'formula'
  WHEN text LIKE 'Table%' AND near THEN 'caption' WHEN short AND size >= 1.15 * 12 AND text NOT LIKE '%.' AND page = 1 AND size >= 19.5 AND size >= 18 AND y0 < 0.4 * {H} THEN 'title' WHEN short AND size >= 1.15 * 12 AND text NOT LIKE '%.' THEN 'heading'
  WHEN short AND n <= 2 AND bold AND text NOT LIKE '%.' THEN 'heading' WHEN items >= greatest(1, 0.5 * n) THEN 'list' ELSE 'text' END AS kind FROM (
  SELECT *, length(text) <= 150 AND n <= 3 AS short, y1 <= 0.07 * {H} AS top, y0 >= {H} - 0.07 * {H} AS bottom FROM (
    SELECT page, l_partkey, y0, y1, CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN 'Table ' || idx WHEN 2 THEN repeat('word ', idx * 10) || 'end.' ELSE 'Plain words' END AS text, 1 + idx % 4 AS n, 8.0::DOUBLE + l_partkey % 13 AS size, CASE WHEN l_partkey % 11 = 0 THEN 1 + idx % 4 ELSE 0 END AS math, l_partkey % 3 = 0 AS bold, CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 0 END AS items, l_partkey % 2 = 1 AS near FROM boxes))"""


@query("FLT-02", BLOCK_SQL, "boxes")
def block_classes(t: Tables) -> DataFrame:
    p, idx = F.col("l_partkey"), F.col("idx")
    text = F.when(p % 4 == 0, p.cast("string")).when(p % 4 == 1, F.concat(F.lit("Table "), idx.cast("string"))).when(p % 4 == 2, F.concat(F.repeat(F.lit("word "), idx * 10), F.lit("end."))).otherwise("Plain words")
    rows = t.boxes.select("page", "l_partkey", "x0", "y0", "x1", "y1", text.alias("text"), (1 + idx % 4).alias("n"), (8.0 + p % 13).alias("size"))
    kind = layout.block_class(F.col("text"), F.col("n"), F.col("size"), F.lit(12.0), F.lit(20.0), Box.of(), F.lit(H), F.col("page"), F.when(p % 11 == 0, F.col("n")).otherwise(0), p % 3 == 0, F.when(p % 5 == 0, 2).otherwise(0), p % 2 == 1)
    return rows.select("page", "l_partkey", kind.alias("kind"))


COVERED = f"(CASE WHEN {size('b')} > 0 THEN {common('b', 't')} / {size('b')} ELSE 0 END)"


@query("FLT-04", f"SELECT page, l_partkey FROM boxes b WHERE type = 'image' AND {size('b')} BETWEEN 0.002::DOUBLE * 500000 AND 0.95::DOUBLE * 500000 AND NOT EXISTS (SELECT 1 FROM boxes t WHERE t.page = b.page AND t.type = 'table' AND {COVERED} > 0.5)", "boxes")
def candidate_images(t: Tables) -> DataFrame:
    b = t.boxes
    return layout.figure_images(b.where("type = 'image'"), b.where("type = 'table'"), ["page"], 500000.0).select("page", "l_partkey")


@query("FLT-05", "SELECT page, l_partkey, type IN ('table', 'image') AS math FROM boxes", "boxes")
def math_lines(t: Tables) -> DataFrame:
    fonts = F.array(F.lit("Arial"), F.when(F.col("type") == "table", "CMMI10").when(F.col("type") == "image", "Cambria Math").otherwise("Times"))
    return t.boxes.select("page", "l_partkey", layout.is_math_line(fonts).alias("math"))


@query("FLT-07", "SELECT event_id, event_type IN ('view', 'click') OR event_type = 'pdf_text' AS available FROM events")
def available(t: Tables) -> DataFrame:
    return t.events.select("event_id", routing.available(F.col("event_type"), ("view", "click")).alias("available"))


VERDICT_SQL = """SELECT event_id, CASE WHEN k = 0 THEN FALSE WHEN k = 1 THEN FALSE WHEN issue THEN FALSE ELSE TRUE END AS passed, CASE WHEN k = 0 OR k = 1 OR issue THEN 'needs_review' ELSE 'passed' END AS status,
  CASE WHEN k <= 1 THEN 0.0 WHEN issue THEN round(greatest(0.0, least(0.7, c) - 0.1), 6) ELSE 1.0 END AS score FROM (SELECT event_id, event_id % 4 AS k, round(value / 100, 4) AS c, round(value / 100, 4) < 0.5 AS issue FROM events)"""


@query("FLT-10", VERDICT_SQL)
def verdicts(t: Tables) -> DataFrame:
    """Readings: an engine error, no text, low confidence, good ones."""
    k, c = F.col("event_id") % 4, F.round(F.col("value") / 100, 4)
    issues = F.when(c < 0.5, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    v = routing.verdict(F.lit("text"), F.lit("ocr"), F.when(k == 1, " ").otherwise("words"), F.when(k == 0, "timeout"), issues, c)
    return t.events.select("event_id", v.alias("v")).select("event_id", "v.passed", "v.status", F.round("v.score", 6).alias("score"))


@query("FLT-11", "SELECT doc_id FROM documents WHERE n_chars >= 200 AND (n_chars * (doc_id % 10) / 20) / n_chars < 0.2::DOUBLE")
def visible(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("n_chars").alias("chars"), (F.col("n_chars") * (F.col("doc_id") % 10) / 20).alias("invisible"))
    return corpus.visible_pages(rows).select("doc_id")


# --- windows, aggregates --------------------------------------------------------------------------------------------------


@query("WN-02", None)
def furniture_order(t: Tables) -> DataFrame:
    """Reading order with headers first, footers and page numbers last."""
    kind = F.when(F.col("y1") < 60, "header").when(F.col("y0") > 650, "footer").otherwise(F.col("type"))
    return layout.reading_order(t.boxes.withColumn("type", kind), ["page"]).select("page", "idx", "l_partkey", "type", "order")


@vectorised("string")
def _places(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: " ".join(f"{x['row']},{x['col']}" for row in tables.largest_table(m) or [] for x in row))


@query("WN-14", "SELECT p_partkey, '0,0 0,' || n || ' 1,' || n || ' 2,0' AS places FROM (SELECT p_partkey, CAST(1 + p_size % 3 AS INT) AS n FROM part)")
def grid_places(t: Tables) -> DataFrame:
    """A first cell that hangs over two rows and p_size % 3 + 1 columns."""
    html = F.format_string('<table><tr><td rowspan="2" colspan="%d">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>', (1 + F.col("p_size") % 3).cast("int"))
    return t.part.select("p_partkey", _places(html).alias("places"))


@query("JN-12", """WITH x AS (SELECT conv_id, turn, role, row_number() OVER w AS rn, coalesce(role = lag(role) OVER w, FALSE) AS j FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY rn) AS g FROM x) SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, g) AS chain FROM y""")
def chains(t: Tables) -> DataFrame:
    """Turns of one role in a row, as table parts of equal width on following pages, form a chain."""
    rows = t.conversations.select(
        F.col("conv_id").alias("doc"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("page"), F.lit(1).alias("order"), F.col("turn").alias("id"), F.lit("table").alias("type"), F.lit("passed").alias("status"), F.lit("").alias("content"), F.ascii(F.substring("role", 1, 1)).alias("n_cols"),
    )
    return merge.continuations(rows).select(F.col("doc").alias("conv_id"), F.col("id").alias("turn"), "chain")


@query("AG-08", "SELECT category, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE kind = 'scan') AS BIGINT) AS failed, round(avg(pages % 7 / 10), 4) AS cer FROM (SELECT language AS category, * FROM manifest) GROUP BY GROUPING SETS ((category), ())", "manifest")
def overall(t: Tables) -> DataFrame:
    rows = t.manifest.select(F.col("language").alias("category"), "pages", F.when(F.col("kind") == "scan", "unreadable").alias("error"), (F.col("pages") % 7 / 10).alias("cer"))
    return benchmark.summary(rows)


# --- validation, execution ------------------------------------------------------------------------------------------------


@query("VAL-01", "SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN lang ELSE '' END) AS evidence, lang = 'en' AND trim(text, ' \t\n\r') <> '' AS complete FROM documents WHERE text IS NOT NULL")
def evidences(t: Tables) -> DataFrame:
    e = routing.evidence(F.when(F.col("lang") == "en", F.col("text")).otherwise("  "), F.when(F.col("lang") == "fr", F.col("lang")))
    return t.documents.where("text IS NOT NULL").select("doc_id", e.alias("e")).select("doc_id", F.md5(F.encode("e.text", "UTF-8")).alias("evidence"), "e.complete")


@query("VAL-02", """SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'numbers missing vs source (50% matched); numbers not present in source (50% supported)' WHEN 2 THEN 'numbers missing vs source (50% matched)' ELSE 'special characters lost: %' END AS issues FROM lineitem""")
def number_checks(t: Tables) -> DataFrame:
    """A result that keeps both numbers, gets one wrong, loses one, or loses a sign."""
    p, k = F.col("l_partkey"), F.col("l_partkey") % 4
    a, b = (p + 100000).cast("string"), (F.col("l_suppkey") + 500000).cast("string")
    made = F.when(k == 0, F.concat_ws(" ", a, F.lit("%"), b)).when(k == 1, F.concat_ws(" ", a, F.lit("% 7"))).when(k == 2, F.concat_ws(" ", a, F.lit("%"))).otherwise(F.concat_ws(" ", a, b))
    return t.lineitem.select("l_orderkey", "l_linenumber", routing.number_issues(made, F.concat_ws(" ", a, F.lit("%"), b), F.lit(True)).alias("i")).select("l_orderkey", "l_linenumber", F.array_join("i", "; ").alias("issues"))


@query("EX-01", """SELECT page, l_partkey, array_to_string(plan, ' ') AS plan, CASE WHEN len(plan) > 0 THEN NULL WHEN type = 'image' THEN CASE WHEN r < 0.002 THEN 'skipped' ELSE 'unchecked' END ELSE 'needs_review' END AS status FROM (SELECT *, CASE type WHEN 'table' THEN ['pdf_table', 'table_recognition', 'pdf_text'] WHEN 'image' THEN [] ELSE ['pdf_text', 'ocr'] END AS plan
FROM (SELECT page, l_partkey, type, (greatest(0, x1 - x0) * greatest(0, y1 - y0)) / 500000 AS r FROM boxes))""", "boxes")
def prepared(t: Tables) -> DataFrame:
    """Plans without a model for pictures: their status says what becomes of them."""
    rows = t.boxes.select("page", "l_partkey", "type", F.lit("digital").alias("page_kind"), (Box.of().area() / 500000).alias("area_ratio"), F.lit("words").alias("text_layer"), F.lit(0).alias("cells"), F.lit(False).alias("full_page"))
    return execute.planned(rows, ("pdf_text", "pdf_table", "ocr", "table_recognition")).select("page", "l_partkey", F.array_join("plan", " ").alias("plan"), "status")


def _half_fails(batch: pd.DataFrame) -> pd.DataFrame:
    if batch["text_layer"].iloc[0] is None:
        raise ValueError("no layer")
    return pd.DataFrame({"region_id": batch["region_id"], "content": batch["text_layer"], "confidence": 1.0})


@query("EX-03", "SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS region_id, role AS content, CAST(NULL AS VARCHAR) AS error FROM conversations")
def isolated(t: Tables) -> DataFrame:
    """An engine over batches; one that raises would give its regions an error."""
    rows = t.conversations.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("region_id"), F.col("role").alias("text_layer"))
    return execute.run_engine(rows, _half_fails).select("region_id", "content", "error")


@query("EX-05", None)
def kept_breaks(t: Tables) -> DataFrame:
    """Text of each page with its line breaks, as code and lists need it."""
    rows = t.boxes.select("page", F.concat(F.col("type"), F.lit(" "), F.col("idx").cast("string")).alias("text"), "x0", "y0", "x1", "y1")
    return lines.region_texts(rows, ["page"], True)


@query("EX-13", "SELECT event_id, event_type AS content, round(value, 3) AS confidence, CAST(NULL AS VARCHAR) AS error FROM events")
def cached_results(t: Tables) -> DataFrame:
    """Results to the cache's JSON and back."""
    schema = "content string, confidence double, error string"
    value = F.to_json(F.struct(F.col("event_type").alias("content"), F.round("value", 3).alias("confidence"), F.lit(None).cast("string").alias("error")))
    return t.events.select("event_id", F.from_json(value, schema).alias("r")).select("event_id", "r.*")


# --- tables and scores ----------------------------------------------------------------------------------------------------


@query("TB-02", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS n_cells, CASE WHEN p_size % 2 = 0 THEN 'x y z' ELSE p_brand || ' b' END AS text FROM part")
def largest_tables(t: Tables) -> DataFrame:
    more = F.when(F.col("p_size") % 2 == 0, "<table><tr><td>x</td><td>y</td><td>z</td></tr></table>").otherwise("<table><tr><td>q</td></tr></table>")
    d = tables.described(F.concat(F.lit("<table><tr><td>"), "p_brand", F.lit("</td><td>b</td></tr></table>"), more))
    return t.part.select("p_partkey", d.alias("d")).select("p_partkey", "d.n_cells", "d.text")


@vectorised("string")
def _grid_html(rows: pd.Series) -> pd.Series:
    return rows.map(lambda grid: tables.to_html(tables.from_grid([list(r) for r in grid])))


@query("TB-03", "SELECT p_partkey, '<table><tr><th colspan=\"2\">' || p_brand || '</th></tr><tr><td>' || p_type || '</td><td>' || p_size || '</td></tr></table>' AS html FROM part")
def grid_tables(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.part.select("p_partkey", _grid_html(F.array(F.array(F.col("p_brand"), none), F.array(F.col("p_type"), F.col("p_size").cast("string")))).alias("html"))


@query("TB-04", "SELECT p_partkey, p_brand || ';a|b;' || p_type || ';' || p_size AS cells FROM part")
def markdown_tables(t: Tables) -> DataFrame:
    said = F.concat(F.lit("| "), F.col("p_brand"), F.lit(" | a\\|b |\n|---|---|\n| "), F.col("p_type"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    rows = tables.of_markdown(said)
    return t.part.select("p_partkey", rows.alias("r")).select("p_partkey", F.array_join(F.transform(F.flatten("r"), lambda x: x.text), ";").alias("cells"))


@query("MT-01", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS distance FROM part")
def distances(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


def _tables(*cells: Column) -> Column:
    return F.concat(*[F.concat(F.lit("<table><tr><td>"), c, F.lit("</td></tr></table>")) for c in cells])


@query("MT-08", "SELECT p_partkey, '1.0 1.0 0.0' AS scores FROM part")
def matched_tables(t: Tables) -> DataFrame:
    """Three reference tables against two predictions in the other order; the third has none left."""
    a, b = F.col("p_brand"), F.concat(F.lit("zzzz"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", metrics.matched_table_scores(_tables(a, b, F.lit("more")), _tables(b, a)).alias("s")).select("p_partkey", F.array_join(F.transform("s", lambda x: F.round(x, 6).cast("string")), " ").alias("scores"))


@query("JN-16", None)
def table_matches(t: Tables) -> DataFrame:
    """As MT-08, with predictions whose text differs."""
    a, b = F.col("p_name"), F.col("p_type")
    return t.part.select("p_partkey", metrics.matched_table_scores(_tables(a, b), _tables(F.upper(b), F.concat(a, F.lit("s")))).alias("scores"))


@vectorised("struct<at:int,until:int>", once=True)
def _stretch(line: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [metrics.closest_stretch(a, b) or (None, None) for a, b in zip(line, text, strict=True)]
    return pd.DataFrame(found, columns=["at", "until"], index=line.index, dtype="Int32")


@query("JN-17", "SELECT p_partkey, 5 AS at, 5 + length(p_name) AS until FROM part")
def closest_windows(t: Tables) -> DataFrame:
    """Where a name stands in a text."""
    return t.part.select("p_partkey", _stretch(F.col("p_name"), F.concat(F.lit("#####"), "p_name", F.lit("#####"))).alias("s")).select("p_partkey", "s.at", F.col("s.until").cast("long").alias("until"))


@query("MT-09", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN 2.0 * 1 / 3 ELSE 0.8 END, 6) AS f1 FROM part")
def heading_scores(t: Tables) -> DataFrame:
    """Of two headings one is found; of three, two."""
    truth = F.concat(F.lit("# "), "p_brand", F.lit("\n\ntext\n\n## Two\n"), F.when(F.col("p_size") % 2 == 0, "").otherwise("\n## Three\n"))
    made = F.concat(F.lit("# "), F.upper("p_brand"), F.when(F.col("p_size") % 2 == 0, "\n").otherwise("\n\n## two\n"))
    h = lambda c: F.transform(tx.headings(c), lambda x: F.lower(tx.single_line(x)))
    return t.part.select("p_partkey", F.round(metrics.bag_f1(h(truth), h(made)), 6).alias("f1"))


@query("MT-11", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cer, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS word_f1 FROM part")
def failed_runs(t: Tables) -> DataFrame:
    """A failed document scores as an empty output."""
    rows = t.part.select("p_partkey", F.col("p_name").alias("truth"), F.col("p_name").alias("output"), F.when(F.col("p_size") % 3 == 0, "crash").alias("error"))
    return benchmark.scored(rows).select("p_partkey", "cer", "word_f1")


@query("MT-12", "SELECT 'd' || p_partkey AS path, 0.0::DOUBLE AS cer, 1.0::DOUBLE AS word_f1 FROM part")
def rescored_runs(t: Tables) -> DataFrame:
    """Saved outputs against a truth that was corrected since."""
    key = F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("path")
    saved = t.part.select(key, F.col("p_type").alias("output"), F.col("p_name").alias("truth"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("cer"))
    return benchmark.rescored(saved, t.part.select(key, F.col("p_type").alias("truth"))).select("path", "cer", "word_f1")


@query("MT-13", "SELECT region, coalesce(CAST(round(avg(CASE WHEN passed THEN step % 5 END), 4) AS VARCHAR), '-') AS said FROM attempts GROUP BY region", "attempts")
def printed_means(t: Tables) -> DataFrame:
    rows = t.attempts.select("region", F.when(F.col("passed"), F.col("step") % 5).alias("v"))
    return rows.groupBy("region").agg(benchmark.mean4("v").alias("m")).select("region", benchmark.printed(F.col("m")).alias("said"))
