"""Queries of what surrounds the engines: ruled tables, crops, readings and evidence, fallbacks, retries, jobs, evaluation sets, sinks that
are read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..engine import Engine, Systems
from ..functions import images
from ..functions.geometry import Box
from ..functions.udf import each, vectorised
from ..operators import corpus, execute, handlers, layout
from ..session import scratch
from ..settings import PRODUCTS, Engines
from ..sources import readers, writers
from ..streaming import jobs
from .registry import query
from .text_queries import GARBLED
from .views import Tables

# --- sources ----------------------------------------------------------------------------------------------------------------


@query("SRC-06", """SELECT b.page, b.idx, CAST(greatest(1, len(list_filter(s.xs, lambda x: b.x0 - 0.5 <= x AND x < b.x1 - 0.5))) AS INT) AS colspan, CAST(greatest(1, len(list_filter(s.ys, lambda y: b.y0 - 0.5 <= y AND y < b.y1 - 0.5))) AS INT) AS rowspan
FROM boxes b JOIN (SELECT page, list(DISTINCT round(x0, 1)) AS xs, list(DISTINCT round(y0, 1)) AS ys FROM boxes GROUP BY page) s ON b.page = s.page""", "boxes")
def ruled(t: Tables) -> DataFrame:
    """Boxes of an order as the cells of one table."""
    return handlers.ruled_table(t.boxes, ["page"]).select("page", "idx", "colspan", "rowspan")


@query("SRC-07", "SELECT page, idx, x0, y0, least(x1, 380.0::DOUBLE) AS x1, least(y1, 600.0::DOUBLE) AS y1 FROM boxes WHERE type = 'image' AND least(x1, 380.0::DOUBLE) > x0 AND least(y1, 600.0::DOUBLE) > y0", "boxes")
def image_boxes(t: Tables) -> DataFrame:
    cut = handlers.on_page(Box.of(), F.lit(380.0), F.lit(600.0))
    return t.boxes.where("type = 'image'").where((cut.width() > 0) & (cut.height() > 0)).select("page", "idx", cut.x0.alias("x0"), cut.y0.alias("y0"), cut.x1.alias("x1"), cut.y1.alias("y1"))


@query("SRC-12", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def manifest_lines(t: Tables) -> DataFrame:
    """The manifest as JSON lines, read again, with a second one that isn't there."""
    schema, path = "doc_id long, source string, n_chars long", scratch(t.spark, "manifest")
    t.documents.select("doc_id", "source", "n_chars").write.mode("overwrite").json(path)
    rows = readers.json_lines(t.spark, path, schema).unionByName(readers.json_lines(t.spark, f"{path}-none", schema))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


SITE_SQL = """SELECT doc_id, 'c' || (doc_id % 200) AS company, CASE doc_id % 6 WHEN 0 THEN 'https://www.h' || (doc_id % 150) || '.vn/' || lang WHEN 1 THEN 'http://h' || (doc_id % 150) || '.com' WHEN 2 THEN 'https://www.facebook.com/p' || doc_id WHEN 3 THEN 'https://x.gov.vn' WHEN 4 THEN 'ftp://h1.vn' ELSE 'https://known' || (doc_id % 7) || '.vn' END AS site, lang AS industry FROM documents"""


@query("SRC-19", f"""WITH s AS ({SITE_SQL}), h AS (SELECT *, regexp_replace(regexp_extract(site, '^https?://([^/]*)', 1), '^www\\.', '') AS host FROM s WHERE site LIKE 'http%'),
k AS (SELECT * FROM h WHERE host NOT IN ('facebook.com', 'x.gov.vn', 'known3.vn')),
one AS (SELECT company, arg_min(site, (NOT host LIKE '%.vn', length(site), site, industry)) AS site, arg_min(industry, (NOT host LIKE '%.vn', length(site), site, industry)) AS industry, arg_min(host, (NOT host LIKE '%.vn', length(site), site, industry)) AS host FROM k GROUP BY company)
SELECT min(company) AS company, arg_min(site, company) AS site, arg_min(industry, company) AS industry FROM one GROUP BY host""")
def sites(t: Tables) -> DataFrame:
    """Addresses with social, public, known and other hosts to one for each company and host."""
    k, d = F.col("doc_id") % 6, lambda n: (F.col("doc_id") % n).cast("string")
    site = (
        F.when(k == 0, F.concat(F.lit("https://www.h"), d(150), F.lit(".vn/"), "lang")).when(k == 1, F.concat(F.lit("http://h"), d(150), F.lit(".com"))).when(k == 2, F.concat(F.lit("https://www.facebook.com/p"), F.col("doc_id").cast("string")))
        .when(k == 3, "https://x.gov.vn").when(k == 4, "ftp://h1.vn").otherwise(F.concat(F.lit("https://known"), d(7), F.lit(".vn")))
    )
    known = t.spark.createDataFrame([("known3.vn",)], "host string")
    return corpus.company_sites(t.documents.select(F.concat(F.lit("c"), d(200)).alias("company"), site.alias("site"), F.col("lang").alias("industry")), known, ".vn")


@query("SRC-24", """SELECT page, CASE turn WHEN 0 THEN [s, 0, 0, s, 0, 0] WHEN 90 THEN [0, s, -s, 0, y1 * s, 0] WHEN 180 THEN [-s, 0, 0, -s, x1 * s, y1 * s] ELSE [0, -s, s, 0, 0, x1 * s] END AS matrix
FROM (SELECT page, idx % 4 * 90 AS turn, x1, y1, (100 + l_partkey % 3 * 100) / 72 AS s FROM boxes WHERE idx <= 4)""", "boxes")
def matrices(t: Tables) -> DataFrame:
    made = handlers.pixel_matrix(F.col("idx") % 4 * 90, F.col("x1"), F.col("y1"), 100 + F.col("l_partkey") % 3 * 100)
    return t.boxes.where("idx <= 4").select("page", made.alias("matrix"))


@query("SRC-26", """WITH tries AS (SELECT 'https://h' || (event_id // 4) AS origin, event_id % 4 AS attempt, CASE user_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 500 END AS status FROM events),
used AS (SELECT * FROM tries WHERE attempt < 3)
SELECT origin, CASE WHEN min(attempt) FILTER (WHERE status < 500) IS NULL THEN 'deny all' WHEN arg_min(status, attempt) FILTER (WHERE status < 500) = 200 THEN 'rules' ELSE 'allow all' END AS rule, coalesce(min(attempt) FILTER (WHERE status < 500), max(attempt)) + 1 AS tries,
  coalesce(CAST(sum(2 + 4 * attempt) FILTER (WHERE coalesce(status, 599) >= 500 AND attempt < first) AS BIGINT), 0) AS waited
FROM (SELECT *, coalesce(min(attempt) FILTER (WHERE status < 500) OVER (PARTITION BY origin), 9) AS first FROM used) GROUP BY origin""")
def robots_tries(t: Tables) -> DataFrame:
    """Events as tries: answers of all kinds and none."""
    k = F.col("user_id") % 5
    status = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).when(k == 3, 500)
    return handlers.robots_found(t.events.select(F.concat(F.lit("https://h"), F.floor(F.col("event_id") / 4).cast("string")).alias("origin"), (F.col("event_id") % 4).alias("attempt"), status.alias("status")))


@query("SRC-28", """WITH c AS (SELECT source AS kind, source || ':' || doc_id AS key, n_chars AS chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha1(key), key) AS rn FROM c WHERE chars >= 20),
p AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n FROM r WHERE rn <= 25)
SELECT kind, key, CASE WHEN rn <= round_even(0.3 * n, 0) THEN 'dev' ELSE 'test' END AS split, unnest(['digital_pdf', 'docx', 'scan']) AS rendering FROM p""")
def evaluation_set(t: Tables) -> DataFrame:
    rows = handlers.evaluation_jobs(t.documents.select(F.col("source").alias("kind"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("chars")), 25)
    return rows.select("kind", "key", "split", F.explode(F.array(F.lit("digital_pdf"), F.lit("docx"), F.lit("scan"))).alias("rendering"))


# --- sinks ------------------------------------------------------------------------------------------------------------------


@query("SNK-01", "SELECT 'd' || doc_id AS stem, text AS markdown, source, lang FROM documents WHERE text IS NOT NULL")
def outputs(t: Tables) -> DataFrame:
    """Markdown and JSON written, and read again."""
    path = scratch(t.spark, "outputs")
    docs = t.documents.where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), F.col("text").alias("markdown"), "source", "lang")
    writers.write_outputs(docs, path)
    said = t.spark.read.schema("stem string, source string, lang string").json(f"{path}/json")
    return t.spark.read.parquet(f"{path}/markdown").join(said, "stem").select("stem", "markdown", "source", "lang")


@query("SNK-09", "SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS run FROM documents")
def resumed(t: Tables) -> DataFrame:
    """A report of a third of the documents, then resumed: each document is in it once."""
    path, rows = scratch(t.spark, "report"), t.documents.select("doc_id", "n_chars")
    writers.resume_report(rows.where("doc_id % 3 = 0").withColumn("run", F.lit(0)), "doc_id", path)
    writers.resume_report(rows.withColumn("run", F.lit(1)), "doc_id", path)
    return t.spark.read.parquet(path).select("doc_id", "n_chars", "run")


@query("SNK-10", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'test' END AS split, source AS category, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL")
def written_manifest(t: Tables) -> DataFrame:
    path = scratch(t.spark, "items")
    writers.write_manifest(t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("test").alias("split"), F.col("source").alias("category")), path)
    rows = t.spark.read.schema("doc_id long, split string, category string").json(path).groupBy("split", "category")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ","), 256).alias("digest"))


@query("SNK-11", """SELECT event_id, CASE WHEN route IN ('extract', 'create') THEN CASE WHEN size = 0 THEN 400 WHEN size > 209715200 THEN 413 WHEN bad THEN 422 WHEN route = 'extract' THEN CASE WHEN ok THEN 200 ELSE 415 END ELSE 202 END
  WHEN state IS NULL THEN 404 WHEN route = 'markdown' AND state <> 'done' THEN 409 ELSE 200 END AS status FROM (
  SELECT event_id, ['extract', 'create', 'job', 'markdown'][CAST(event_id % 4 AS INT) + 1] AS route, user_id % 7 * 50000000 AS size, event_id % 11 = 0 AS bad, event_type <> 'error' AS ok, CASE user_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'running' END AS state FROM events)""")
def answers(t: Tables) -> DataFrame:
    route = F.element_at(F.array(*map(F.lit, ("extract", "create", "job", "markdown"))), (F.col("event_id") % 4 + 1).cast("int"))
    state = F.when(F.col("user_id") % 3 == 0, "done").when(F.col("user_id") % 3 == 1, "running")
    return t.events.select("event_id", handlers.answer(route, F.col("user_id") % 7 * 50_000_000, F.col("event_type") != "error", F.col("event_id") % 11 != 0, state).cast("int").alias("status"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


BLOCKS_SQL = f"""SELECT conv_id, '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>' || {_esc('arg_min(text, turn)')} || '</title></head><body>' || string_agg(html, chr(10) ORDER BY turn) || '</body></html>' AS html, string_agg(md, chr(10) || chr(10) ORDER BY turn) AS markdown FROM (
  SELECT conv_id, turn, text, CASE k WHEN 0 THEN '<h1>' || {_esc('text')} || '</h1>' WHEN 1 THEN '<ul><li>' || array_to_string(list_transform(items, lambda i: {_esc('i')}), '</li><li>') || '</li></ul>' WHEN 2 THEN '<ol><li>' || array_to_string(list_transform(items, lambda i: {_esc('i')}), '</li><li>') || '</li></ol>' WHEN 3 THEN '<table border="1" cellspacing="0" cellpadding="3">' || text || '</table>' ELSE '<p>' || {_esc('text')} || '</p>' END AS html,
    CASE k WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || array_to_string(items, chr(10) || '- ') WHEN 2 THEN array_to_string(list_transform(items, lambda i, n: n || '. ' || i), chr(10)) WHEN 3 THEN '<table>' || text || '</table>' ELSE text END AS md
  FROM (SELECT *, CASE turn % 5 WHEN 0 THEN 0 ELSE turn % 5 END AS k, string_split(text, '. ') AS items FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)) GROUP BY conv_id"""


@query("SNK-12", BLOCKS_SQL)
def ground_truth_pages(t: Tables) -> DataFrame:
    """Turns as headings, lists, tables and paragraphs."""
    kind = F.element_at(F.array(*map(F.lit, ("h1", "ul", "ol", "table", "p"))), (F.col("turn") % 5 + 1).cast("int"))
    value = F.when(kind == "table", F.concat(F.lit("<table>"), "text", F.lit("</table>"))).otherwise(F.col("text"))
    rows = t.conversations.where("text is not null and role is not null").select("conv_id", "turn", kind.alias("kind"), value.alias("value"), F.split("text", r"\. ").alias("items"))
    return handlers.written_blocks(rows, "conv_id", "turn", F.lit("en"))


# --- images and layout ------------------------------------------------------------------------------------------------------


@query("IMG-04", """SELECT page, idx, [cw, ch] AS crop, [greatest(1, CAST(round_even(w * f, 0) AS INT)), greatest(1, CAST(round_even(h * f, 0) AS INT))] AS second FROM (
  SELECT page, idx, w, h, CASE WHEN greatest(w, h) > 2000 THEN 0.75 ELSE 1.5 END AS f, CASE WHEN h < 48 THEN greatest(1, CAST(round_even(w * (48.0::DOUBLE / greatest(h, 1)), 0) AS INT)) ELSE w END + 24 AS cw, greatest(h, 48) + 24 AS ch FROM (SELECT page, idx, CAST(x1 - x0 AS INT) * 12 AS w, CAST(y1 - y0 AS INT) AS h FROM boxes))""", "boxes")
def crop_sizes(t: Tables) -> DataFrame:
    w, h = (F.col("x1") - F.col("x0")).cast("int") * 12, (F.col("y1") - F.col("y0")).cast("int")
    return t.boxes.select("page", "idx", w.alias("w"), h.alias("h")).select("page", "idx", F.array(*[c.cast("int") for c in handlers.crop_size(F.col("w"), F.col("h"))]).alias("crop"), F.array(*handlers.second_size(F.col("w"), F.col("h"))).alias("second"))


@query("EX-08", """SELECT page, type, count(*) AS n, min(backend) AS backend FROM (
  SELECT page, type, 'model' AS backend FROM boxes WHERE page % 3 = 0 UNION ALL SELECT page, type, 'pdf-heuristic' FROM boxes WHERE page % 3 = 1 UNION ALL SELECT DISTINCT page, 'text', 'full-page' FROM boxes WHERE page % 3 = 2) GROUP BY page, type""", "boxes")
def fallbacks(t: Tables) -> DataFrame:
    """The model answers for a third of the pages; of the others half are digital."""
    box = t.boxes.withColumn("label", F.col("type"))
    pages = box.select("page").distinct().select("page", F.when(F.col("page") % 3 == 2, "scanned").otherwise("digital").alias("kind"), F.lit(600).alias("width"), F.lit(800).alias("height"))
    made = handlers.page_layouts(pages, box.where("page % 3 = 0"), box.where("page % 2 >= 0"))
    return made.groupBy("page", "type").agg(F.count(F.lit(1)).alias("n"), F.min("backend").alias("backend"))


# --- readings and evidence --------------------------------------------------------------------------------------------------


@query("EX-06", """SELECT conv_id, array_to_string(list_transform(list_filter(l, lambda x: x.score >= 0.9), lambda x: x.text), ' ') AS trusted_text, list_transform(l, lambda x: x.score) AS line_scores,
  round(list_sum(list_transform(l, lambda x: x.score * greatest(1, length(x.text)))) / list_sum(list_transform(l, lambda x: greatest(1, length(x.text)))), 6) AS confidence
FROM (SELECT conv_id, list({'text': text, 'score': (70 + (conv_id + turn * 7) % 30) / 100.0::DOUBLE} ORDER BY turn) AS l FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)""")
def readings(t: Tables) -> DataFrame:
    """Turns as lines of a crop with their scores."""
    line = F.struct("turn", "text", ((70 + (F.col("conv_id") + F.col("turn") * 7) % 30) / 100).alias("score"))
    rows = t.conversations.where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    made = rows.select("conv_id", handlers.reading(F.transform("l", lambda x: F.struct(x.text.alias("text"), x.score.alias("score")))).alias("r"))
    return made.select("conv_id", "r.trusted_text", "r.line_scores", F.round("r.confidence", 6).alias("confidence"))


REGION_SQL = "SELECT doc_id, ['text', 'chart', 'image', 'seal', 'table'][CAST(doc_id % 5 AS INT) + 1] AS type, CASE WHEN doc_id % 13 = 0 THEN 'skipped' ELSE 'passed' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'vlm' END AS method, source AS content, CASE WHEN doc_id % 2 = 0 THEN lang END AS layer, doc_id % 7 = 0 AS failed FROM documents"
FIGURE_SQL = "CASE WHEN type IN ('chart', 'image', 'seal') AND status <> 'skipped' THEN CASE WHEN type = 'seal' AND method = 'ocr' THEN content WHEN layer IS NOT NULL THEN layer WHEN NOT failed THEN 'read ' || doc_id END END"


def _figures(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("text", "chart", "image", "seal", "table"))), (k % 5 + 1).cast("int"))
    rows = t.documents.select(k.alias("region_id"), kind.alias("type"), F.when(k % 13 == 0, "skipped").otherwise("passed").alias("status"), F.when(k % 3 == 0, "ocr").otherwise("vlm").alias("method"), F.col("source").alias("content"), F.when(k % 2 == 0, F.col("lang")).alias("text_layer"))
    read = t.documents.select(k.alias("region_id"), F.concat(F.lit("read "), k.cast("string")).alias("ocr_text"), F.when(k % 7 == 0, "timeout").alias("error"))
    return handlers.figure_text(rows, read)


@query("EX-07", f"SELECT doc_id, {FIGURE_SQL} AS figure_text, type = 'table' AND layer IS NULL AS ocr_first FROM ({REGION_SQL})")
def figure_texts(t: Tables) -> DataFrame:
    return _figures(t).select(F.col("region_id").alias("doc_id"), "figure_text", handlers.needs_table_evidence(F.col("type"), F.col("text_layer"), F.lit(None).cast("string")).alias("ocr_first"))


@query("EX-14", f"""SELECT doc_id, CASE WHEN type IN ('table', 'chart', 'image') THEN type END AS task, CASE WHEN type IN ('chart', 'image', 'seal') THEN figure ELSE layer END AS hint, CASE WHEN figure IS NULL THEN 'v=1' ELSE 'figure_text=' || figure || ',v=1' END AS data FROM (SELECT *, {FIGURE_SQL} AS figure FROM ({REGION_SQL}))""")
def vlm_tasks(t: Tables) -> DataFrame:
    rows = _figures(t).withColumns({"r": handlers.vlm_request(F.col("type"), F.col("figure_text"), F.col("text_layer")), "d": handlers.with_figure_text(F.create_map(F.lit("v"), F.lit("1")), F.col("figure_text"))})
    pairs = F.array_sort(F.transform(F.map_entries("d"), lambda e: F.concat_ws("=", e.key, e.value)))
    return rows.select(F.col("region_id").alias("doc_id"), "r.task", "r.hint", F.array_join(pairs, ",").alias("data"))


@query("EX-09", r"""SELECT event_id, CASE WHEN regexp_matches(c, '^R{3}') THEN 'gave up' WHEN regexp_matches(c, '^R*O') THEN 'ok' WHEN regexp_matches(c, '^R*[FE]') THEN 'error' END AS outcome, CAST(least(2, length(regexp_extract(c, '^R*'))) AS INT) AS retries, 2.0::DOUBLE ** (least(2, length(regexp_extract(c, '^R*'))) + 1) - 2 AS waited
FROM (SELECT event_id, regexp_replace(code, '^(R{0,2})F', '\1') AS c FROM (SELECT event_id, list_reduce(list_transform([0, 1, 2, 3, 4], lambda i: ['R', 'O', 'F', 'R', 'E', 'R', 'R'][CAST((event_id // CAST(power(7, i) AS BIGINT)) % 7 AS INT) + 1]), lambda a, b: a || b) || 'O' AS code FROM events))""")
def retries(t: Tables) -> DataFrame:
    """Answers by the digits of the event's number to base 7; the last is always good."""
    codes = F.array(F.lit(503), F.lit(200), F.lit(400), F.lit(429), F.lit(404), F.lit(None).cast("int"), F.lit(500))
    seen = F.array(*[F.element_at(codes, (F.floor(F.col("event_id") / 7**i) % 7 + 1).cast("int")) for i in range(5)], F.lit(200))
    return t.events.select("event_id", handlers.retried(seen).alias("r")).select("event_id", "r.*")


@query("EX-10", """SELECT event_id, state, CAST(coalesce(sum(CASE WHEN state <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation
FROM (SELECT event_id, user_id, CASE WHEN value > 88 THEN 'memory' WHEN event_id % 50 > 45 THEN 'timeout' ELSE 'ok' END AS state FROM events)""")
def worker_processes(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.col("value").alias("rss"), (F.col("event_id") % 50).alias("seconds"))
    return handlers.isolated(rows, "user_id", "event_id", 100.0, 45.0).select("event_id", "state", "generation")


@query("EX-12", """SELECT page, idx, CAST(floor((idx - 1) / 3) AS INT) AS batch, round(avg(y1) OVER (PARTITION BY page, floor((idx - 1) / 3)), 1) AS duration_ms FROM boxes""", "boxes")
def batch_times(t: Tables) -> DataFrame:
    rows = t.boxes.select("page", F.col("idx").alias("number"), F.col("y1").alias("ms"))
    return handlers.page_batches(rows, "page", 3).select("page", F.col("number").alias("idx"), "batch", "duration_ms")


@query("EX-15", """SELECT system, error, CASE WHEN error IS NULL THEN CAST(ceil(n / 64.0::DOUBLE) AS BIGINT) END AS batches, CASE WHEN error IS NULL THEN round(ms, 1) END AS ms_per_line FROM (
  SELECT user_id AS system, arg_min(props, rn) FILTER (WHERE bad) AS error, count(*) AS n, avg(event_id % 40) FILTER (WHERE rn > 8) AS ms FROM (SELECT *, event_type = 'error' AND event_id % 9 = 0 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id)""")
def recognisers(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("system"), "event_id", (F.col("event_id") % 40).alias("ms"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), F.col("props")).alias("error"))
    return handlers.line_timings(rows, "system", "event_id")


@query("EX-16", """SELECT doc_id, CAST(n AS INT) AS pages_processed, ms AS duration_ms, round(ms / greatest(1, n), 1) AS ms_per_page FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars // 500 + 1 AS INT) ELSE 1 END AS n, CAST(n_chars % 997 AS DOUBLE) AS ms FROM documents)""")
def timings(t: Tables) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, "PDF").otherwise("docx")
    made = handlers.timed((F.floor(F.col("n_chars") / 500) + 1).cast("int"), (F.col("n_chars") % 997).cast("double"), suffix)
    return t.documents.select("doc_id", made.alias("x")).select("doc_id", "x.*")


# --- engines and settings by name, streams ----------------------------------------------------------------------------------


@query("UDF-02", """SELECT event_id, CASE WHEN b IN ('none', 'heuristic') THEN FALSE WHEN b = 'paddle' AND NOT i THEN NULL ELSE i END AS wanted FROM (SELECT event_id, ['auto', 'paddle', 'none', 'heuristic'][CAST(event_id % 4 AS INT) + 1] AS b, user_id % 2 = 0 AS i FROM events)""")
def engines_wanted(t: Tables) -> DataFrame:
    backend = F.element_at(F.array(*map(F.lit, ("auto", "paddle", "none", "heuristic"))), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", handlers.wanted(backend, F.col("user_id") % 2 == 0).alias("wanted"))


@query("UDF-08", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang IN ('vi', 'en') ELSE lang IN ('vi', 'en', 'ja') END AS valid FROM documents")
def languages_of_products(t: Tables) -> DataFrame:
    names = list(PRODUCTS)
    own = lambda k: F.col("lang").isin(*PRODUCTS[k].languages)
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, own(names[0])).otherwise(own(names[1])).alias("valid"))


def _stream(t: Tables, table: str) -> DataFrame:
    known = getattr(t, table).schema
    return t.spark.readStream.schema(known).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/{table}.parquet*")


@query("STR-01", "SELECT 'd' || doc_id AS path, 'done' AS state, sha256(coalesce(text, '')) AS sha256 FROM documents")
def streamed_jobs(t: Tables) -> DataFrame:
    """Documents through the job stream; every batch's results and job rows read back."""
    out = scratch(t.spark, "jobs")
    files = _stream(t, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    jobs.run_jobs(files, lambda batch: batch.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")), out, f"{out}/checkpoint").awaitTermination()
    done = t.spark.read.schema("path string, state string, error string").json(f"{out}/jobs").select("path", "state")
    return t.spark.read.parquet(f"{out}/results").select("path", "sha256").join(done, "path").select("path", "state", "sha256")


@query("STR-02", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def streamed_log(t: Tables) -> DataFrame:
    """Events through the append-only log, started twice: each row is in it once."""
    out = scratch(t.spark, "log")
    for _ in range(2):
        jobs.append_log(_stream(t, "events").select("event_id", "event_type"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = t.spark.read.schema("event_id long, event_type string").json(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# --- the engine as one object, DOCX -----------------------------------------------------------------------------------------

PARTS_SQL = r"list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: trim(x, ' ')), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ') <> '')"


@query("UDF-05", f"SELECT 'd' || doc_id AS stem, CASE WHEN text IS NOT NULL THEN CASE WHEN len(p) > 0 THEN sha256(trim(array_to_string(p, chr(10) || chr(10)), ' ') || chr(10)) ELSE sha256('') END END AS markdown, len(coalesce(p, [])) AS regions FROM (SELECT doc_id, text, {PARTS_SQL} AS p FROM documents)")
def extracted(t: Tables) -> DataFrame:
    """Documents as text files through the public interface; a quarter of their paragraphs' plans are the engine's own."""
    files = t.documents.select(F.concat(F.lit("in/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    made = Engine(t.spark).extract(files).documents
    return made.select("stem", F.sha2("markdown", 256).alias("markdown"), F.col("regions").cast("long").alias("regions"))


@query("EX-11", "SELECT doc_id, text AS output, CASE WHEN text IS NULL THEN 'no text' END AS error FROM documents")
def text_layer_system(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return Systems().by_name["text_layer"](files).select(F.col("path").cast("long").alias("doc_id"), "output", "error")


@query("UDF-04", "SELECT source AS category, count(*) AS documents, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS cer FROM documents WHERE length(trim(lang)) > 0 GROUP BY source")
def plugged_in(t: Tables) -> DataFrame:
    """A system of the caller's: it reads what is there, and fails on a third."""
    failing = F.col("path").cast("long") % 3 == 0
    systems = Systems().register("own", lambda files: files.select("path", F.when(~failing, F.decode("content", "UTF-8")).alias("output"), F.when(failing, "timeout").alias("error")))
    docs = t.documents.where("length(trim(lang)) > 0").select(F.col("doc_id").cast("string").alias("path"), "lang", "source")
    rows = systems.run("own", docs.select("path", F.encode("lang", "UTF-8").alias("content")), docs.select("path", F.col("lang").alias("truth"), F.col("source").alias("category")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.avg("cer"), 6).alias("cer"))


@each("binary")
def _docx_of(parts: list[str]) -> bytes:
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{"Heading2" if i % 3 == 0 else "Normal"}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(parts))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("SRC-08", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS place, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 = 0 THEN 'heading' ELSE 'text' END AS type, text FROM conversations WHERE text = trim(text) AND text <> ''")
def docx_blocks(t: Tables) -> DataFrame:
    """Conversations written as DOCX files, whose blocks are read."""
    rows = t.conversations.where("text = trim(text) and text <> ''").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("parts"))
    return readers.docx(rows.select("conv_id", _docx_of(F.col("parts")).alias("content"))).select("conv_id", "place", "type", "text")


@query("SRC-23", "SELECT path, kind, count(*) AS regions FROM (SELECT 'c' || conv_id || '.docx' AS path, 'docx' AS kind FROM conversations WHERE text = trim(text) AND text <> '' UNION ALL SELECT 'd' || doc_id || '.txt', 'pdf_text' FROM (SELECT doc_id, unnest(" + PARTS_SQL + ") FROM documents)) GROUP BY ALL")
def mixed_files(t: Tables) -> DataFrame:
    """DOCX files, whose blocks are final, and text files, whose paragraphs are routed, in one run."""
    talks = t.conversations.where("text = trim(text) and text <> ''").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("parts"))
    files = talks.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), _docx_of(F.col("parts")).alias("content"))
    files = files.unionByName(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    return Engine(t.spark).extract(files).regions.groupBy(F.col("doc").alias("path"), F.col("method").alias("kind")).agg(F.count(F.lit(1)).alias("regions"))


@query("FLT-04-drawings", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY idx DESC, l_partkey DESC, x0, y0) AS rn FROM boxes)
SELECT d.page, d.idx, d.l_partkey FROM r d WHERE rn = 1 AND (d.x1 - d.x0) * (d.y1 - d.y0) >= 0.02::DOUBLE * 500000 AND d.x1 - d.x0 >= 40 AND d.y1 - d.y0 >= 40
  AND NOT EXISTS (SELECT 1 FROM r t WHERE t.page = d.page AND t.rn > 1 AND t.type = 'table' AND greatest(0, least(d.x1, t.x1) - greatest(d.x0, t.x0)) * greatest(0, least(d.y1, t.y1) - greatest(d.y0, t.y0)) > 0.5 * least((d.x1 - d.x0) * (d.y1 - d.y0), (t.x1 - t.x0) * (t.y1 - t.y0)))
  AND coalesce((SELECT sum(t.l_partkey % 300) FROM r t WHERE t.page = d.page AND t.rn > 1 AND t.type <> 'table' AND (t.x0 + t.x1) / 2 BETWEEN d.x0 AND d.x1 AND (t.y0 + t.y1) / 2 BETWEEN d.y0 AND d.y1), 0) <= 400""", "boxes")
def drawings(t: Tables) -> DataFrame:
    """The last box of a page as its drawing, tables as candidates, the others as lines."""
    rows = t.boxes.withColumn("rn", F.row_number().over(W.partitionBy("page").orderBy(F.desc("idx"), F.desc("l_partkey"), "x0", "y0")))
    kind = F.when(F.col("rn") == 1, "drawing").when(F.col("type") == "table", "candidate").otherwise("line")
    taken = layout.figure_drawings(rows.select("page", F.col("rn").alias("idx"), kind.alias("kind"), "x0", "y0", "x1", "y1", (F.col("l_partkey") % 300).alias("chars")), ["page"], 500000.0)
    return rows.join(taken.select("page", F.col("idx").alias("rn")), ["page", "rn"]).select("page", "idx", "l_partkey")


@query("FLT-11-trusted", f"""WITH d AS (SELECT *, {GARBLED} AS g FROM documents) SELECT DISTINCT source AS page FROM documents WHERE source <> 'web' AND source NOT IN (SELECT source FROM d WHERE length(trim(text)) >= 20 AND g > 0.02)""")
def trusted(t: Tables) -> DataFrame:
    """Sources as pages, one of them in a legacy font, documents as their blocks."""
    pages = t.documents.select(F.col("source").alias("page")).distinct().select("page", F.lit("digital").alias("kind"), (F.col("page") == "web").alias("legacy_fonts"))
    return corpus.trusted_pages(pages, t.documents.select(F.col("source").alias("page"), "text"), ["page"]).select("page")


@vectorised("struct<inverted:boolean,stretched:boolean>", once=True)
def _tones(pixels: pd.Series) -> pd.DataFrame:
    made = []
    for x in pixels:
        grey = images.square(x)
        light = images.dark_on_light(grey)
        made.append((light is not grey, images.stretched(light)[1]))
    return pd.DataFrame(made, columns=["inverted", "stretched"], index=pixels.index)


@query("IMG-03", """SELECT vec_id, list_median(v) < 128 AND list_median(list_concat(list_concat(v[1:side], v[-side:]), list_concat(list_filter(v, lambda x, i: (i - 1) % side = 0), list_filter(v, lambda x, i: i % side = 0)))) < 128 AS inverted, list_stddev_pop(v) < 45 AS stretched
FROM (SELECT vec_id, side, list_concat(list_transform(e, lambda x: (x - low) * (255.0::DOUBLE / (high - low))), list_transform(range(side * side - len(e)), lambda i: 255.0::DOUBLE)) AS v FROM (
  SELECT vec_id, e, CAST(ceil(sqrt(len(e))) AS BIGINT) AS side, list_min(e) AS low, list_max(e) AS high FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)))""")
def tones(t: Tables) -> DataFrame:
    """Embeddings as small grey images: which are light on dark, which are faint."""
    return t.embeddings.select("vec_id", _tones(F.col("embedding").cast("array<double>")).alias("c")).select("vec_id", "c.*")


@query("UDF-01", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) END AS content, CASE WHEN doc_id % 2 = 1 THEN 'KeyError: no reader' END AS error FROM documents")
def engines_by_name(t: Tables) -> DataFrame:
    """Two engines registered by name, one of which fails on all its batches."""

    def loud(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"region_id": batch["region_id"], "content": batch["text_layer"].str.upper()})

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise KeyError("no reader")

    engines = Engines().register("loud", loud).register("broken", broken)
    rows = t.documents.select(F.col("doc_id").cast("string").alias("region_id"), F.col("source").alias("text_layer"), (F.col("doc_id") % 2).alias("k"))
    made = [execute.run_engine(rows.where(F.col("k") == k).drop("k"), engines.by_method[name]) for k, name in enumerate(engines.available)]
    return made[0].unionByName(made[1]).select(F.col("region_id").cast("long").alias("doc_id"), "content", F.replace("error", F.lit("'"), F.lit("")).alias("error"))


@query("UDF-09", "SELECT user_id, round(sum(s * w) / sum(w), 6) AS confidence FROM (SELECT user_id, value / 100 AS s, greatest(1, length(event_type)) AS w FROM events) GROUP BY user_id")
def confidences(t: Tables) -> DataFrame:
    """A user's events as the lines of one reading."""
    line = F.struct(F.col("event_type").alias("text"), (F.col("value") / 100).alias("score"))
    return t.events.groupBy("user_id").agg(F.collect_list(line).alias("l")).select("user_id", F.round(handlers.reading(F.col("l"))["confidence"], 6).alias("confidence"))


@query("STR-04", "SELECT source, sha256(string_agg('d' || doc_id || chr(10), '' ORDER BY doc_id)) AS sha256, CAST(sum(length('d' || doc_id) + 1) AS BIGINT) AS n FROM documents GROUP BY source")
def pushed_files(t: Tables) -> DataFrame:
    """A file for each source put into a watched folder, extracted by the stream."""
    folder, out = scratch(t.spark, "inbox"), scratch(t.spark, "extracted")
    lines = t.documents.select("source", "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(folder)
    files = jobs.new_documents(jobs.inbox(t.spark, folder))
    jobs.run_jobs(files, lambda batch: batch.select("path", "sha256", F.octet_length("content").cast("long").alias("n")), out, f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/results").select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "sha256", "n")
