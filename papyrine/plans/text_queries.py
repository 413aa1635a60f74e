"""Text signals and filters over whole documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx
from ..operators import corpus, layout, routing
from .registry import query
from .views import Tables


def n(pattern: str, of: str = "text") -> str:
    """SQL: the number of matches."""
    return f"len(regexp_extract_all({of}, '{pattern}'))"


VI = f"[{tx.TONES}{tx.TONED_1}]"
LETTERS, ANY_CJK = n(r"\p{L}"), f"[{tx.CJK}]"
#: Letters of a script by two counts, as RE2 cannot intersect classes.
CJK_LETTERS = f"({n(ANY_CJK)} - len(regexp_extract_all(regexp_replace(text, '[^{tx.CJK}]', '', 'g'), '[^\\p{{L}}]')))"
EXPECTED_LETTERS = f"len(regexp_extract_all(regexp_replace(text, '[^{tx.EXPECTED}]', '', 'g'), '\\p{{L}}'))"
TONE_COUNT = f"({n(VI)} + 2 * {n(f'[{tx.TONED_2}]')} + {n(f'[{tx.VI_MARKS}]')})"
LEGACY = (
    f"CASE WHEN {n(r'[\p{L}\x{00A1}-\x{00FF}]')} >= 20 THEN CASE WHEN ({n(r'[\x{00A1}-\x{00FF}]')} - {n(f'[{tx.VI_LATIN1}{tx.LATIN1_SYMBOLS}]')} + 2 * {n(f'[a-zA-Z][{tx.IN_WORD_SYMBOLS}][a-zA-Z]')}) / {n(r'[\p{L}\x{00A1}-\x{00FF}]')} >= 0.08 "
    f"THEN ({n(r'[\x{00A1}-\x{00FF}]')} - {n(f'[{tx.VI_LATIN1}{tx.LATIN1_SYMBOLS}]')} + 2 * {n(f'[a-zA-Z][{tx.IN_WORD_SYMBOLS}][a-zA-Z]')}) / {n(r'[\p{L}\x{00A1}-\x{00FF}]')} ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END"
)
FOREIGN = f"CASE WHEN {LETTERS} >= 20 AND {LETTERS} - {EXPECTED_LETTERS} >= 0.05 * {LETTERS} THEN ({LETTERS} - {EXPECTED_LETTERS}) / {LETTERS} ELSE 0.0::DOUBLE END"
GARBLED = f"CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({n(tx.BROKEN)} + length(text) - length(regexp_replace(text, '{tx.CID}', '', 'g'))) / length(text) + {LEGACY} + {FOREIGN}) END"
LOOKS_VI = f"({TONE_COUNT} >= greatest(2.0, 0.02 * ({LETTERS} - {CJK_LETTERS})))"
BLANK = r"[ \t\n\v\f\r\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("TXT-01", rf"""SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '{tx.SPACE_RUN}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM documents)""")
def normalised(t: Tables) -> DataFrame:
    made = t.documents.select("doc_id", tx.normalize(F.col("text")).alias("t"))
    return made.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("TXT-02", f"SELECT doc_id, round({GARBLED}, 6) AS garbled FROM documents")
def garbled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.garbled_ratio(F.col("text")), 6).alias("garbled"))


@query("TXT-03", f"SELECT doc_id, round({FOREIGN}, 6) AS share FROM documents")
def foreign(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.foreign_script_ratio(F.col("text")), 6).alias("share"))


@query("TXT-04", f"SELECT doc_id, round({LEGACY}, 6) AS share FROM documents")
def legacy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.legacy_encoding_ratio(F.col("text")), 6).alias("share"))


@query("TXT-05", r"SELECT doc_id, regexp_matches(regexp_extract(lower('ABC+' || source || '+.Vn' || lang), '[^+]*$'), '^(\.vn|vni-|vni_|vn-|abc)') AS legacy_font FROM documents")
def legacy_font(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.is_legacy_font(F.concat(F.lit("ABC+"), F.col("source"), F.lit("+.Vn"), F.col("lang"))).alias("legacy_font"))


@query("TXT-06", f"SELECT doc_id, {LOOKS_VI} AS vietnamese FROM documents")
def vietnamese(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.looks_vietnamese(F.col("text")).alias("vietnamese"))


@query("TXT-07", f"""SELECT doc_id, CASE WHEN 2 * cjk + latin < 12 THEN NULL WHEN latin > 0 AND latin > 2 * cjk THEN CASE WHEN marks >= greatest(2.0, 0.02 * latin) THEN 'vi' ELSE 'en' END ELSE 'ja' END AS language
FROM (SELECT doc_id, {CJK_LETTERS} AS cjk, {LETTERS} - {CJK_LETTERS} AS latin, {TONE_COUNT} AS marks FROM documents)""")
def language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query("TXT-08", f"""SELECT doc_id, round(CASE WHEN vi AND n >= 3 THEN CASE WHEN n >= 20 AND NOT dots THEN greatest(share, 0.5) ELSE share END ELSE 0.0 END, 6) AS dropout FROM (
  SELECT doc_id, vi, n, dots, (len(list_filter(w, lambda t: NOT (upper(t) = t AND lower(t) <> t) AND NOT regexp_matches(t, '{tx.VOWEL}')))
    + CASE WHEN len(list_filter(w, lambda t: upper(t) = t AND lower(t) <> t AND length(t) >= 2 AND regexp_matches(t, '{tx.VOWEL}'))) >= 3
      THEN len(list_filter(w, lambda t: upper(t) = t AND lower(t) <> t AND length(t) >= 2 AND NOT regexp_matches(t, '{tx.VOWEL}') AND NOT list_contains({list(tx.VI_ABBREVIATIONS)!r}, t))) ELSE 0 END) / n AS share
  FROM (SELECT doc_id, {LOOKS_VI} AS vi, regexp_extract_all(text, '{tx.WORD}') AS w, len(regexp_extract_all(text, '{tx.WORD}')) AS n, regexp_matches(text, '[\\x{{1EA0}}-\\x{{1EF9}}]') AS dots FROM documents))""")
def dropout(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.dropout_ratio(F.col("text")), 6).alias("dropout"))


@query("TXT-09", f"""SELECT doc_id, CASE WHEN 2 * cjk + latin < 12 THEN 'unknown' WHEN greatest(ja, vi, en2) <= 0 THEN 'other' WHEN ja = greatest(ja, vi, en2) THEN 'ja' WHEN vi = greatest(ja, vi, en2) THEN 'vi' ELSE 'en' END AS language
FROM (SELECT *, CASE WHEN vi > 0 AND en > 0 THEN greatest(0.0, latin - vi) ELSE en END AS en2 FROM (
  SELECT doc_id, cjk, latin, CASE WHEN cjk > 0 AND kana >= 0.05 * cjk THEN 2.0 * cjk ELSE 0.0 END AS ja, CASE WHEN vl >= 0.02 * latin THEN vl / 0.1::DOUBLE ELSE 0.0 END AS vi,
    CASE WHEN nw > 0 AND ne >= 0.02 * nw THEN CAST(latin AS DOUBLE) ELSE 0.0 END AS en FROM (
    SELECT doc_id, {n(r'[\x{3040}-\x{9FFF}]')} AS cjk, {n(r'[\x{3040}-\x{30FF}]')} AS kana, len(regexp_extract_all(regexp_replace(lower(text), '[^\\x{{0000}}-\\x{{2E7F}}]', '', 'g'), '\\p{{L}}')) AS latin,
      len(regexp_extract_all(lower(text), '[{tx.VI_ONLY}]')) AS vl, len(regexp_extract_all(lower(text), '[a-z]+')) AS nw, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains({list(tx.EN_WORDS)!r}, w))) AS ne FROM documents)))""")
def confirmed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.confirmed_language(F.col("text")).alias("language"))


@query("TXT-10", None)
def numbers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.numbers(F.col("text")).alias("numbers"))


@query("TXT-11", f"SELECT sign, CAST(count(*) AS BIGINT) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{tx.SPECIAL}]')) AS sign FROM documents) GROUP BY sign")
def special(t: Tables) -> DataFrame:
    signs = t.documents.select("doc_id", F.explode(tx.special_counts(F.col("text"))).alias("sign", "k"))
    return signs.groupBy("sign").agg(F.sum("k").cast("long").alias("n"), F.count(F.lit(1)).alias("documents"))


@query("TXT-12", """WITH q AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a, regexp_extract_all(replace(lower(text), ' th', ' x'), '[a-z]+') AS b FROM documents),
x AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(a) AS w FROM q) GROUP BY ALL), y AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(b) AS w FROM q) GROUP BY ALL)
SELECT q.doc_id, round(CASE WHEN len(any_value(q.a)) = 0 THEN 1.0 ELSE sum(least(coalesce(x.k, 0), coalesce(y.k, 0))) / len(any_value(q.a)) END, 6) AS recall FROM q LEFT JOIN x USING (doc_id) LEFT JOIN y ON y.doc_id = x.doc_id AND y.w = x.w GROUP BY q.doc_id""")
def recall(t: Tables) -> DataFrame:
    w = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    rows = t.documents.select("doc_id", w(F.lower("text")).alias("a"), w(F.replace(F.lower("text"), F.lit(" th"), F.lit(" x"))).alias("b"))
    share = F.when(F.col("reference") == 0, 1.0).otherwise(F.col("common") / F.greatest("reference", F.lit(1)))
    return rows.select("doc_id", metrics.bag_counts(F.col("a"), F.col("b")).alias("n")).select("doc_id", "n.*").select("doc_id", F.round(share, 6).alias("recall"))


@query("TXT-13", rf"SELECT conv_id, turn, regexp_matches(line, '{tx.BULLET}') AS item, regexp_replace(line, '{tx.BULLET}', '') AS body FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '- ' WHEN 1 THEN '2. ' WHEN 2 THEN 'b) ' ELSE '' END || text AS line FROM conversations)")
def bullets(t: Tables) -> DataFrame:
    mark = F.when(F.col("turn") % 4 == 0, "- ").when(F.col("turn") % 4 == 1, "2. ").when(F.col("turn") % 4 == 2, "b) ").otherwise("")
    line = F.concat(mark, F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.is_list_item(line).alias("item"), tx.strip_bullet(line).alias("body"))


@query("TXT-14", f"SELECT doc_id, len(regexp_extract_all(text || '漢字、カナ abc', '[{tx.CJK}]')) AS n FROM documents")
def cjk_signs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.count(F.concat("text", F.lit("漢字、カナ abc")), f"[{tx.CJK}]").cast("long").alias("n"))


@query("TXT-15", f"SELECT doc_id, a || CASE WHEN regexp_matches(right(a, 1), '^[{tx.CJK}]$') AND regexp_matches(left(b, 1), '^[{tx.CJK}]$') THEN '' ELSE ' ' END || b AS joined FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '漢字' END AS a, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'かな' END AS b FROM documents)")
def joined(t: Tables) -> DataFrame:
    a, b = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("漢字"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("かな")
    return t.documents.select("doc_id", tx.join_inline(a, b).alias("joined"))


@query("TXT-18", None)
def plain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(tx.markdown_to_plain(F.col("html")).cast("binary")).alias("digest"))


@query("TXT-19", f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.TOKEN}') AS w FROM documents)")
def token_lists(t: Tables) -> DataFrame:
    made = t.documents.select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return made.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("TXT-20", f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.WORD}') AS w FROM documents)")
def word_lists(t: Tables) -> DataFrame:
    made = t.documents.select("doc_id", tx.words(F.col("text")).alias("w"))
    return made.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("TXT-21", r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\p{L}\p{N}/]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def slugs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.fold(F.col("text")).cast("binary")).alias("slug"))


def _type_sql(country: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN '{name}'" for name, pattern in corpus.DOC_TYPES[country]) + " ELSE 'other' END"


@query("TXT-22", f"SELECT doc_id, {_type_sql('VN')} AS vn, {_type_sql('JP')} AS jp FROM (SELECT doc_id, coalesce(lower(nfc_normalize(text)), '') AS s FROM documents)")
def document_types(t: Tables) -> DataFrame:
    text = tx.nfc(F.col("text"))  # one column, so that Python makes it once
    return t.documents.select("doc_id", corpus.doc_type(text, "VN").alias("vn"), corpus.doc_type(text, "JP").alias("jp"))


@query("TXT-23", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages")
def hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.domain(F.col("url")).alias("host"))


@query("TXT-24", r"SELECT doc_id, len(h) AS n, array_to_string(h, '|') AS headings FROM (SELECT doc_id, list_transform(regexp_extract_all('## ' || text, '(?m)^#{1,6}[ \t]+.+?[ \t]*$'), lambda x: regexp_replace(regexp_replace(x, '^#+[ \t]+', ''), '[ \t]+$', '')) AS h FROM documents)")
def heading_lists(t: Tables) -> DataFrame:
    h = tx.headings(F.concat(F.lit("## "), F.col("text")))
    return t.documents.select("doc_id", F.size(h).cast("long").alias("n"), F.array_join(h, "|").alias("headings"))


@query("TXT-25", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 7, doc_id % 7 + 1, doc_id % 7 + 2, 3, 9], lambda x: x > 0))), ',') AS pages FROM documents")
def page_specs(t: Tables) -> DataFrame:
    d = (F.col("doc_id") % 7).cast("string")
    spec = F.concat(d, F.lit("-"), (F.col("doc_id") % 7 + 2).cast("string"), F.lit(", 3,9"))
    return t.documents.select("doc_id", F.array_join(tx.page_numbers(spec), ",").alias("pages"))


@query("TXT-26", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def model_json(t: Tables) -> DataFrame:
    said = F.concat(F.lit("<think>a {b} c</think>\n```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.variant_get(tx.first_json(said), "$.k", "bigint").alias("k"))


@query("TXT-34", r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def escaped(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(tx.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query("FLT-01", f"SELECT doc_id, CASE WHEN n_chars < 300 OR g > 0.02 THEN 'scanned' WHEN cov > 0.85 AND lang <> 'en' THEN 'scanned' ELSE 'digital' END AS kind FROM (SELECT doc_id, n_chars, lang, {GARBLED} AS g, (doc_id % 100) / 100 AS cov FROM documents)")
def page_kinds(t: Tables) -> DataFrame:
    kind = layout.page_kind(F.col("n_chars"), tx.garbled_ratio(F.col("text")), (F.col("doc_id") % 100) / 100, F.col("lang") == "en", 300)
    return t.documents.select("doc_id", kind.alias("kind"))


@query("FLT-03", "SELECT event_id, CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'caption' WHEN 'purchase' THEN 'footer' WHEN 'signup' THEN 'code' ELSE 'other' END AS type FROM events")
def label_types(t: Tables) -> DataFrame:
    label = F.when(F.col("event_type") == "view", " Doc Title").when(F.col("event_type") == "click", "Figure-Caption").when(F.col("event_type") == "purchase", "footer_image").when(F.col("event_type") == "signup", "Algorithm").otherwise(F.col("event_type"))
    return t.events.select("event_id", layout.region_type(label).alias("type"))


@query("FLT-06", """SELECT page, l_partkey, plan FROM (SELECT b.*, CASE type
  WHEN 'table' THEN CASE WHEN l_partkey % 3 > 0 THEN 'pdf_table,' ELSE '' END || CASE WHEN l_partkey % 200 > 120 OR (x1 - x0) * (y1 - y0) / 21000 > 0.45 THEN 'vlm,table_recognition,' ELSE 'table_recognition,vlm,' END || CASE WHEN l_partkey % 3 > 0 THEN 'pdf_text' ELSE 'ocr' END
  WHEN 'image' THEN CASE WHEN (x1 - x0) * (y1 - y0) / 21000 < 0.01 THEN '' ELSE 'vlm' END ELSE CASE WHEN l_partkey % 3 > 0 THEN 'pdf_text,ocr' ELSE 'ocr' END END AS plan FROM boxes b)""", "boxes")
def plans(t: Tables) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 21000
    made = routing.plan(F.col("type"), F.lit("digital"), area, F.col("l_partkey") % 3, F.col("l_partkey") % 200, F.lit(False))
    return t.boxes.select("page", "l_partkey", F.array_join(made["plan"], ",").alias("plan"))


@query("FLT-12", "SELECT page_id, len(list_filter(['investor', 'report', 'annual', 'disclosure', 'financial', 'shareholder'], lambda w: contains(u, w))) > 0 AS follow FROM (SELECT page_id, lower(url) || '/report' AS u FROM pages)")
def followed(t: Tables) -> DataFrame:
    return t.pages.select("page_id", corpus.relevance(F.concat(F.lower("url"), F.lit("/report")), "VN")["follow"].alias("follow"))


@query("FLT-13", r"SELECT page_id, len(list_filter(['example.com', 'site1.org', 'org'], lambda b: host = b OR ends_with(host, '.' || b))) > 0 AS same FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)")
def same_sites(t: Tables) -> DataFrame:
    return t.pages.select("page_id", corpus.same_site(tx.domain(F.col("url")), F.array(*map(F.lit, ("example.com", "site1.org", "org")))).alias("same"))


FOLD = "list_reduce(list_transform(string_split(sha1({key}), ''), lambda h: CAST('0x' || h AS INT)), lambda a, d: (a * 16 + d) % {n}, 0)"


@query("FLT-15", f"SELECT doc_id, source FROM documents WHERE {FOLD.format(key='CAST(doc_id AS VARCHAR)', n=7)} = 2")
def sharded(t: Tables) -> DataFrame:
    return t.documents.where(corpus.in_shard(F.col("doc_id").cast("string"), 3, 7)).select("doc_id", "source")


@query("FLT-16", f"SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, {FOLD.format(key="'corpus:' || doc_id", n=100)} AS b FROM documents)")
def splits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", corpus.split_of(F.col("doc_id").cast("string")).alias("split"))


@query("VAL-03", f"SELECT doc_id, CASE WHEN g > 0.02 THEN 'garbled characters (' || CAST(round(g * 100) AS INT) || '%)' ELSE '' END AS issues FROM (SELECT doc_id, {GARBLED} AS g FROM documents)")
def text_checks(t: Tables) -> DataFrame:
    made = routing.text_issues(F.col("text"), F.lit("pdf_text"), F.lit(0.9), F.lit(None).cast("double"), F.array().cast("array<double>"))
    return t.documents.select("doc_id", F.array_join(made, "|").alias("issues"))


@query("VAL-04", """SELECT page, l_partkey, array_to_string(list_filter([CASE WHEN r < 2 OR c < 2 THEN 'degenerate table (' || r || 'x' || c || ')' END, CASE WHEN l_partkey % 5 = 0 THEN 'rows have different numbers of cells' END, CASE WHEN e > 0.6 THEN CAST(round(e * 100) AS INT) || '% empty cells' END], lambda x: x IS NOT NULL), '|') AS issues
FROM (SELECT page, l_partkey, CAST(l_partkey % 9 + 1 AS INT) AS r, CAST(l_partkey % 4 + 1 AS INT) AS c, (l_partkey % 8) / 8 AS e FROM boxes)""", "boxes")
def table_checks(t: Tables) -> DataFrame:
    made = routing.table_issues((F.col("l_partkey") % 9 + 1).cast("int"), (F.col("l_partkey") % 4 + 1).cast("int"), F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 8) / 8, F.lit(0), F.lit(None).cast("double"))
    return t.boxes.select("page", "l_partkey", F.array_join(made, "|").alias("issues"))


@query("VAL-05", r"""SELECT event_id, array_to_string(list_filter([CASE WHEN k % 3 <> 0 THEN 'unbalanced braces' END, CASE WHEN k % 4 = 1 THEN 'unbalanced \left/\right' END, CASE WHEN k % 5 = 2 THEN 'repeated tokens (decoder loop)' END], lambda x: x IS NOT NULL), '|') AS issues FROM (SELECT event_id, event_id AS k FROM events)""")
def formula_checks(t: Tables) -> DataFrame:
    k = F.col("event_id")
    latex = F.concat(F.lit("x_{1}"), F.when(k % 3 != 0, "{").otherwise(""), F.when(k % 4 == 1, r"\left( ").otherwise(""), F.when(k % 5 == 2, " y" * 11).otherwise(" y y"))
    return t.events.select("event_id", F.array_join(routing.formula_issues(latex), "|").alias("issues"))


@query("VAL-06", """SELECT region, step, passed, status, round(score, 4) AS score FROM (SELECT region, step, method,
  CASE method WHEN 'error' THEN false WHEN 'click' THEN true ELSE s > 50 END AS passed, CASE method WHEN 'error' THEN 'needs_review' WHEN 'click' THEN 'unchecked' ELSE CASE WHEN s > 50 THEN 'passed' ELSE 'needs_review' END END AS status,
  CASE method WHEN 'error' THEN 0.0 WHEN 'click' THEN 1.0 ELSE CASE WHEN s > 50 THEN 1.0 ELSE 0.55 END END AS score FROM (SELECT region, step, method, score AS s FROM attempts))""", "attempts")
def verdicts(t: Tables) -> DataFrame:
    kind = F.when(F.col("method") == "click", "image").otherwise("table")
    error = F.when(F.col("method") == "error", "timeout")
    issues = F.when(F.col("score") > 50, F.array().cast("array<string>")).otherwise(F.array(F.lit("degenerate table (1x1)")))
    v = routing.verdict(kind, F.lit("vlm"), F.lit("some text"), error, issues, F.lit(None).cast("double"))
    return t.attempts.select("region", "step", v["passed"].alias("passed"), v["status"].alias("status"), F.round(v["score"], 4).alias("score"))


@query("VAL-07", "SELECT conv_id, turn, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS agreement FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-z]', '', 'g') || 'x' AS a, regexp_replace(replace(text, ' th', ' '), '[^a-z]', '', 'g') || 'x' AS b FROM conversations)")
def agreements(t: Tables) -> DataFrame:
    plain = lambda c: F.concat(F.regexp_replace(c, "[^a-z ]", ""), F.lit("x"))
    return t.conversations.select("conv_id", "turn", F.round(routing.agreement(plain(F.col("text")), plain(F.replace("text", F.lit(" th"), F.lit(" ")))), 6).alias("agreement"))
