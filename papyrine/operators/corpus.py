"""Corpus building: seeds, links, robots rules, document types, splits, selection, page picks, statistics, gates."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx

# --- fixed values: document types by country, first match wins; words of links; hosts that are no companies --------------
DOC_TYPES = {
    "VN": [
        ("financial_statement", r"b[aá]o.?c[aá]o.?t[aà]i.?ch[ií]nh|bctc|financial.?statement|fs[_-]?20"),
        ("annual_report", r"th[uư][oờ]ng.?ni[eê]n|bctn|annual.?report"),
        ("resolution", r"ngh[iị].?quy[eế]t|resolution"),
        ("minutes", r"bi[eê]n.?b[aả]n|minutes"),
        ("shareholder_meeting", r"[dđ][aạ]i.?h[oộ]i|agm|egm|t[oờ].?tr[iì]nh|tai.?lieu.?hop"),
        ("governance_report", r"qu[aả]n.?tr[iị]|governance"),
        ("charter_regulation", r"[dđ]i[eề]u.?l[eệ]|quy.?ch[eế]|charter|regulation"),
        ("explanation_letter", r"gi[aả]i.?tr[iì]nh|c[oô]ng.?v[aă]n|explanation"),
        ("announcement", r"th[oô]ng.?b[aá]o|c[oô]ng.?b[oố]|announcement|notice"),
    ],
    "JP": [
        ("earnings_summary", r"決算短信|tanshin|financial.?results|earnings"),
        ("securities_report", r"有価証券報告書|四半期報告書|半期報告書|securities.?report|yuho"),
        ("annual_report", r"統合報告|アニュアル|annual.?report|integrated.?report"),
        ("results_presentation", r"決算説明|説明資料|説明会|プレゼン|presentation"),
        ("agm_notice", r"招集|株主総会|notice.?of.*meeting|convocation|agm"),
        ("governance_report", r"ガバナンス|governance"),
        ("forecast_revision", r"業績予想|予想の修正|forecast"),
        ("dividend", r"配当|dividend"),
        ("buyback", r"自己株式|treasury|buyback|repurchase"),
        ("sustainability_report", r"サステナビリティ|esg|sustainability|csr"),
        ("fact_book", r"ファクトブック|fact.?book|データブック|data.?book"),
    ],
}
LINK_WORDS = {
    "VN": ("quan-he-co-dong", "quan-he-nha-dau-tu", "nha-dau-tu", "co-dong", "investor", "shareholder", "/ir", "bao-cao", "tai-chinh", "thuong-nien", "cong-bo-thong-tin", "cbtt", "dai-hoi", "nghi-quyet", "financial", "annual", "report", "disclosure", "governance", "quan-tri", "tai-lieu", "document"),
    "JP": ("/ir", "ir-", "-ir", "ir情報", "investor", "shareholder", "株主", "投資家", "決算", "有価証券", "ガバナンス", "ライブラリ", "library", "financial", "results", "report", "disclosure", "適時開示", "統合報告", "integrated", "presentation", "説明会", "governance", "kabunushi"),
}
STRONG_WORDS = {
    "VN": ("nha-dau-tu", "co-dong", "investor", "shareholder", "bao-cao", "tai-chinh", "thuong-nien", "cong-bo", "dai-hoi", "nghi-quyet", "financial", "annual", "disclosure", "report"),
    "JP": ("investor", "/ir", "ir情報", "株主", "投資家", "決算", "有価証券", "ライブラリ", "library", "financial", "results", "適時開示", "統合報告", "report"),
}
PUBLIC_DOMAINS = r"(^|\.)(edu|gov|ac|go|ed|lg|mil|int)\.[a-z]{2}$|\.(edu|gov|mil|int)$"
SOCIAL_HOSTS = ("facebook.com", "fb.com", "google.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "instagram.com", "tiktok.com", "wordpress.com", "blogspot.com", "wixsite.com", "wikipedia.org")
PDF_LINK = re.compile(r"""(?:https?://|/)[^\s"'<>()\\]{1,300}?\.pdf(?![a-z0-9])(?:\?[^\s"'<>()\\]{0,200})?""", re.I)
FILE_ATTRIBUTES = ("src", "data", "data-href", "data-url", "data-src", "data-file", "data-link", "onclick", "value")
# --- end of fixed values ----------------------------------------------------------------------------------------------------


def doc_type(text: Column, country: str) -> Column:
    """TXT-22 on NFC text."""
    text = F.lower(F.coalesce(F.try_url_decode(text), text))
    out = F.lit("other")
    for name, pattern in reversed(DOC_TYPES[country]):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def split_of(company: Column) -> Column:
    """FLT-16: 70 % train, 10 % dev, 20 % test by hash."""
    bucket = tx.hex_modulo(F.sha1(F.concat(F.lit("corpus:"), company)), 100)
    return F.when(bucket < 70, "train").when(bucket < 80, "dev").otherwise("test")


def in_shard(key: Column, k: int, n: int) -> Column:
    """FLT-15: whether the key belongs to shard k (from 1) of n."""
    return tx.hex_modulo(F.sha1(key), n) == k - 1


def relevance(text: Column, country: str) -> Column:
    """FLT-12 on folded text: struct of `follow` (any word) and `score` (strong words)."""
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w)))
    return F.struct((hits(LINK_WORDS[country]) > 0).alias("follow"), hits(STRONG_WORDS[country]).alias("score"))


def same_site(host: Column, bases: Column) -> Column:
    """FLT-13."""
    return F.exists(bases, lambda b: (host == b) | host.endswith(F.concat(F.lit("."), b)))


def seeds(lines: DataFrame) -> DataFrame:
    """SRC-11: (file_no, line_no, value) to seeds; the first line of a website counts, over all files."""
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("p", F.transform(F.split("value", "\t"), lambda x: F.trim(x)))
    rows = rows.select("file_no", "line_no", F.col("p")[0].alias("id"), F.col("p")[1].alias("sector"), F.col("p")[2].alias("website"), F.coalesce(F.get("p", F.lit(3)), F.lit("")).alias("check"))
    rows = rows.withColumn("host", tx.domain(F.col("website")))
    first = F.row_number().over(W.partitionBy("host").orderBy("file_no", "line_no"))
    return rows.withColumn("rn", first).where("rn = 1").drop("rn", "host", "file_no", "line_no")


def company_sites(rows: DataFrame, known: DataFrame, tld: str) -> DataFrame:
    """SRC-19: (company, site, industry) to one site for each company and one company for each host; known: hosts to leave out."""
    rows = rows.where(F.col("site").startswith("http")).withColumn("host", tx.domain(F.col("site")))
    social = F.col("host").rlike("(^|\\.)(" + "|".join(re.escape(h) for h in SOCIAL_HOSTS) + ")$")
    rows = rows.where((F.col("host") != "") & ~F.col("host").rlike(PUBLIC_DOMAINS) & ~social).join(known, "host", "left_anti")
    best = rows.groupBy("company").agg(F.min(F.struct((~F.col("host").endswith(tld)).alias("foreign"), F.length("site").alias("n"), "site", "industry", "host")).alias("x"))
    one = best.select("company", "x.site", "x.industry", "x.host")
    return one.groupBy("host").agg(F.min(F.struct("company", "site", "industry")).alias("x")).select("x.*")


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.anchors: list[tuple[str, list[str]]] = []
        self.files: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and given.get("href"):
            self.anchors.append((given["href"], [given.get("title", "")]))
            self.inside = True
        for name in FILE_ATTRIBUTES:
            self.files += PDF_LINK.findall(given.get(name, ""))

    def handle_endtag(self, tag):
        self.inside &= tag != "a"

    def handle_data(self, data):
        if self.inside:
            self.anchors[-1][1].append(data)


def links_of(base: str, page: str) -> list[tuple[str, str]]:
    """SRC-16 for one page."""
    reader = _Anchors()
    reader.feed(page)
    raw = [(h, " ".join(t)) for h, t in reader.anchors] + [(f, "") for f in [*reader.files, *PDF_LINK.findall(page.replace("\\/", "/"))]]
    found: dict[str, str] = {}
    for href, text in raw:
        href = unescape(href.strip())
        if not re.match(r"mailto:|tel:|javascript:|#", href):
            link = urljoin(base, href).partition("#")[0]
            if link.startswith("http"):
                found.setdefault(link, " ".join(text.split())[:200])
    return list(found.items())


def page_links(pages: DataFrame) -> DataFrame:
    """SRC-16: (page_id, place, link, anchor) of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = links_of(url or "", html or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int32())), pa.array(range(len(found)), pa.int32()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["page_id", "place", "link", "anchor"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, place int, link string, anchor string")


def robots_rules(lines: DataFrame, agent: str) -> DataFrame:
    """SRC-18: rules (origin, allow, path, regex) that hold for the agent, from robots.txt lines (origin, line_no, value). A run of
    user-agent lines opens a group; groups that name the agent count, else those for everyone."""
    line = F.trim(F.regexp_extract("value", r"^[^#]*", 0))
    rows = lines.withColumn("key", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1)))).withColumn("val", F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)))
    rows = rows.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = W.partitionBy("origin").orderBy("line_no")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("g", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("g > 0")
    agents = rows.where("key = 'user-agent'").groupBy("origin", "g").agg(F.bool_or(F.lower("val") == agent).alias("own"), F.bool_or(F.col("val") == "*").alias("all"))
    agents = agents.withColumn("named", F.max("own").over(W.partitionBy("origin"))).where(F.when(F.col("named"), F.col("own")).otherwise(F.col("all")))
    rules = rows.where("key in ('allow', 'disallow') and val <> ''").join(agents.select("origin", "g"), ["origin", "g"])
    body = F.regexp_replace(F.regexp_replace("val", r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(F.col("val").endswith("$"), "$").otherwise(""))
    return rules.select("origin", (F.col("key") == "allow").alias("allow"), F.col("val").alias("path"), regex.alias("regex"))


def robots_allowed(urls: DataFrame, rules: DataFrame, origins: DataFrame) -> DataFrame:
    """JN-19: urls (url) with `allowed`: by the longest matching rule of the origin, allow on ties; origins (origin, reached):
    those that can't be reached allow nothing. The origin is an equi key, so rules meet only their own URLs."""
    rows = urls.withColumn("origin", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)).withColumn("target", F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1))
    rows = rows.withColumn("target", F.when(F.col("target") == "", "/").when(F.col("target").startswith("?"), F.concat(F.lit("/"), F.col("target"))).otherwise(F.col("target")))
    rules = rules.withColumnRenamed("origin", "of")
    hit = rows.join(rules, (F.col("origin") == F.col("of")) & F.expr("target rlike regex"), "left").groupBy("url", "origin", "target").agg(F.max(F.struct(F.length("path").alias("n"), "allow")).alias("best"))
    return hit.join(origins, "origin", "left").select("url", F.when(~F.coalesce("reached", F.lit(True)), False).when(F.col("target") == "/robots.txt", True).otherwise(F.coalesce("best.allow", F.lit(True))).alias("allowed"))


def select_documents(candidates: DataFrame, per_company: int, per_source: dict[str, int], have: DataFrame | None = None) -> DataFrame:
    """WN-07: of each company up to its quota, in turn from its document types, by hash of the URL; then each source's cap by hash.
    candidates: company, url, doc_type, source; have: company, n already stored."""
    turn = F.row_number().over(W.partitionBy("company", "doc_type").orderBy(F.sha1("url"), "url"))
    rows = candidates.withColumn("turn", turn).withColumn("pick", F.row_number().over(W.partitionBy("company").orderBy("turn", "doc_type")))
    if have is not None:
        rows = rows.join(have.select("company", "n"), "company", "left")
    else:
        rows = rows.withColumn("n", F.lit(0))
    rows = rows.where(F.col("pick") <= per_company - F.coalesce("n", F.lit(0)))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.sha1(F.concat("company", "url")), "url"))
    rows = rows.drop("turn", "pick", "n")
    if not per_source:
        return rows
    cap = F.lit(None).cast("int")
    for source, n in per_source.items():
        cap = F.when(F.col("source") == source, n).otherwise(cap)
    # the constant bound lets tasks prune a source before it meets in one place; sources without a cap aren't ranked at all
    capped = rows.where(cap.isNotNull()).withColumn("place", place).where(F.col("place") <= max(per_source.values())).where(F.col("place") <= cap).drop("place")
    return capped.unionByName(rows.where(cap.isNull()))


def kept_pages(sha: Column, pages: Column, limit: Column) -> Column:
    """WN-08: the pages (from 0) that are stored of a document: those of the least hashes, in page order."""
    all_pages = F.sequence(F.lit(0), pages - 1)
    hashed = F.array_sort(F.transform(all_pages, lambda i: F.struct(F.sha1(F.concat_ws(":", sha, i.cast("string"))).alias("h"), i.alias("i"))))
    picked = F.array_sort(F.transform(F.slice(hashed, F.lit(1), limit), lambda x: x.i))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= limit, all_pages).otherwise(picked)


def dev_test(rows: DataFrame, group: str, key: str, share: float = 0.3) -> DataFrame:
    """WN-10: the least hashes of a group, a rounded share of it (half to even), are dev. A group meets in one place only as a table
    of its counts by the first 16 bits of the hash; rows are ranked within those."""
    named = rows.select("*", F.struct(F.col(group).alias("g"), F.substring(F.sha1(key), 1, 4).alias("bits")).alias("_place"))
    counts = named.groupBy(F.col("_place").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("_of.g")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_of.bits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_of", before.alias("_before"), F.bround(share * F.sum("_n").over(w), 0).alias("_dev"))
    own = F.row_number().over(W.partitionBy("_place").orderBy(F.sha1(key), key))
    ranked = named.withColumn("_own", own).join(counts, F.col("_place").eqNullSafe(F.col("_of")))
    return ranked.withColumn("split", F.when(F.col("_before") + F.col("_own") <= F.col("_dev"), "dev").otherwise("test")).drop("_place", "_own", "_of", "_before", "_dev")


def greedy_caps(rows: DataFrame, outer: str, inner: str, per_inner: int, per_outer: int, key: str) -> DataFrame:
    """WN-11: in the order of the key's hash, at most per_inner of each inner group, then per_outer of each outer one."""
    order = (F.sha1(key), F.col(key))
    first = rows.withColumn("a", F.row_number().over(W.partitionBy(outer, inner).orderBy(*order))).where(F.col("a") <= per_inner)
    return first.withColumn("b", F.row_number().over(W.partitionBy(outer).orderBy(*order))).where(F.col("b") <= per_outer).drop("a", "b")


def balanced_draws(pages: DataFrame, draws: int, seed: int = 3) -> DataFrame:
    """SL-09: page draws spread evenly over languages, then documents, then pages: the k-th draw of a language takes its documents
    in turn, and of a document its pages in turn, in hashed order. pages: lang, path, page."""
    h = lambda *c: F.sha1(F.concat_ws(":", *[F.col(x).cast("string") for x in c], F.lit(str(seed))))
    turn = F.row_number().over(W.partitionBy("lang", "path").orderBy(h("path", "page"), "page"))
    rows = pages.withColumn("turn", turn).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("turn", h("path"), "path")))
    of = pages.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    quota = -(-draws // max(1, of.count()))
    # a language's places beyond the quota are never drawn: tasks prune them before it meets in one place
    rows = rows.where(F.col("k") <= quota).join(of, "lang").withColumn("times", F.floor((quota - F.col("k")) / F.col("n")) + 1)
    return rows.select("lang", "path", "page", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("lang", "path", "page")


def corpus_statistics(manifest: DataFrame) -> DataFrame:
    """AG-09: documents and pages by (split, language, kind) and by country, with its companies, in one pass of grouping sets."""
    return manifest.groupingSets([["split", "language", "kind"], ["country"]], "split", "language", "kind", "country").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.countDistinct("company").alias("companies"))


def document_kind(pages: DataFrame, key: str) -> DataFrame:
    """AG-11: digital if at least 60 % (and one) of a document's pages are, scan if none."""
    made = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("digital").alias("d"))
    return made.select(key, F.when(F.col("d") >= F.greatest(F.lit(1.0), 0.6 * F.col("n")), "digital").when(F.col("d") == 0, "scan").otherwise("mixed").alias("kind"))


def visible_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """FLT-11: pages (chars, invisible) with enough text, of which under a fifth is invisible."""
    return pages.where((F.col("chars") >= F.greatest(F.lit(least), F.lit(1))) & (F.col("invisible") / F.greatest(F.col("chars"), F.lit(1)) < 0.2))


def trusted_pages(pages: DataFrame, blocks: DataFrame, keys: list[str], most: float = 0.02) -> DataFrame:
    """FLT-11: digital pages without legacy fonts and without a block of 20 characters or more that is garbled. pages: keys, kind,
    legacy_fonts; blocks: keys, text."""
    text = tx.strip(F.col("text"))
    bad = blocks.where((F.length(text) >= 20) & (tx.garbled_ratio(F.col("text")) > most)).select(*keys)
    return pages.where((F.col("kind") == "digital") & ~F.col("legacy_fonts")).join(bad, keys, "left_anti")


def gate(results: DataFrame, tolerance: float = 0.005, least_lines: int = 100) -> DataFrame:
    """FLT-14: results (set, real, system: model or baseline, cer, lines) to one row: passed, decided, failed. Real sets, where there
    are any, decide alone; a set without a model's score or with too few lines fails; no decision fails."""
    of = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    sets = results.groupBy("set").agg(F.bool_or("real").alias("real"), of("model", "cer").alias("model"), of("baseline", "cer").alias("base"), F.max("lines").alias("lines"))
    sets = sets.withColumn("any_real", F.max("real").over(W.partitionBy())).where(F.col("real") | ~F.col("any_real"))
    good = F.coalesce((F.col("model") <= F.col("base") + tolerance) & (F.col("lines") >= least_lines), F.lit(False))
    made = sets.agg(F.count(F.lit(1)).alias("decided"), F.count_if(~good).alias("failed"))
    return made.select(((F.col("decided") > 0) & (F.col("failed") == 0)).alias("passed"), "decided", "failed")


def average_tensors(rows: DataFrame) -> DataFrame:
    """AG-15: (file, key, values array<double>) to the element-wise means of each key, and the largest deviation from them."""
    flat = rows.select("key", F.posexplode("values").alias("i", "v"))
    means = flat.groupBy("key", "i").agg(F.avg("v").alias("m"), F.greatest(F.max("v") - F.avg("v"), F.avg("v") - F.min("v")).alias("d"))
    return means.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("mean"), F.max("d").alias("deviation"))


def frontier(pages: DataFrame, links: DataFrame, start: DataFrame, budget: int, depth: int = 3) -> DataFrame:
    """SL-04: best-first crawl over a stored link graph, level by level: of the links met, the most relevant (then the shallowest, then
    by URL) up to what is left of the budget. pages: url; links: url, link, score; start: url. Levels are few, and only a level's
    size comes to the driver."""
    seen = start.select("url", F.lit(0).alias("depth"))
    last, left = seen, budget - seen.count()
    for k in range(1, depth + 1):
        if left <= 0:
            break
        new = last.join(links, "url").groupBy("link").agg(F.max("score").alias("score")).withColumnRenamed("link", "url")
        new = new.join(pages.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti")
        last = new.orderBy(F.desc("score"), "url").limit(left).select("url", F.lit(k).alias("depth"))
        n = last.count()
        if not n:
            break
        left -= n
        seen = seen.unionByName(last)
    return seen


def speed_log(lines: DataFrame, skip: int = 3) -> DataFrame:
    """SRC-15, AG-16: training log lines (log, line_no, value) to the median throughput of each log after its warm-up lines."""
    x = lambda p: F.regexp_extract("value", p, 1)
    rows = lines.select("log", "line_no", x(r"global_step: (\d+)").alias("step"), x(r"avg_reader_cost: ([0-9.]+)").alias("reader"), x(r"avg_batch_cost: ([0-9.]+)").alias("batch"), x(r"ips: ([0-9.]+)").alias("ips")).where("ips <> ''")
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("log").orderBy("line_no"))).where(F.col("rn") > skip)
    return rows.groupBy("log").agg(F.median(F.col("ips").cast("double")).alias("ips"), F.count(F.lit(1)).alias("n"))


def remapped(new: DataFrame, old: DataFrame, fallback: DataFrame) -> DataFrame:
    """JN-20: new characters (ch) with the row of the same old character, else of its nearest fallback, else none; and how."""
    near = fallback.join(old.select(F.col("ch").alias("to"), F.col("row").alias("near_row")), "to").groupBy("ch").agg(F.min(F.struct("rank", "near_row")).alias("n"))
    made = new.join(old, "ch", "left").join(near, "ch", "left")
    return made.select("ch", F.coalesce("row", "n.near_row").alias("row"), F.when(F.col("row").isNotNull(), "same").when(F.col("n").isNotNull(), "fallback").otherwise("random").alias("how"))
