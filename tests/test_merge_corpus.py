import hashlib

from pyspark.sql import functions as F

from papyrine.operators import benchmark, corpus, execute, merge
from papyrine.sources import readers
from papyrine.streaming import jobs

REGION = "doc string, page int, `order` int, id string, type string, status string, content string, n_cols int"


def regions(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], REGION)


def test_heading_levels(spark):
    rows = [("title", None, "Report", 24.0, 1), ("heading", None, "Chapter 1 Start", 15.0, 2), ("heading", None, "2.1.3 Deep", 12.0, 4), ("heading", None, "IV. Roman", 12.0, 2), ("heading", None, "Large", 15.0, 2), ("heading", None, "Small", 12.0, 3), ("heading", 5, "Given", 12.0, 5), ("heading", None, "No size", None, 2), ("text", None, "x", 10.0, None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, type string, level int, content string, font_size double, want int")
    assert all(r.level == r.want for r in merge.heading_levels(df).collect())


def test_continuations(spark):
    rows = regions(spark, (1, 1, "a", "text", "passed", "The results of the", 0), (1, 2, "f", "footer", "passed", "3", 0), (2, 1, "b", "text", "passed", "second quarter were good.", 0), (2, 2, "c", "text", "passed", "another one", 0), (2, 3, "t", "table", "passed", "", 3), (3, 1, "u", "table", "passed", "", 3), (3, 2, "v", "table", "passed", "", 3))
    chains = {r.id: r.chain for r in merge.continuations(rows).collect()}
    assert chains == {"a": "a", "b": "a", "c": "c", "t": "t", "u": "t", "v": "v"}
    parts = spark.createDataFrame([(["a hyphen-", "ated word", "次の", "文"],)], "p array<string>")
    assert parts.select(merge.glued(F.col("p"))).first()[0] == "a hyphenated word 次の文"


def markdown(spark, kind, content, level=None, method="ocr", table=None, figure=None, figure_text=None):
    s = lambda x: F.lit(x).cast("string")
    return spark.range(1).select(merge.region_markdown(F.lit(kind), s(content), F.lit(level).cast("int"), F.lit(method), s(table), s(figure), s(figure_text))).first()[0]


def test_region_markdown(spark):
    assert markdown(spark, "heading", " two\n words ", 3) == "### two words" and markdown(spark, "title", "T") == "# T"
    assert markdown(spark, "list", "• a\n  b\n3. c\n\n- d") == "- a\n  - b\n3. c\n- d"
    assert markdown(spark, "formula", "x", method="vlm") == "$$\nx\n$$" and markdown(spark, "formula", "x") == "x" and markdown(spark, "code", "x") == "```\nx\n```" and markdown(spark, "caption", "x") == "*x*" and markdown(spark, "text", " ") == ""
    assert markdown(spark, "image", "A [box]. More.", method="vlm", figure="f.png", figure_text="in  side") == "![Image: A (box)](f.png)\n\n> **[Image · automatic description]** A [box]. More.\n>\n> Text in figure: in side"
    assert markdown(spark, "table", "x", table="| a |", figure="f.png") == "| a |\n\n![Original image](f.png)" and markdown(spark, "seal", "", figure="s.png", figure_text="t") == "![Seal](s.png)"


def test_splits_and_shards(spark):
    rows = spark.range(2000).select(F.concat(F.lit("company"), F.col("id").cast("string")).alias("c")).select("c", corpus.split_of(F.col("c")).alias("s"), corpus.in_shard(F.col("c"), 2, 5).alias("shard")).collect()
    for r in rows[:200]:
        b = int(hashlib.sha1(f"corpus:{r.c}".encode()).hexdigest(), 16) % 100
        assert r.s == ("train" if b < 70 else "dev" if b < 80 else "test") and r.shard == (int(hashlib.sha1(r.c.encode()).hexdigest(), 16) % 5 == 1)
    assert 0.6 < sum(r.s == "train" for r in rows) / 2000 < 0.8


def test_kept_pages(spark):
    df = spark.createDataFrame([("ab", 30, 20), ("cd", 3, 20), ("x", 0, 5)], "sha string, pages int, most int")
    kept = [r.k for r in df.select(corpus.kept_pages(F.col("sha"), F.col("pages"), F.col("most")).alias("k")).collect()]
    assert kept[0] == sorted(sorted(range(30), key=lambda i: hashlib.sha1(f"ab:{i}".encode()).hexdigest())[:20]) and kept[1] == [0, 1, 2] and kept[2] == []


def test_selection_takes_types_in_turn(spark):
    rows = [("c", f"u{i}", "a" if i < 8 else "b", "s") for i in range(10)] + [("d", "v", "a", "s")]
    got = corpus.select_documents(spark.createDataFrame(rows, "company string, url string, doc_type string, source string"), 4, {}).collect()
    assert sorted(r.doc_type for r in got if r.company == "c") == ["a", "a", "b", "b"] and len(got) == 5
    have = spark.createDataFrame([("c", 3)], "company string, n int")
    assert corpus.select_documents(spark.createDataFrame(rows, "company string, url string, doc_type string, source string"), 4, {"s": 1}, have).count() == 1


def allowed(spark, robots, *paths, reached=True):
    lines = spark.createDataFrame([("https://a.b", i, v) for i, v in enumerate((robots or "").split("\n"))], "origin string, line_no int, value string")
    urls = spark.createDataFrame([(f"https://a.b{p}",) for p in paths], "url string")
    got = corpus.robots_allowed(urls, corpus.robots_rules(lines, "ours"), spark.createDataFrame([("https://a.b", reached)], "origin string, reached boolean"))
    by = {r.url: r.allowed for r in got.collect()}
    return [by[f"https://a.b{p}"] for p in paths]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: ours\nUser-agent: other\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.zip$\nDisallow:\nCrawl-delay: 3"
    assert allowed(spark, text, "/x", "/private/a", "/private/open/b", "/f.zip", "/f.zip?q=1", "", "/robots.txt") == [True, False, True, False, True, True, True]
    assert allowed(spark, "User-agent: *\nDisallow: /", "/x", "/robots.txt") == [False, True] and allowed(spark, "", "/x") == [True] and allowed(spark, "", "/x", reached=False) == [False]


def test_links():
    page = """<a href="/a.html" title="T">One <b>two</b></a><a href="#x">no</a><a href="mailto:a@b">m</a><a href="/a.html#y">again</a><div data-file="/f/r.pdf?x=1"></div><script>var u = "https:\\/\\/h.jp\\/s.pdf";</script>"""
    assert corpus.links_of("https://h.jp/d/", page) == [("https://h.jp/a.html", "T One two"), ("https://h.jp/f/r.pdf?x=1", ""), ("https://h.jp/s.pdf", "")]


def test_types_seeds_and_companies(spark):
    df = spark.createDataFrame([("Báo%20cáo%20tài%20chính%202024.pdf",), ("Annual Report",), ("x",), ("100% bad %zz",)], "t string")
    assert [r[0] for r in df.select(corpus.doc_type(F.col("t"), "VN")).collect()] == ["financial_statement", "annual_report", "other", "other"]
    lines = spark.createDataFrame([(0, 0, "# c"), (0, 1, "a\tbank\thttps://www.x.vn"), (0, 2, ""), (1, 0, "b\tbank\thttp://x.vn/ir\tok"), (1, 1, "c\tshop\thttp://y.vn\tok")], "file_no int, line_no int, value string")
    assert sorted((r.id, r.check) for r in corpus.seeds(lines).collect()) == [("a", ""), ("c", "ok")]
    rows = spark.createDataFrame([("A", "https://a.com", "i"), ("A", "https://long.a.vn/x", "i"), ("B", "https://facebook.com/b", "i"), ("C", "https://uni.edu.vn", "i"), ("D", "https://long.a.vn/y", "i"), ("E", "https://known.vn", "i")], "company string, site string, industry string")
    known = spark.createDataFrame([("known.vn",)], "host string")
    assert [(r.company, r.site) for r in corpus.company_sites(rows, known, ".vn").collect()] == [("A", "https://long.a.vn/x")]


def test_gate(spark):
    def passed(*rows):
        return corpus.gate(spark.createDataFrame(list(rows), "set string, real boolean, system string, cer double, lines int")).first()

    good = [("r", True, "model", 0.05, 200), ("r", True, "baseline", 0.15, 200)]
    assert passed(*good).passed and not passed(*good, ("q", True, "baseline", 0.1, 200)).passed
    assert passed(*good, ("s", False, "model", 0.9, 200), ("s", False, "baseline", 0.1, 200)).decided == 1
    assert not passed(("r", True, "model", 0.05, 50), ("r", True, "baseline", 0.15, 50)).passed


def test_balanced_draws(spark):
    pages = spark.createDataFrame([("ja", f"j{i}", p) for i in range(160) for p in range(3)] + [("en", f"e{i}", p) for i in range(24) for p in range(3)] + [("vi", f"v{i}", p) for i in range(10) for p in range(3)], "lang string, path string, page int")
    by = {r.lang: r["count"] for r in corpus.balanced_draws(pages, 3000).groupBy("lang").count().collect()}
    assert all(abs(n / sum(by.values()) - 1 / 3) < 0.04 for n in by.values())


def test_dataset_and_summary(spark):
    files = spark.createDataFrame([("dev/vi/scan/a.pdf", None), ("dev/vi/scan/a.gt.md", "truth"), ("b.pdf", None), ("b.gt.md", "t"), ("c.pdf", None)], "path string, text string")
    assert sorted((r.path, r.split, r.category) for r in benchmark.dataset(files).collect()) == [("b.pdf", None, "-"), ("dev/vi/scan/a.pdf", "dev", "vi/scan")]
    rows = spark.createDataFrame([("a", 2, None, 0.1), ("a", 1, "x", None), ("b", 1, None, 0.3)], "category string, pages int, error string, cer double")
    assert {r.category: (r.documents, r.pages, r.failed, r.cer) for r in benchmark.summary(rows).collect()} == {"a": (2, 3, 1, 0.1), "b": (1, 1, 0, 0.3), None: (3, 4, 1, 0.2)}
    both = spark.createDataFrame([("x", "a", 0.1), ("y", "a", 0.1), ("x", "b", None), ("y", "b", 0.2)], "system string, category string, cer double")
    assert sorted((r.system, r.category, r.cer_text) for r in benchmark.compared(both, ("cer",)).collect()) == [("x", "a", "**0.1000**"), ("x", "b", "-"), ("y", "a", "**0.1000**"), ("y", "b", "**0.2000**")]


def test_rounds_escalate_and_isolate_failures(spark):
    import pandas as pd

    def reads(batch):
        return pd.DataFrame({"region_id": batch["region_id"], "content": batch["text_layer"].where(batch["text_layer"] != "", "read"), "confidence": 0.95})

    def fails(batch):
        raise RuntimeError("no model")

    rows = spark.createDataFrame([("r1", "text", "digital", 0.3, "good text", 0, False), ("r2", "text", "digital", 0.3, "(cid:12)(cid:13)(cid:14)", 0, False), ("r3", "formula", "scanned", 0.1, "", 0, False), ("r4", "image", "scanned", 0.0001, "", 0, False), ("r5", "chart", "scanned", 0.2, "", 0, False)], "region_id string, type string, page_kind string, area_ratio double, text_layer string, cells int, full_page boolean")
    final, attempts = execute.rounds(rows, {"pdf_text": reads, "ocr": reads, "formula_recognition": fails})
    got = {r.region_id: r for r in final.collect()}
    assert (got["r1"].method, got["r1"].status, len(got["r1"].attempts)) == ("pdf_text", "passed", 1)
    assert got["r2"].status == "needs_review" and [a.method for a in got["r2"].attempts] == ["pdf_text", "ocr"]
    assert (got["r3"].method, got["r3"].status) == ("ocr", "needs_review") and got["r3"].attempts[0].issues == ["formula_recognition failed: RuntimeError: no model"]
    assert got["r4"].status == "skipped" and got["r5"].status == "unchecked" and got["r5"].attempts is None
    assert attempts.count() == 5 and execute.route_log(final).count() == 5


def test_cache(spark):
    tasks = spark.createDataFrame([("k1",), ("k2",)], "key string")
    cache = spark.createDataFrame([("k1", "v")], "key string, value string")
    hit, miss = execute.cached(tasks, cache)
    assert [r.value for r in hit.collect()] == ["v"] and [r.key for r in miss.collect()] == ["k2"]
    assert sorted(tuple(r) for r in execute.merged_cache(cache, spark.createDataFrame([("k1", "w"), ("k3", "x")], "key string, value string")).collect()) == [("k1", "w"), ("k3", "x")]


def test_docx(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    numbered = '<w:numPr/>'
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=\"2\"/>')}</w:tr><w:tr>{cell('b', '<w:vMerge w:val=\"restart\"/>')}{cell('c')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('d')}</w:tr></w:tbl>"
    body = f"<w:document {w}><w:body>{p('Head', '<w:pStyle w:val=\"Heading1\"/>')}{p('one', numbered)}{p('two', numbered)}{table}{p('end')}</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "z.skip").write_bytes(b"")
    (tmp_path / "t.csv").write_text("a,b")
    files = readers.files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.format for r in files.collect()} == {"x.docx": "docx", "y.pdf": "pdf", "t.csv": "office:pdf"}
    blocks = readers.docx(files.where("format = 'docx'").select("path", "content"))
    rows = blocks.orderBy("place").collect()
    assert [(r.type, r.text) for r in rows if r.type != "table"] == [("heading", "Head"), ("list", "one"), ("list", "two"), ("text", "end")]
    grid = next(r.rows for r in rows if r.type == "table")
    assert [[(c.text, c.rowspan, c.colspan) for c in row] for row in grid] == [[("a", 1, 2)], [("b", 2, 1), ("c", 1, 1)], [("d", 1, 1)]]
    assert [r.text for r in readers.merged_lists(blocks.where("type <> 'table'"), "path").orderBy("place").collect()] == ["Head", "one\ntwo", "end"]


def test_lines_and_logs(spark, tmp_path):
    lines = spark.createDataFrame([("a.png\tText  x",), ("no tab",), ("\ty",), ("b.png\t ",)], "value string")
    assert [tuple(r) for r in readers.labelled_lines(lines).collect()] == [("a.png", "Text x")]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    log = spark.createDataFrame([("l", i, f"epoch: [1], global_step: {i}, avg_reader_cost: 0.1 s, avg_batch_cost: 2.0 s, ips: {v} samples/s") for i, v in enumerate([1, 1, 1, 4, 6, 8])] + [("l", 9, "other")], "log string, line_no int, value string")
    assert corpus.speed_log(log).first().ips == 6.0
    blocks = spark.createDataFrame([("d", 0, "p", "x" * 10), ("d", 1, "p", "y" * 10), ("d", 2, "h2", "References"), ("d", 3, "p", "z")], "doc string, place int, tag string, text string")
    assert readers.article_blocks(blocks, "doc", 100).count() == 2 and readers.article_blocks(blocks, "doc", 5).count() == 1


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, body in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (source / name).write_text(body)
    query = jobs.run_jobs(jobs.new_documents(jobs.inbox(spark, str(source))), lambda b: b.select("sha256"), str(out), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(out / "results")).count() == 2 and {r.state for r in spark.read.json(str(out / "jobs")).collect()} == {"done"}
    bad = jobs.run_jobs(jobs.inbox(spark, str(source)), lambda b: b.select("nothing"), str(tmp_path / "bad"), str(tmp_path / "check2"))
    bad.awaitTermination(120)
    assert {r.state for r in spark.read.json(str(tmp_path / "bad" / "jobs")).collect()} == {"failed"}


def test_settings_and_engines(tmp_path):
    import json

    import pytest

    from papyrine.settings import Engines, Settings

    (tmp_path / "s.json").write_text(json.dumps({"output_locale": "vi", "languages": ["vi"]}))
    made = Settings.load(str(tmp_path / "s.json"), {"PAPYRINE_DESCRIBE_IMAGES": "false", "PAPYRINE_OUTPUT_LOCALE": "en"}, table_format="html")
    assert (made.output_locale, made.languages, made.describe_images, made.table_format) == ("vi", ("vi",), False, "html")
    with pytest.raises(ValueError):
        Settings(languages=("ja",))
    assert Engines().register("ocr", len).available == ("ocr",) and Engines().register("ocr", len).describe() == {"ocr": "len"}


def test_command_line(capsys):
    from papyrine.__main__ import main

    assert main(["list"]) == 0 and "TXT-01" in capsys.readouterr().out
    assert main(["sql", "JN-06"]) == 0 and main(["sql", "JN-03"]) == 1
