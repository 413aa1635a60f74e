import math

import pytest
from pyspark.sql import functions as F

from papyrine.__main__ import main
from papyrine.engine import Engine, Systems
from papyrine.operators import corpus, execute, handlers
from papyrine.session import scratch
from papyrine.sources import writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spans_of_ruled_tables(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 10.0), (1, 0.04, 10.0, 20.0, 30.0), (1, 20.0, 10.0, 50.0, 20.0), (1, 20.3, 20.0, 50.0, 30.0), (2, 5.0, 5.0, 5.0, 5.0)], "t int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.t, r.x0, r.y0): (r.colspan, r.rowspan) for r in handlers.ruled_table(cells, ["t"]).collect()}
    assert got == {(1, 0.0, 0.0): (3, 1), (1, 0.04, 10.0): (1, 2), (1, 20.0, 10.0): (2, 1), (1, 20.3, 20.0): (2, 1), (2, 5.0, 5.0): (1, 1)}
    assert handlers.ruled_table(cells.where("false"), ["t"]).count() == 0


def test_matrix_turns_points_into_the_image(spark):
    w, h = 600.0, 800.0
    for angle, (cw, ch) in {0: (w, h), 90: (h, w), 180: (w, h), 270: (h, w)}.items():
        a, b, c, d, e, f = one(spark, handlers.pixel_matrix(F.lit(angle), F.lit(w), F.lit(h), F.lit(144)))
        corners = [(a * x + c * y + e, b * x + d * y + f) for x in (0, w) for y in (0, h)]
        assert {(min(p[i] for p in corners), max(p[i] for p in corners)) for i in (0,)} == {(0.0, 2 * cw)} and max(p[1] for p in corners) == 2 * ch and min(p[1] for p in corners) == 0.0


def test_robots_tries(spark):
    rows = [("a", 0, 503), ("a", 1, None), ("a", 2, 200), ("b", 0, 404), ("c", 0, 500), ("c", 1, 502), ("c", 2, None), ("c", 3, 200), ("d", 0, 200)]
    got = {r.origin: (r.rule, r.tries, r.waited) for r in handlers.robots_found(spark.createDataFrame(rows, "origin string, attempt int, status int")).collect()}
    assert got == {"a": ("rules", 3, 8), "b": ("allow all", 1, 0), "c": ("deny all", 3, 18), "d": ("rules", 1, 0)}


@pytest.mark.parametrize(
    ("answers", "want"),
    [([200], ("ok", 0, 0)), ([400, 200], ("ok", 0, 0)), ([400, 400], ("error", 0, 0)), ([429, 503, 200], ("ok", 2, 6)), ([429, 503, None, 200], ("gave up", 2, 6)), ([None, 404], ("error", 1, 2)), ([500, 400, 502, 200], ("ok", 2, 6)), ([], (None, 0, 0))],
)
def test_retries(spark, answers, want):
    got = one(spark, handlers.retried(F.array(*map(F.lit, answers)).cast("array<int>")))
    assert tuple(got) == want


def test_readings_and_evidence(spark):
    lines = F.array(F.struct(F.lit("good line").alias("text"), F.lit(0.95).alias("score")), F.struct(F.lit("x").alias("text"), F.lit(0.5).alias("score")))
    r = one(spark, handlers.reading(lines))
    assert (r.text, r.trusted_text, r.line_scores) == ("good line\nx", "good line", [0.95, 0.5]) and math.isclose(r.confidence, (0.95 * 9 + 0.5) / 10)
    assert one(spark, handlers.reading(F.slice(lines, 1, 0))).confidence is None
    t = one(spark, handlers.table_evidence(F.lit("table"), F.lit(0.95), F.lit("a 1"), F.lit("<table>")))
    assert (t.confidence, t.trusted_text) == (0.95, "a 1")
    assert one(spark, handlers.table_evidence(F.lit("table"), F.lit(0.95), F.lit("a"), F.lit(""))).confidence == 0.0


def test_layout_fallbacks(spark):
    pages = spark.createDataFrame([(1, "digital", 10, 20), (2, "digital", 10, 20), (3, "scanned", 10, 20), (4, "scanned", 10, 20)], "page int, kind string, width int, height int")
    boxes = spark.createDataFrame([(1, "text", 0.0, 0.0, 1.0, 1.0, 0.123456, "p"), (2, "text", 0.0, 0.0, 1.0, 1.0, 0.7, "b"), (3, "text", 0.0, 0.0, 1.0, 1.0, 0.7, "b")], "page int, type string, x0 double, y0 double, x1 double, y1 double, score double, label string")
    found = boxes.where("page = 1").unionByName(boxes.where("page = 3").withColumn("type", F.lit(None).cast("string")))
    got = {(r.page, r.backend, r.score) for r in handlers.page_layouts(pages, found, boxes).collect()}
    assert got == {(1, "model", 0.1235), (2, "pdf-heuristic", 0.7), (4, "full-page", None)}  # the model saw nothing on page 3
    assert {(r.page, r.backend) for r in handlers.page_layouts(pages, None, boxes).collect()} == {(1, "pdf-heuristic"), (2, "pdf-heuristic"), (3, "full-page"), (4, "full-page")}


def test_report_goes_on(spark):
    path = scratch(spark, "report")
    rows = spark.range(5).withColumnRenamed("id", "doc")
    writers.resume_report(rows.where("doc < 2"), "doc", path)
    writers.resume_report(rows, "doc", path)
    assert sorted(r.doc for r in spark.read.parquet(path).collect()) == list(range(5))


def test_blocks(spark):
    rows = spark.createDataFrame([(1, 0, "h1", "A & B", None), (1, 1, "ul", None, ["x", "<y>"]), (1, 2, "ol", None, ["p", "q"]), (1, 3, "table", "<table><tr></tr></table>", None), (1, 4, "p", "say \"hi\"", None)], "doc int, place int, kind string, value string, items array<string>")
    r = handlers.written_blocks(rows, "doc", "place", F.lit("vi")).first()
    assert r.markdown == "# A & B\n\n- x\n- <y>\n\n1. p\n2. q\n\n<table><tr></tr></table>\n\nsay \"hi\""
    assert r.html.startswith('<!DOCTYPE html><html lang="vi">') and "<title>A &amp; B</title>" in r.html and "<li>&lt;y&gt;</li>" in r.html and 'border="1"' in r.html and "&quot;hi&quot;" in r.html


def test_caps_of_sources_that_have_none(spark):
    rows = spark.range(40).selectExpr("concat('c', id % 4) AS company", "concat('u', id) AS url", "'t' AS doc_type", "concat('s', id % 2) AS source")
    got = [r.source for r in corpus.select_documents(rows, 100, {"s0": 5}).collect()]
    assert got.count("s0") == 5 and got.count("s1") == 20
    assert corpus.select_documents(rows, 3, {}).count() == 12


def test_engine_on_files(spark, tmp_path):
    files = spark.createDataFrame([("in/a.txt", b"First words here.\n\n \n\nSecond words there."), ("in/b.exe", b"MZ"), ("in/c.txt", b""), ("in/d.txt", None)], "path string, content binary")
    made = Engine(spark).extract(files)
    got = {r.stem: (r.markdown, r.regions, r.error) for r in made.documents.collect()}
    assert got == {"a": ("First words here.\n\nSecond words there.\n", 2, None), "b": (None, 0, "unsupported"), "c": ("", 0, None), "d": (None, 0, "unsupported")}
    assert {r.method for r in made.regions.collect()} == {"pdf_text"} and Engine(spark).describe() == {"pdf_text": "read_text_layer"}
    made.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "markdown")).count() == 4 and spark.read.text(str(tmp_path / "out" / "routes")).count() == 2


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "set" / "dev" / "letters"
    folder.mkdir(parents=True)
    for name, text, truth in (("a", "Some words.", "Some words.\n"), ("b", "Other words.", "Quite different.\n")):
        (folder / f"{name}.txt").write_text(text)
        (folder / f"{name}.gt.md").write_text(truth)
    out = str(tmp_path / "report")
    assert main(["bench", str(tmp_path / "set"), out, "--system", "text_layer"]) == 0
    rows = {r.path: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"dev/letters/a.txt", "dev/letters/b.txt"} and rows["dev/letters/a.txt"].cer == 0 and rows["dev/letters/b.txt"].cer > 0.3 and rows["dev/letters/a.txt"].category == "letters"
    assert main(["rescore", out, str(tmp_path / "set")]) == 0 and main(["compare", out]) == 0
    assert "letters" in capsys.readouterr().out
    assert main(["extract", str(folder), str(tmp_path / "made")]) == 0 and spark.read.parquet(str(tmp_path / "made" / "markdown")).count() >= 2
    with pytest.raises(ValueError, match="no system"):
        Systems().run("none", spark.range(1), spark.range(1))


def test_engines_get_pieces_of_a_batch(spark):
    sizes = lambda batch: batch.assign(content=str(batch["text_layer"].str.len().sum()), confidence=None)[["region_id", "content", "confidence"]]
    tasks = spark.range(0, 60, 1, 1).select(F.col("id").cast("string").alias("region_id"), F.repeat(F.lit("x"), F.when(F.col("id") == 7, 3_000_000).otherwise(100_000)).alias("text_layer"))
    got = {r.region_id: r for r in execute.run_engine(tasks, sizes).collect()}
    assert len(got) == 60 and got["7"].content == "3000000" and got["7"].confidence is None
    assert all(int(r.content) <= 1 << 20 for k, r in got.items() if k != "7")
