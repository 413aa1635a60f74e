"""Candidate drawings, evidence, prompts, trusted pages, and texts that start with a digit of their own place."""

from pyspark.sql import functions as F

from papyrine.operators import benchmark, corpus, layout, merge, routing
from papyrine.sources import writers
from papyrine.streaming import jobs

ITEM = "page int, idx int, kind string, x0 double, y0 double, x1 double, y1 double, chars int"


def test_drawings(spark):
    rows = [
        (1, 0, "candidate", 0.0, 0.0, 100.0, 100.0, None),
        (1, 1, "drawing", 10.0, 10.0, 90.0, 90.0, None),  # inside a candidate
        (1, 2, "drawing", 200.0, 0.0, 400.0, 200.0, None),  # taken
        (1, 3, "drawing", 210.0, 10.0, 390.0, 190.0, None),  # inside the one before
        (1, 4, "drawing", 0.0, 300.0, 39.0, 900.0, None),  # too narrow
        (1, 5, "drawing", 500.0, 500.0, 700.0, 700.0, None),  # a box of text
        (1, 6, "line", 510.0, 510.0, 690.0, 520.0, 401),
        (2, 0, "drawing", 500.0, 500.0, 700.0, 700.0, None),  # taken, the text is on another page
        (2, 1, "drawing", 0.0, 0.0, 50.0, 50.0, None),  # too small
    ]
    found = layout.figure_drawings(spark.createDataFrame(rows, ITEM), ["page"], 500000.0)
    assert sorted((r.page, r.idx) for r in found.collect()) == [(1, 2), (2, 0)]
    assert layout.figure_drawings(spark.createDataFrame([], ITEM), ["page"], 500000.0).count() == 0


def test_drawings_against_brute_force(spark):
    import random

    r = random.Random(4)
    rows = []
    for page in range(20):
        for idx in range(12):
            x, y = r.uniform(0, 500), r.uniform(0, 500)
            rows.append((page, idx, r.choice(["candidate", "drawing", "drawing", "line"]), x, y, x + r.uniform(20, 300), y + r.uniform(20, 300), r.choice([None, 100, 300])))

    def area(b):
        return (b[5] - b[3]) * (b[6] - b[4])

    def cut(a, b):
        return max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))

    want = []
    for page in range(20):
        here = [b for b in rows if b[0] == page]
        used = [b for b in here if b[2] == "candidate"]
        for b in here:
            inside = sum(c[7] or 0 for c in here if c[2] == "line" and b[3] <= (c[3] + c[5]) / 2 <= b[5] and b[4] <= (c[4] + c[6]) / 2 <= b[6])
            if b[2] == "drawing" and area(b) >= 10000 and min(b[5] - b[3], b[6] - b[4]) >= 40 and all(cut(b, c) <= 0.5 * area(b) and cut(b, c) <= 0.5 * area(c) for c in used) and inside <= 400:
                used.append(b)
                want.append((page, b[1]))
    found = layout.figure_drawings(spark.createDataFrame(rows, ITEM).repartition(5), ["page"], 500000.0)
    assert sorted((x.page, x.idx) for x in found.collect()) == want and 20 < len(want) < len(rows)


def test_images(spark):
    box = "page int, x0 double, y0 double, x1 double, y1 double"
    images = [(1, 0.0, 0.0, 100.0, 100.0), (1, 0.0, 0.0, 10.0, 10.0), (1, 0.0, 0.0, 1000.0, 1000.0), (1, 300.0, 300.0, 400.0, 400.0), (2, 300.0, 300.0, 400.0, 400.0)]
    tables = spark.createDataFrame([(1, 290.0, 290.0, 380.0, 500.0)], box)
    found = layout.figure_images(spark.createDataFrame(images, box), tables, ["page"], 500000.0)
    assert sorted((r.page, r.x0) for r in found.collect()) == [(1, 0.0), (2, 300.0)]


def test_evidence(spark):
    rows = spark.createDataFrame([("layer", "ocr"), (" \n", "ocr"), (None, None)], "a string, b string")
    assert [tuple(r.e) for r in rows.select(routing.evidence(F.col("a"), F.col("b")).alias("e")).collect()] == [("layer", True), ("ocr", False), ("", False)]


def test_prompt(spark):
    rows = spark.createDataFrame([("image", "x" * 5000), ("table", None), ("table", "12")], "task string, hint string")
    made = routing.prompt(F.col("task"), F.col("hint"), F.lit("Say it in English."), {"image": "Describe. {language}", "table": "Copy."}, " Printed: {hint}", " Text: {hint}")
    assert [r[0] for r in rows.select(made).collect()] == ["Describe. Say it in English. Printed: " + "x" * 4000, "Copy.", "Copy. Text: 12"]


def test_trusted_pages(spark):
    pages = spark.createDataFrame([(1, "digital", False), (2, "digital", True), (3, "scanned", False), (4, "digital", False)], "page int, kind string, legacy_fonts boolean")
    blocks = spark.createDataFrame([(1, "A clean block of plain words."), (4, "�" * 30), (1, "�")], "page int, text string")
    assert [r.page for r in corpus.trusted_pages(pages, blocks, ["page"]).collect()] == [1]


def test_digits_at_the_ends_stay(spark):
    parts = spark.createDataFrame([([" 0 men and", "10 women 1", "12 more "],)], "p array<string>")
    assert parts.select(merge.glued(F.col("p"))).first()[0] == "0 men and 10 women 1 12 more"
    lines = spark.createDataFrame([(0, 1, " s10 \t s1 \thttps://x2.example/2")], "file_no int, line_no int, value string")
    assert tuple(corpus.seeds(lines).first()) == ("s10", "s1", "https://x2.example/2", "")


def test_printed(spark):
    rows = spark.createDataFrame([(0.5,), (None,)], "x double")
    assert [r[0] for r in rows.select(benchmark.printed(F.col("x"))).collect()] == ["0.5", "-"]


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# A", 1), ("b", None, 2)], "stem string, markdown string, pages int")
    for _ in range(2):  # written again, not twice
        writers.write_outputs(docs, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/markdown")).collect()} == {("a", "# A"), ("b", None)}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/json")).collect()) == ['{"stem":"a","pages":1}', '{"stem":"b","pages":2}']
    items = spark.createDataFrame([("u1", "dev", "x"), ("u2", "test", "y")], "url string, split string, category string")
    writers.write_manifest(items, str(tmp_path / "manifest"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "manifest")).select("url", "split", "category").collect()} == {("u1", "dev", "x"), ("u2", "test", "y")}
    log = docs.select("stem").withColumnRenamed("stem", "value")
    for _ in range(2):
        writers.append_route_log(log, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def test_stream_log_is_written_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1, "x")], "id int, v string").write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        rows = spark.readStream.schema("id int, v string").parquet(source)
        jobs.append_log(rows, out, state).awaitTermination(60)
    assert [tuple(r) for r in spark.read.json(out).select("id", "v").collect()] == [(1, "x")]
