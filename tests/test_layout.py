from pyspark.sql import functions as F

from papyrine.functions.geometry import Box, inverse
from papyrine.operators import layout, lines

COLUMNS = "page int, idx int, type string, x0 double, y0 double, x1 double, y1 double, score double"


def test_reading_order(spark):
    rows = [(300, 100, 500, 200), (50, 100, 250, 200), (50, 20, 500, 60), (50, 220, 250, 300), (300, 220, 500, 300), (250, 780, 300, 790)]
    df = spark.createDataFrame([(p, i, "page_number" if i == 5 else "text", *map(float, r), 0.9) for p in (1, 2) for i, r in enumerate(rows)], COLUMNS)
    got = layout.reading_order(df, ["page"]).collect()
    for p in (1, 2):
        assert [r.idx for r in sorted((r for r in got if r.page == p), key=lambda r: r.order)] == [2, 1, 3, 0, 4, 5]
    assert {r.region_id for r in got} == {f"p{p}-r{k}" for p in (1, 2) for k in range(1, 7)}


def test_clean_up(spark):
    rows = [(1, 0, "table", 0, 0, 100, 100, 0.9), (1, 1, "text", 10, 10, 50, 50, 0.8), (1, 2, "text", 200, 0, 300, 50, 0.7), (1, 3, "text", 201, 0, 300, 50, 0.6), (1, 4, "caption", 10, 10, 50, 50.5, None)]
    df = spark.createDataFrame([(a, b, c, *map(float, x), s) for a, b, c, *x, s in rows], COLUMNS)
    kept = layout.without_contained(layout.without_near_duplicates(df, ["page"]), ["page"])
    assert sorted(r.idx for r in kept.collect()) == [0, 2, 4]
    assert layout.without_near_duplicates(df.where("false"), ["page"]).count() == 0


def test_suppression_is_greedy_not_transitive(spark):
    chain = [(1, i, "text", i * 8.0, 0.0, i * 8.0 + 100, 100.0, 0.9 - i / 10) for i in range(3)]  # 0~1, 1~2, not 0~2
    assert sorted(r.idx for r in layout.without_near_duplicates(spark.createDataFrame(chain, COLUMNS), ["page"]).collect()) == [0, 2]


def test_lines_and_orphans(spark):
    text = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 90.0, 0.0, 100.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0)], "page int, l_x0 double, l_y0 double, l_x1 double, l_y1 double")
    regions = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0)], "page int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert layout.lines_in(text, regions, ["page"]).count() == 1 and layout.orphans(text, regions, ["page"]).count() == 2


def test_labels_and_kinds(spark):
    df = spark.createDataFrame([("doc_title",), (" Paragraph-Title ",), ("chart",), ("nothing",)], "l string")
    assert [r[0] for r in df.select(layout.region_type(F.col("l"))).collect()] == ["title", "heading", "chart", "other"]
    pages = spark.createDataFrame([(10, 0.0, 0.0, False), (500, 0.05, 0.0, False), (500, 0.0, 0.9, False), (500, 0.0, 0.9, True)], "c int, g double, v double, t boolean")
    assert [r[0] for r in pages.select(layout.page_kind(F.col("c"), F.col("g"), F.col("v"), F.col("t"))).collect()] == ["scanned", "scanned", "scanned", "digital"]


def test_block_classes(spark):
    rows = [("12", 1, 10.0, 20.0, "page_number"), ("Running head", 1, 10.0, 20.0, "header"), ("Report", 1, 24.0, 100.0, "title"), ("Section one", 1, 15.0, 400.0, "heading"), ("A plain sentence of text.", 1, 10.0, 400.0, "text"), ("Figure 3 sales", 1, 10.0, 400.0, "caption")]
    df = spark.createDataFrame(rows, "text string, n int, size double, y0 double, want string")
    zero, box = F.lit(0), Box(F.lit(0.0), F.col("y0"), F.lit(100.0), F.col("y0") + 12)
    made = layout.block_class(F.col("text"), F.col("n"), F.col("size"), F.lit(10.0), F.lit(24.0), box, F.lit(842.0), F.lit(1), zero, F.lit(False), zero, F.lit(True))
    assert [r[0] for r in df.select(made).collect()] == [r[-1] for r in rows]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "x0 double, y0 double, x1 double, y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    a, b, m = Box.of(), Box.of("b_"), (2.0, 0.0, 0.0, 3.0, 1.0, -1.0)
    r = df.select(a.iou(b), a.coverage_by(b), a.union(b).area(), a.mapped(m).mapped(inverse(m)).x1, a.padded(4, 12, 12).x1, a.scaled(2, 2).area()).first()
    assert [round(x, 6) for x in r] == [round(25 / 175, 6), 0.25, 225.0, 10.0, 12, 400.0]


def line(text, x0, y0, x1, y1):
    return {"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def test_paragraphs(spark):
    assert lines.text_of([line("Hello wor-", 0, 0, 100, 10), line("ld again", 0, 12, 100, 22), line("New paragraph", 0, 40, 100, 50)]) == "Hello world again\n\nNew paragraph"
    assert lines.text_of([line("日本語の文書を", 0, 0, 100, 10), line("処理します。", 0, 12, 100, 22), line("Next English line", 0, 24, 100, 34)]) == "日本語の文書を処理します。 Next English line"
    assert lines.text_of([line("right", 60, 1, 100, 11), line("left", 0, 0, 50, 10), line("- item", 0, 12, 50, 22)]) == "left right\n- item"
    assert lines.text_of([]) == ""
    df = spark.createDataFrame([("a", "one", 0.0, 0.0, 9.0, 9.0), ("b", "two", 0.0, 0.0, 9.0, 9.0), ("a", "more", 0.0, 10.0, 9.0, 19.0)], "region string, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.region: r.text for r in lines.region_texts(df, ["region"]).collect()} == {"a": "one more", "b": "two"}


def test_pieces():
    chars = [(c, (i, 0, i + 1, 2)) for i, c in enumerate("ab cd " + "x" * 30 + " ef")]
    assert lines.pieces(chars, 5) == [("ab cd", (0, 0, 5, 2)), ("ef", (37, 0, 39, 2))]
