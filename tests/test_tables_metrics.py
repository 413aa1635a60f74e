import difflib
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import charsets, charts, images, metrics, tables
from papyrine.functions import text as tx


def html(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def test_spans_and_rendering(spark):
    spanned = "<table><tr><th rowspan='2'>A</th><th colspan='2'>B</th></tr><tr><td>b1</td><td>b2</td></tr><tr><td>x</td><td>1</td><td>2</td></tr></table>"
    t = tables.largest_table(spanned)
    s = tables.shape(t)
    assert (s["n_rows"], s["n_cols"], s["rectangular"], s["span_count"]) == (3, 3, True, 2) and tables.render(t).startswith("<table>")
    assert tables.largest_table(tables.to_html(t)) == t
    assert tables.to_markdown(tables.from_markdown("| a | b |\n|---|---|\n| 1 | 2 |")) == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert tables.from_markdown("no table") is None and tables.html_tables("<p>x</p>") == [] and tables.html_tables(None) == []
    ragged = tables.shape(tables.largest_table("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>"))
    assert not ragged["rectangular"]
    nested = tables.html_tables("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b<br>c</td></tr></table>")
    assert len(nested) == 1 and [c["text"] for c in nested[0][0]] == ["ain", "b\nc"]
    assert tables.from_markdown("| a \\| b | c |")[0][0]["text"] == "a | b"
    assert tables.from_grid([["x", None], ["1", "2"]])[0][0]["colspan"] == 2
    df = spark.createDataFrame([(spanned,), ("",), (None,)], "h string")
    assert [r.d.n_cells for r in df.select(tables.described(F.col("h")).alias("d")).collect()] == [9, 0, 0]


def test_tree_scores(spark):
    a, b, c = html("ab", "12"), html("ab", "13"), html("a")
    df = spark.createDataFrame([(a, a), (a, b), (a, c), ("", a), ("", "")], "x string, y string")
    rows = [r.s for r in df.select(metrics.table_scores(F.col("x"), F.col("y")).alias("s")).collect()]
    assert rows[0].teds == 1.0 and 0.8 < rows[1].teds < 1.0 and rows[1].structure == 1.0 and rows[2].teds < 0.5 and rows[3].teds == 0.0 and rows[4].teds == 1.0
    assert metrics.matched_teds([tables.largest_table(a), tables.largest_table(b)], [tables.largest_table(b)]) == [pytest.approx(rows[1].teds), 0.0]


def test_edit_distance_by_definition():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        assert metrics.edit_distance(a, b) == plain(a, b)


def scores(spark, truth, made):
    df = spark.createDataFrame([(truth, made)], "a string, b string")
    return df.select(*[c.alias(k) for k, c in metrics.document_scores(F.col("a"), F.col("b")).items()]).first()


def test_character_errors(spark):
    assert scores(spark, "# Xin chào", "Xin chào").cer == 0.0 and 0 < scores(spark, "Việt Nam", "Vit Nam").cer < 0.2
    assert scores(spark, "決算短信 連結業績", "決 算 短 信 連 結 業 績").cer == 0.0 and scores(spark, "2026年3月期", "2 0 2 6 年 3 月 期").cer > 0
    assert scores(spark, "", "").cer == 0.0 and scores(spark, "", "x").cer == 1.0 and scores(spark, "a", "abc").cer == 2.0
    assert scores(spark, "# A\n# B", "# A").heading_f1 == 0.6667 and scores(spark, "text", "# A").heading_f1 is None
    assert scores(spark, "one two", "two one").word_f1 == 1.0 and scores(spark, "one two three", "one x three").wer == 0.3333


def test_order_free_errors(spark):
    truth = "Doanh thu năm 2025 tăng 12%\nLợi nhuận sau thuế 1.234 tỷ đồng\nTiền cuối kỳ 567 tỷ"
    swapped = "Tiền cuối kỳ 567 tỷ\nDoanh thu năm 2025 tăng 12%\nLợi nhuận sau thuế 1.234 tỷ đồng"
    free = lambda made, t=truth: scores(spark, t, made).cer_any_order
    assert scores(spark, truth, swapped).cer > 0.4 and free(swapped) == 0.0 and 0 < free(swapped.replace("567", "561")) < 0.05
    assert free("Doanh thu năm 2025 tăng 12%") > 0.5 and free(truth + "\nchữ thừa không có trong đáp án") > 0.3
    assert free("| Item | 2024 | 2025 |\n|---|---|---|\n| Revenue | 10 | 12 |", "Item 2024 2025\nRevenue 10 12") == 0.0


def test_charts(spark):
    data = '{"title": "Sales", "chart_type": "bar", "description": "Up.", "columns": ["year", "v"], "rows": [["2024", 1], {"year": "2025", "v": "b"}]}'
    assert charts.markdown(data, "raw") == "Sales — bar\n\nUp.\n\n| year | v |\n|---|---|\n| 2024 | 1 |\n| 2025 | b |" and charts.markdown("{", " raw ") == "raw"
    d = spark.createDataFrame([(data,), (None,)], "d string").select(charts.described(F.col("d")).alias("c")).collect()
    assert d[0].c.cells == ["2024", "1", "2025", "b"] and d[0].c.labels == ["Sales", "year", "v", "b"] and d[1].c.cells == []


def test_charsets():
    assert len(charsets.charset()) == 281 and charsets.fallbacks("ộ") == ["ô", "o"] and charsets.fallbacks("đ") == ["d"]
    assert charsets.charset(("ja",), ["漢", "为", "a"])[:2] == ["漢", "a"]
    with pytest.raises(ValueError):
        charsets.charset(("ja",))


def test_images():
    page = np.full((300, 400), 255, np.uint8)
    for y in range(20, 280, 20):
        page[y : y + 4, 30:370] = 0
    assert images.skew(page) == 0.0 and images.skew(np.full((50, 50), 255, np.uint8)) == 0.0
    yy, xx = np.mgrid[0:300, 0:400]
    turned = page[np.clip(np.round(yy - (xx - 200) * np.tan(np.radians(2.0))).astype(int), 0, 299), xx]
    assert abs(abs(images.skew(turned)) - 2.0) <= 0.2
    banner = np.full((60, 300), 40, np.uint8)
    banner[20:40, 50:80] = 250
    assert images.dark_on_light(banner)[0, 0] == 215 and images.dark_on_light(page) is page
    assert images.stretched(page)[1] is False and images.stretched((page // 16 + 120).astype(np.uint8))[1] is True


def test_rendered_html_without_python(spark):
    df = spark.range(1).select(tables.html_of(F.array(F.array(F.lit("a"), F.lit("b<")), F.array(F.lit("1\n2"), F.lit("")))).alias("h"))
    assert df.first().h == "<table><tr><th>a</th><th>b&lt;</th></tr><tr><td>1<br>2</td><td></td></tr></table>" and tx is not None


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=25), st.text("ab cé", max_size=80))
def test_closest_stretch_as_sequence_matcher(line, text):
    blocks = difflib.SequenceMatcher(None, line, text, autojunk=False).get_matching_blocks()[:-1]
    want = None
    if blocks and 2 * sum(b.size for b in blocks) >= len(line):
        at = max(0, blocks[0].b - blocks[0].a)
        want = at, min(len(text), at + len(line))
    assert metrics.closest_stretch(line, text) == want


@settings(max_examples=300, deadline=None)
@given(st.text("ab \u00e9\u6f22", max_size=40), st.text("ab \u00e9\u6f22", max_size=40))
def test_edit_distance_of_bits_as_by_rows(a, b):
    assert metrics.edit_distance(a, b) == metrics.edit_distance(list(b), list(a)) == metrics._edit_distance_by_rows(a, b)


def test_long_texts_are_compared_in_little_time():
    """by whole matrices this took some 15 s."""
    words = [f"w{i * i % 997}x" for i in range(6000)]
    lines = [" ".join(words[i : i + 100]) for i in range(0, 6000, 100)]
    text = " ".join(x.replace("7x", "y") for x in reversed(lines))
    began = time.process_time()
    assert 0 < metrics.any_order_rate(lines, text) < 1 and metrics.edit_distance(" ".join(lines), text) > 0
    assert time.process_time() - began < 6


def test_levenshtein_column(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), (None, "a"), ("漢字", "漢")], "a string, b string")
    assert [r[0] for r in rows.select(metrics.levenshtein(F.col("a"), F.col("b"))).collect()] == [3, 3, None, 1]
    assert [r[0] for r in rows.select(metrics.normalized_distance(F.col("a"), F.col("b"))).collect()] == [pytest.approx(3 / 7), 1.0, None, 0.5]


def test_dialogues_are_dealt_out(spark, tmp_path):
    """adaptive execution would put a small table's comparisons into one task."""
    from papyrine.plans import set_queries, views

    spark.createDataFrame([(i, 0, f"text {i}") for i in range(50)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert set_queries.dialogues(views.Tables(spark, str(tmp_path))).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bags_are_counted_in_place(spark, tmp_path):
    """a document without tokens has no F1, as in the SQL; nothing is shuffled."""
    from papyrine.plans import set_queries, text_queries, views

    spark.createDataFrame([(1, "the cat the"), (2, "... 。"), (3, None), (4, "in the end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    f1, recall = (f(views.Tables(spark, str(tmp_path))) for f in (set_queries.word_f1, text_queries.recall))
    assert {r.doc_id: r.f1 for r in f1.collect()} == {1: 0.666667, 4: 0.666667}
    assert {r.doc_id: r.recall for r in recall.collect()} == {1: 0.666667, 2: 1.0, 3: None, 4: 0.666667}
    for made in (f1, recall):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shift", [1, 2])
def test_table_scores_take_little_time(shift):
    """F2, F7, F8: each pair took some milliseconds."""
    made = "<table>" + "".join(f"<tr><td>MACHINERY{i}</td><td>{i * 2}</td></tr>" for i in range(3)) + "</table>"
    want = [metrics.teds(tables.largest_table(made.replace("<td>", "<td >", shift)), tables.largest_table(made.replace("N", "n")), x) for x in (False, True)]
    began = time.process_time()
    for i in range(300):
        assert list(metrics._both_scores(made, made.replace("N", "n"))) == want
    assert time.process_time() - began < 1
