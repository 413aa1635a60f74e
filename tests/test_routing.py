import pytest
from pyspark.sql import functions as F

from papyrine.operators import routing

ALL = routing.METHODS


def plan(spark, kind, page="scanned", area=0.1, chars=0, cells=None, full=False, available=ALL):
    made = routing.plan(F.lit(kind), F.lit(page), F.lit(area), F.lit(chars), F.lit(cells).cast("int"), F.lit(full), available)
    return spark.range(1).select(made.alias("p")).first().p


def test_text_never_goes_to_the_model(spark):
    for kind in ("text", "title", "heading", "list", "seal", "footer"):
        assert plan(spark, kind).plan == ["ocr"] and plan(spark, kind, "digital", chars=200).plan == ["pdf_text", "ocr"]
    assert plan(spark, "text", full=True).plan == ["ocr"]


def test_other_plans(spark):
    assert plan(spark, "table", "digital", chars=50).plan == ["pdf_table", "table_recognition", "vlm", "pdf_text"]
    assert plan(spark, "table", area=0.6).plan == ["vlm", "table_recognition", "ocr"] == plan(spark, "table", cells=200).plan
    assert plan(spark, "formula").plan == ["formula_recognition", "vlm", "ocr"]
    assert plan(spark, "chart").plan == ["vlm"] == plan(spark, "image").plan
    small, tiny = plan(spark, "image", area=0.005), plan(spark, "image", area=0.0005)
    assert (small.plan, small.drop, small.note) == ([], False, "kept as figure: small image (logo/icon)") and (tiny.plan, tiny.drop) == ([], True)


def test_missing_engines(spark):
    few = ("pdf_text", "pdf_table")
    assert plan(spark, "text", available=few).plan == [] and plan(spark, "table", "digital", chars=9, available=few).plan == ["pdf_table", "pdf_text"]
    assert plan(spark, "chart", available=few).note == "kept as figure: no VLM configured"


def verdict(spark, kind, method, content, issues=(), confidence=None, error=None):
    found = F.array(*map(F.lit, issues)) if issues else F.array().cast("array<string>")
    v = routing.verdict(F.lit(kind), F.lit(method), F.lit(content), F.lit(error).cast("string"), found, F.lit(confidence).cast("double"))
    r = spark.range(1).select(v.alias("v")).first().v
    return r.passed, r.status, round(r.score, 4)


@pytest.mark.parametrize(
    "given, want",
    [
        (("text", "ocr", "x", (), None, "boom"), (False, "needs_review", 0.0)), (("table", "ocr", "some"), (True, "needs_review", 0.3)), (("formula", "pdf_text", " "), (False, "needs_review", 0.0)),
        (("image", "ocr", ""), (True, "skipped", 0.1)), (("chart", "ocr", "a"), (True, "unchecked", 0.4)), (("table", "vlm", "x", ("a", "b")), (False, "needs_review", 0.4)), (("formula", "vlm", "x"), (True, "unchecked", 1.0)),
        (("image", "vlm", "I'm sorry, no"), (False, "needs_review", 0.1)), (("text", "ocr", "x", ("a",), 0.5), (False, "needs_review", 0.4)), (("text", "pdf_text", "x", ("a",)), (False, "needs_review", 0.7)), (("seal", "ocr", "x"), (True, "passed", 1.0)),
    ],
)
def test_verdicts(spark, given, want):
    assert verdict(spark, *given) == want


def issues(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_checks(spark):
    none = F.array().cast("array<double>")
    say = lambda text, conf=0.98, agree=None, scores=none: issues(spark, routing.text_issues(F.lit(text), F.lit("ocr"), F.lit(conf), F.lit(agree).cast("double"), scores))
    assert any("Vietnamese" in i for i in say("Cng hòa xã hi ch nghĩa Vit Nam")) and say("Cộng hòa xã hội chủ nghĩa Việt Nam") == []
    assert say("some text", 0.5) == ["low OCR confidence (0.50)"]
    assert say("some text", 0.9, 0.8) == ["two OCR readings disagree (80% similar)"]
    assert say("some text", 0.9, None, F.array(F.lit(0.5), F.lit(0.9))) == ["50% of lines below confidence 0.6"]


def test_table_and_formula_checks(spark):
    table = lambda *a: issues(spark, routing.table_issues(*[F.lit(x) for x in a]))
    assert table(2, 2, False, 0.0, 0, 0.95) == ["rows have different numbers of cells"]
    assert table(0, 0, False, 1.0, 0, 0.9) == ["no table structure recognised"]
    assert table(20, 10, True, 0.0, 0, 0.85) == ["low table confidence (0.85, complex table)"] and table(3, 3, True, 0.0, 0, 0.85) == []
    formula = lambda x: issues(spark, routing.formula_issues(F.lit(x)))
    assert formula(r"\frac{a}{b}") == [] and formula(r"\frac{a}{b") == ["unbalanced braces"] and formula("x " * 20) == ["repeated tokens (decoder loop)"] and formula(" ") == ["empty formula"]
    assert formula(r"\left( x") == ["unbalanced \\left/\\right"]


def test_number_checks(spark):
    check = lambda a, b, full=True: issues(spark, routing.number_issues(F.lit(a), F.lit(b), F.lit(full)))
    assert check("a b 1 2", "a b 1 2 3") == ["numbers missing vs source (67% matched)"]
    assert check("1 2 9", "1 2") == ["numbers not present in source (67% supported)"] and check("1 2 9", "1 2", False) == []
    assert check("5 of", "5% of") == ["special characters lost: %"] and check("x", "no numbers %") == []


def figure(spark, kind="image", status="unchecked", description="A", fk="diagram", lossless=True, text="A B", values=(), labels=(), policy="auto"):
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    s = lambda x: F.lit(x).cast("string")
    made = routing.keep_figure(F.lit(policy), F.lit(status), F.lit(kind), s(description), s(fk), F.lit(lossless), s(text), arr(values), arr(labels))
    return spark.range(1).select(made.alias("k")).first().k


def test_figures(spark):
    assert not figure(spark).keep and figure(spark, fk="photo").keep and figure(spark, lossless=False).keep and figure(spark, text=None).keep and figure(spark, description=None).keep and figure(spark, "seal").keep
    assert figure(spark, status="needs_review").keep and not figure(spark, "table", "passed").keep and figure(spark, "table", "passed", policy="always").keep and not figure(spark, policy="never", description=None).keep
    printed = "Doanh thu thuần (tỷ đồng) 2024 2025 1.100 1.234,5"
    chart = lambda values, labels=(), text=printed: figure(spark, "chart", fk="chart", text=text, values=values, labels=labels)
    assert not chart(("2024", "1.100", "2025", "1.234,5"), ("Doanh thu thuần (tỷ đồng)", "Doanh thu thuần")).keep
    assert chart(("2024", "~1.100")).reason == "chart values are estimated" and chart(("2025", "9.999")).reason == "chart values not found in the text of the picture" and chart(()).reason == "chart without extracted data"
    assert chart(("2024", "1.100"), ("Net revenue (million USD)", "Sales")).reason == "chart labels not printed in the picture: Net revenue (million USD); Sales"


def test_grounding(spark):
    say = lambda label, printed: issues(spark, routing.ungrounded(F.array(F.lit(label)), F.lit(printed)))
    assert say("Doanh thu thuần", "Doanh thu thuan 2024") == [] and say("売上高", "売上高の推移 2024年") == [] and say("利益", "売上高の推移") == ["利益"]


def test_agreement(spark):
    assert issues(spark, routing.agreement(F.lit("a b c"), F.lit("abc"))) == 1.0 and issues(spark, routing.agreement(F.lit(""), F.lit(" "))) == 1.0 and issues(spark, routing.agreement(F.lit("abcd"), F.lit("abce"))) == 0.75


def test_garbled_layers_with_and_without_a_reader_of_scans(spark, tmp_path):
    """in EX-02 and EX-04 digital pages have none; where there is one, a garbled layer is read again."""
    from papyrine.plans import flow_queries, views

    spark.createDataFrame([(3, "Beröä, berßpf einieüte und chgeä iest erzusch der tzchpf stö stä ch.", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    t = views.Tables(spark, str(tmp_path))
    assert [tuple(r) for r in flow_queries.routed(t).collect()] == [("3", "text", "pdf_text", "needs_review", 1)]
    assert [tuple(r)[:4] for r in flow_queries.run_statistics(t).collect()] == [("s", 1, 0, 1)]
    assert [x.method for x in flow_queries.executed(t).first().attempts] == ["pdf_text", "ocr"]
