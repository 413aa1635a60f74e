import re
import subprocess
import sys
import unicodedata

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from papyrine.functions import text as tx
from papyrine.functions.udf import PIECE, each, pieces
from papyrine.plans.registry import queries


def value(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r[0] for r in df.select(column).collect()]


T = F.col("t")
FINE = "Cộng hòa xã hội chủ nghĩa Việt Nam"


def test_normalize(spark):
    assert value(spark, tx.normalize(T), "Việt  Nam\u00ad ", "\u3000a\u00a0\u2009b\n c\u0085", None) == ["Việt Nam", "a b\n c", None]


def test_garbled(spark):
    good = [f"{FINE} - Độc lập - Tự do - Hạnh phúc", "2025年10月31日 日本ガイシ株式会社 業績概況(連結・中間期) 売上高 前年同期比", "The coefficients α and β of the model Δx = 0.5 for all samples in the study", ""]
    assert value(spark, tx.garbled_ratio(T), *good) == [0.0] * 4
    legacy, cid, foreign, broken = value(spark, tx.garbled_ratio(T), "Céng hßa x· héi chñ nghÜa ViÖt Nam §éc lËp - Tù do - H¹nh phóc", "(cid:12)(cid:13)(cid:14) abc", "஦ᴗ➼ࡢࣜ ࢫࢡ ௨ୗࡢ㡯┠ࡣᙜ♫ࢢ࣮ࣝ ࣉࡢ஦ᴗᒎ㛤ୖࣜ ࢫࢡ࡜࡞ࡿྍ ⬟ᛶࡀ࠶ࡿ࡜⪃࠼ࡽࢀࡿ", "\ufffd\ue000ab")
    assert legacy > 0.05 and cid > 0.5 and foreign > 0.5 and broken == 0.5


def test_numbers(spark):
    assert value(spark, tx.numbers(T), "1.234,5 tỷ và 1,234.5 USD, tăng 12,3%", "売上高は１，２３４．５億円", "a12 x -7% 1 234", "") == [["12345", "12345", "123"], ["12345"], ["7", "1", "234"], []]


def test_dropout(spark):
    dropped = ["Cng hòa xã hi ch nghĩa Vit Nam", "BÁO CÁO KT QU KINH DOANH NM 2025"]
    whole = [FINE, "UBND TP HCM ban hành quyết định số 15/QĐ-UBND", "BÁO CÁO KẾT QUẢ KINH DOANH NĂM 2025 CỦA CTCP ABC", "The quick brown fox jumps over Mr Smith", "a b"]
    assert all(v > 0.08 for v in value(spark, tx.dropout_ratio(T), *dropped)) and value(spark, tx.dropout_ratio(T), *whole) == [0.0] * 5


def test_vietnamese_and_language(spark):
    noisy = "Noteholders who holđ Notes through a bank, securities broker or other intermediary should check with that intermediary " * 3
    assert value(spark, tx.looks_vietnamese(T), FINE, noisy) == [True, False]
    for text, languages, expected in [("Hình 1. Doanh thu thuần giai đoạn 2022–2025", ("vi", "en"), "vi"), ("Figure 1. Net revenue from 2022 to 2025", ("vi", "en"), "en"), ("図1 売上高の推移（2022〜2025年）", ("vi", "en", "ja"), "ja"), ("1.234,5", ("vi", "en"), None)]:
        assert value(spark, tx.detect_language(T, languages), text) == [expected]


def test_confirmed_language(spark):
    rows = {FINE + " và " + FINE.lower(): "vi", "the board of the company and its members are in this report": "en", "決算短信の連結業績について説明します": "ja", "La société présente ses résultats annuels consolidés": "other", "12 ab": "unknown"}
    assert value(spark, tx.confirmed_language(T), *rows) == list(rows.values())


def test_lists_and_joins(spark):
    assert value(spark, tx.is_list_item(T), "- a", "12) b", "iv. c", "• d", "plain", "-5") == [True, True, True, True, False, False]
    assert value(spark, tx.strip_bullet(T), "  3. word x", "no") == ["word x", "no"]
    pair = tx.join_inline(F.split(T, "[|]")[0], F.split(T, "[|]")[1])
    assert value(spark, pair, "決算|短信", "決算|x", "a|b", "|b", "a|") == ["決算短信", "決算 x", "a b", "b", "a"]


def test_plain_text(spark):
    md = "<!-- c\nd --># Title\n\n- item **bold**\n> quote\n| a | b |\n|---|---|\n| 1 | _x_ |\n<b>t</b> 決 算"
    assert value(spark, tx.markdown_to_plain(T), md) == ["Title item bold quote a b 1 x t 決算"]


def test_tokens_fold_domain_pages(spark):
    assert value(spark, tx.tokens(T), "Hello, World_1 決算2025a") == [["hello", "world_1", "決", "算", "2025", "a"]]
    assert value(spark, tx.fold(T), "Báo cáo Tài chính/2025 — Đại hội", "ガバナンス") == ["bao-cao-tai-chinh/2025-dai-hoi", "ガバナンス"]
    assert value(spark, tx.domain(T), "https://www.A.com:80/x", "b.org/y", "http://user@c.vn?q") == ["a.com", "b.org", "c.vn"]
    assert value(spark, tx.page_numbers(T), "1-3,5", "2, 2,0", "") == [[1, 2, 3, 5], [2], []]
    assert value(spark, tx.headings(T), "# A\ntext\n### B c \n") == [["A", "B c"]]


def test_special_and_recall(spark):
    assert value(spark, tx.special_counts(T), "5% or 6% of $1") == [{"$": 1, "%": 2}]
    df = spark.createDataFrame([(["1", "1", "2"], ["1", "2", "3"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tx.multiset_recall(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 1.0]


def test_fonts_and_json(spark):
    assert value(spark, tx.is_legacy_font(T), "ABCDEE+.VnTime", "VNI-Times", "Arial") == [True, True, False]
    assert value(spark, F.variant_get(tx.first_json(T), "$.a", "int"), '<think>{x}</think>```json\n{"a": 3}\n```', "none") == [3, None]


def streamed(spark, column):
    """Whether the column's Python takes batches piece by piece."""
    plan = spark.createDataFrame([("a",)], "t string").select(column)._jdf.queryExecution().executedPlan().toString()
    return f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan and f", {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in plan


def test_batches_in_pieces(spark):
    texts = ["", "é" * 300_000, None, "x" * (3 * PIECE), *["e\u0301" * 5_000] * 400, "ﬁ①", "end"]
    cut = list(pieces(pa.array(texts)))
    assert [x for p in cut for x in p.to_pylist()] == texts and all(len(p) == 1 or p.nbytes <= PIECE for p in cut) and len(cut) > 3
    assert [len(p) for p in pieces(pa.record_batch({"a": pa.array([], pa.string())}))] == [0]
    for form, function in (("NFC", tx.nfc), ("NFKC", tx.nfkc)):
        assert value(spark, function(T), *texts) == [x and unicodedata.normalize(form, x) for x in texts] and streamed(spark, function(T))
    assert value(spark, each("array<struct<n:int>>")(lambda x: None if x is None else [{"n": len(x)}] * len(x))(T), "ab", None, "") == [[(2,), (2,)], None, []]


def test_folding_in_pieces(spark):
    texts = ["Đại hội / Ｆ①", None, "", "ガ" * 400_000, *["Báo cáo! "] * 200_000]
    got = value(spark, tx.fold(T), *texts)
    assert got[:4] == ["dai-hoi-/-ｆ①", None, "", "ガ" * 400_000] and set(got[4:]) == {"bao-cao"} and len(got) == len(texts)
    assert streamed(spark, tx.fold(T))


def test_plain_text_in_pieces(spark):
    texts = ["# Tie\u0302\u0301ng <b>Vie\u0323\u0302t</b>", None, "", "<td>" + "漢 字\n" * 300_000, *["* e\u0301 **b**"] * 100_000]
    got = value(spark, tx.markdown_to_plain(T), *texts)
    assert got[:4] == ["Tiếng Việt", None, "", "漢字" * 300_000] and got[4:] == ["é b"] * 100_000 and streamed(spark, tx.markdown_to_plain(T))


def test_composed_texts_stay_out_of_python(spark, monkeypatch, tmp_path):
    def recorded(returns):
        def wrap(function):
            def note(x):
                with open(f"{tmp_path}/seen", "a") as seen:
                    seen.write(f"{x}\n")
                return function(x)

            return each(returns)(note)

        return wrap

    monkeypatch.setattr(tx, "each", recorded)
    texts = ["# Größe <b>Việt</b>", "漢字カナ、がぎ", "한글 Ελλά", None, "", "a → 1", "*e\u0301*", "a<\u0338b> | c", "😀"]
    assert value(spark, tx.markdown_to_plain(T), *texts) == ["Größe Việt", "漢字カナ、がぎ", "한글 Ελλά", None, "", "a → 1", "é", "a c", "😀"]
    assert {x for x in (tmp_path / "seen").read_text().split("\n") if x} <= {"None", "e\u0301", "a    c", "😀"}


def test_composed_characters(spark):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    seconds = {chr(int(x, 16)) for c in signs if not unicodedata.decomposition(c).startswith("<") for x in unicodedata.decomposition(c).split()[1:]}
    seconds |= {chr(c) for c in range(0x1100, 0x1200)}  # Hangul is composed by rule
    for form, function in (("NFC", tx.nfc), ("NFKC", tx.nfkc)):
        ranges = [tuple(int(x, 16) for x in found) for part in tx.COMPOSED[form] for found in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", part)]
        assert len(ranges) == sum(part.count("-") for part in tx.COMPOSED[form])
        inside = [chr(c) for a, b in ranges for c in range(a, b + 1)]
        assert not [c for c in inside if unicodedata.combining(c) or c in seconds or unicodedata.normalize(form, c) != c or unicodedata.category(c) == "Cn"]
        edges = [chr(c) for a, b in ranges for c in (a - 1, a, b, b + 1) if c >= 0 and not 0xD800 <= c < 0xE000]
        texts = [x for c in [*edges, *sorted(seconds), *"ﬁ①Å〈豈"] for x in (c, f"e{c}", f"a\u0301{c}漢")]
        assert value(spark, function(T), *texts) == [unicodedata.normalize(form, x) for x in texts]


def test_workers_need_not_find_the_engine():
    says = "import pickle, sys, pyarrow as pa; print([len(x) for x in pickle.load(sys.stdin.buffer)(pa.array(['abc'] * 5), 16)])"
    assert subprocess.run([sys.executable, "-I", "-c", says], input=cloudpickle.dumps(pieces), capture_output=True, check=True).stdout == b"[2, 1, 2]\n"


def test_document_types_normalise_once(spark, tmp_path):
    spark.createDataFrame([(1, "BA\u0301O CA\u0301O TA\u0300I CHI\u0301NH"), (2, "決算短信"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries()["TXT-22"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, "financial_statement", "other"), (2, "other", "earnings_summary"), (3, "other", "other")}
    nodes = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in x]
    assert len(nodes) == 1 and nodes[0].count("pythonUDF") == 1
