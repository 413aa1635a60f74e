import random
import zlib

import numpy as np

from papyrine.llm import langid

WORDS = {"en": "the and of to in that it is was for on with".split(), "de": "der die und das nicht ein mit zu ist für von".split(), "fr": "le la et les des un une est pour que dans été".split()}


def corpus(spark, n=240):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "x", "on"]) for _ in range(r.randint(5, 300))), lang) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_windows_hold_every_byte_once():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(i % 251 + 1 for i in range(n))
        data, weight = langid.windows_of(text)
        assert weight.sum() == n and data.shape == (max(1, -(-n // 256)), 256)
        assert n < 256 or data[-1].tobytes() == text[-256:]


def test_filters_are_a_convolution():
    rng = np.random.default_rng(2)
    net = langid.Network(["x"], [rng.normal(size=(k, 256, 3)).astype(np.float32) for k in (2, 3)], np.zeros(6, np.float32), np.zeros((6, 1), np.float32), np.zeros(1, np.float32))
    x = rng.integers(0, 256, (4, 20)).astype(np.uint8)
    for values, table in zip(net.filtered(x), net.tables, strict=True):
        k = len(table)
        for w in range(4):
            for p in range(20 - k + 1):
                assert np.allclose(values[p, w], sum(table[j][x[w, p + j]] for j in range(k)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    net = langid.learn(docs)
    assert net.languages == ["de", "en", "fr"]
    rows = langid.predict(docs, net).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 < r.score <= 1 for r in rows)
    again = langid.learn(docs.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(net.tables, again.tables, strict=True))


def test_every_language_is_learnt(spark):
    rows = [(i, f"text {i} of l{i % 230}", f"l{i % 230}") for i in range(920)]
    net = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}) and len(net.languages) > 200


def test_edge_cases(odd, none, spark):
    net = langid.learn(corpus(spark))
    for r, x in zip(langid.predict(odd, net).collect(), odd.collect(), strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, x.text or ""))) and 0 <= r.score <= 1 and r.held_out is not None
    assert langid.learn(none) is None and langid.predict(none, net).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert isinstance(langid.learn(odd), langid.Network)


def test_the_sample_keeps_its_bounds(spark):
    rows = [(i if i % 2 else 1, f"text {i % 50} of words", "en") for i in range(3000)] + [(i, "der text", "de") for i in range(40)] + [(1, "same", "fr")] * 500 + [(i, f"le {i}", "fr") for i in range(5000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.lang for r in langid.training_windows(docs, 4, 2, 100, 6, 40_000).collect()]
    assert got.count("en") == 100 and got.count("fr") == 100 and 20 < got.count("de") <= 40  # whatever repeats
    some = langid.training_windows(docs, 4, 2, 100, 6, 30)
    assert {(lang, [r.lang for r in some.collect()].count(lang)) for lang in ("en", "fr", "de")} == {("en", 10), ("fr", 10), ("de", 10)}
    alike = spark.createDataFrame([(1, "same text", "xx")] * 3000, "doc_id long, text string, lang string")
    assert langid.training_windows(alike, 4, 2, 100, 6, 40_000).count() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "text#" not in plan.split("MapInArrow")[0]


def test_predictions_by_hand(spark, odd):
    rng = np.random.default_rng(8)
    net = langid.Network(["a", "b", "c"], [rng.normal(size=(k, 256, 2)).astype(np.float32) for k in (2, 3)], rng.normal(size=4).astype(np.float32), rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = ["one", "Ünïcödé ﬁne 漢字", "x" * 256, "ab " * 200, "", None, "12 34"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(docs, net).collect():
        text = texts[r.doc_id]
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        data, summed = text.encode(), np.zeros(3)
        for start in range(0, len(data), 256):
            window = data[start : start + 256]
            adds = len(window)
            if adds < 256:
                window = data[-256:] if len(data) > 256 else window + bytes(256 - adds)
            pooled = []
            for table in net.tables:
                k = len(table)
                pooled += [max(sum(table[j][window[p + j]][f] for j in range(k)) for p in range(256 - k + 1)) for f in range(2)]
            logits = np.maximum(np.array(pooled) + net.shift, 0) @ net.dense + net.bias
            p = np.exp(logits - logits.max())
            summed += adds * p / p.sum()
        p = summed / len(data)
        assert r.lang_pred == net.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-4
