import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import lm, vocab


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n, d = 30, 6
    model = lm.Model({}, {}, rng.normal(size=(n, d)).astype(np.float32), rng.normal(size=(d, d)).astype(np.float32), rng.normal(size=(d, d)).astype(np.float32), rng.normal(size=n).astype(np.float32))
    one, two, z = model.tables()
    for u in range(0, n, 7):
        for v in range(0, n, 5):
            assert abs(np.exp(one[u] + two[v] - z[u, v], dtype=np.float64).sum() - 1) < 1e-3


def test_training_learns_contexts():
    rng = np.random.default_rng(3)
    u = rng.integers(1, 6, 40_000)
    rows = np.stack([u, rng.integers(1, 6, 40_000), np.where(rng.random(40_000) < 0.9, u % 5 + 1, rng.integers(1, 6, 40_000))], 1).astype(np.int32)
    totals = np.bincount(rows[:, 2], minlength=7).astype(float)
    model = lm.Model({}, {}, *lm.train(rows, totals))
    one, two, z = model.tables()
    a, b, w = rows.T
    neural = (one[a, w] + two[b, w] - z[a, b]).mean()
    unigram = np.log(totals[w] / totals.sum()).mean()
    assert neural > unigram + 0.5


def brute(rows):
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in lm.tokens((t or "").encode()))
    return c, sum(c.values()), len(c)


def test_base_model(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    c, n, v = brute(rows)
    got = lm.score(odd).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        words = lm.tokens((t or "").encode())
        want.setdefault(i, []).append((len(words), sum(c[w] > 0 for w in words), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert any((r.n_tokens, r.n_known) == x[:2] and abs(r.base_score - x[2]) < 1e-6 * (1 + abs(x[2])) for x in want[r.doc_id])
        assert math.isfinite(r.score) and r.score <= 0
    assert lm.score(none).count() == 0


def by_hand(fitted, texts, c):
    """The log10 score of each text, token by token."""
    model, log = fitted.model, math.log10
    one, two, z = model.tables()
    ending = lambda w: w[-2:] if w[-2:] in model.endings else None
    inside = {}
    for w, n in c.items():
        if w not in model.core:
            t = inside.setdefault(ending(w), [0, 0])
            t[0] += n
            t[1] += 1
    out = []
    for text in texts:
        u = v = 0
        total = 0.0
        for w in lm.tokens((text or "").encode()):
            k = model.core[w] if w in model.core else model.endings.get(w[-2:], len(model.bias) - 1)
            total += float(one[u, k] + two[v, k] - z[u, v]) / math.log(10)
            if w not in model.core:
                t, n = inside.get(ending(w), (0, 0))
                total += log(c[w] + 0.1) - log(t + 0.1 * (n + 1))
            u, v = k, u
        out.append(total)
    return out


@pytest.mark.parametrize("head", [0, 2, None])
def test_score_by_hand_for_any_head(spark, head):
    r = random.Random(4)
    texts = ["", None, "x"] * 60 + [" ".join(r.choice(["a", "bb", f"w{r.randint(0, 400)}ed", f"n{r.randint(0, 3000)}"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = lm.fit(docs, F.col("doc_id") % 3 != 0, examples=5000, head=head)
    c = Counter(w for i, t in enumerate(texts) if i % 3 for w in lm.tokens((t or "").encode()))
    want = by_hand(fitted, texts, c)
    for r in lm.scored(docs, fitted).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-3 * (1 + abs(want[r.doc_id])) and r.score <= 0, (r, want[r.doc_id])


def test_the_model_does_not_depend_on_the_head(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 50} d{i}") for i in range(300)], "doc_id long, text string")
    some, none = lm.counted(docs, F.lit(True))[0], lm.counted(docs, F.lit(True), head=0)[0]
    assert some.model.core == none.model.core and some.inside == none.inside and len(some.model.core) > 300


def test_few_long_texts_with_more_words_than_the_head(spark, monkeypatch):
    monkeypatch.setattr(vocab, "BATCH_ROWS", 100)
    texts = [" ".join(f"w{i * 7919 + k}" for k in range(4000)) + " the end" * 50 for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = lm.fit(docs, F.lit(True), examples=5000, head=64)
    want = by_hand(fitted, texts, Counter(w for t in texts for w in lm.tokens(t.encode())))
    got = lm.scored(docs, fitted).collect()
    assert len(got) == 6 and all(r.score <= 0 and abs(r.score - want[r.doc_id]) < 1e-3 * abs(want[r.doc_id]) for r in got)


def test_equal_ids_start_from_a_bounded_sample(spark):
    docs = spark.createDataFrame([(5, f"one two three w{i % 90}") for i in range(2000)], "doc_id long, text string")
    fitted, _ = lm.counted(docs, F.lit(True))
    assert 50 < len(lm.sampled(docs, fitted.model, fitted.n_tokens, 400)) <= 400


def test_all_held_out(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = lm.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in rows)


def test_held_out_texts_score_better_than_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_position_trains(spark):
    r = random.Random(5)
    texts = [" ".join(w for _ in range(400) for w in [r.choice("abcdefgh")] for w in (w, w.upper() * 2)) for _ in range(400)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fitted = lm.fit(docs, F.lit(True), examples=20)
    model, n = fitted.model, fitted.n_tokens
    totals = np.array([fitted.counts[w] for w in model.core] + [0] * (len(model.bias) - len(model.core)), float)
    assert lm.trained(docs, model, totals, lm.untrained(totals))[1] == n == 800 * 400 + 402
    one, two, z = model.tables()
    u, v, w = np.concatenate([lm.contexts(model.classes(), lm.tokens((t or "").encode())) for t in texts]).T
    # A start of 20 positions knows nothing; that "aa" follows "a" is learnt from all the others.
    assert (one[u, w] + two[v, w] - z[u, v]).mean() > np.log(totals[w] / totals.sum()).mean() + 0.5
