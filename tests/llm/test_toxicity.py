import itertools
import math
import random
import time
import zlib

from papyrine.llm import toxicity as tx


def test_folding():
    assert tx.fold("1D10T") == tx.fold("idiot")
    assert tx.fold("іdіоt") == tx.fold("IDIOT")  # Cyrillic look-alikes
    assert tx.fold("stüpïd") == "stupid"
    assert tx.fold("l0$er") == tx.fold("loser")
    assert tx.fold("idiot!") == "idiot "


def lexicon():
    return tx.Lexicon({tx.fold("trash"): 5.0, tx.fold("loser"): 5.0}, ("trash can",), (-3.0, 3.0, 1.0))


def test_matches_are_whole_words_outside_exceptions():
    a = lexicon().automaton()
    found = lambda s: [w for _, _, w in tx.matches(a, tx.fold(s))]
    assert found("you L0SER") == [5.0]
    assert found("closers trashy") == []
    assert found("the trash can is full") == [] and found("trash, can") == [5.0]
    assert tx.matches(tx.Lexicon().automaton(), "anything") == []


def corpus(spark):
    good = [(i, f"you are such a kind friend number{i} of gardens day{i * 7}", "en", "a", 1) for i in range(200)]
    bad = [(1000 + i, f"you are such a {'clown' if i % 2 else 'm0ron'} number{i} of gardens day{i * 3}", "en", "a", 1) for i in range(120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in good + bad], "doc_id long, quality int, toxic int")


def test_learns_and_generalises(spark):
    docs, marks = corpus(spark)
    learnt = tx.learn(docs, marks)
    assert set(learnt.weights) == {tx.fold("clown"), tx.fold("moron")}
    rows = tx.score(docs, learnt).collect()
    assert all(r.predicted == (r.doc_id >= 1000) and 0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in rows)
    assert {r.held_out for r in rows} == {True, False}


def test_every_significant_word_is_a_term(spark):
    r = random.Random(9)
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=4), 0, 4050, 9)]
    plain = ["".join(x) for x in itertools.product("mnpqrsuv", repeat=3)]
    rows = [(i, " ".join(r.sample(plain, 60) + (r.sample(words, 225) if i < 150 else [])), int(i < 150)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(words) == 450 and set(tx.learn(docs, docs).weights) == {tx.fold(w) for w in words}


def test_copies_count_once(spark):
    long = " ".join(f"w{k}" for k in range(200))
    copies = [(i, f"{long} tail{i}") for i in range(50)]
    others = [(100 + i, " ".join(f"v{(k * 31 + i * 7919) % 5003}" for k in range(100))) for i in range(20)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string")
    assert sorted(r.doc_id for r in tx.distinct_texts(docs.selectExpr("doc_id", "text", "1 AS label")).collect()) == [0, *range(100, 120)]


def test_edge_cases(odd, none, marks, spark):
    learnt = tx.learn(odd, marks)
    rows = tx.score(odd, learnt).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in odd.collect()] and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert tx.learn(none, marks).weights == {} and tx.score(none, tx.Lexicon()).count() == 0
    assert all(r.predicted == 0 for r in tx.score(odd, tx.learn(odd, marks.where("false"))).collect())


def plainly(lexicon, text):
    """Matches place by place: every term at every place, whole words only, outside all exception phrases."""
    folded = tx.fold(text)
    word = lambda a, b: (a == 0 or not folded[a - 1].isalnum()) and (b == len(folded) or not folded[b].isalnum())
    at = lambda x: [(a, a + len(x)) for a in range(len(folded)) if folded.startswith(x, a) and word(a, a + len(x))]
    spared = [s for e in lexicon.exceptions for s in at(tx.fold(e))]
    return sorted((a, b, w) for term, w in lexicon.weights.items() for a, b in at(term) if not any(x <= a and b <= y for x, y in spared))


def test_matcher_and_score_against_brute_force(spark):
    r = random.Random(13)
    lexicon = tx.Lexicon({tx.fold(t): w for t, w in (("trash", 4.0), ("loser", 2.5), ("can", 1.0), ("you fool", 3.0), ("fool", 2.0))}, ("trash can", "can you", "no fool can"), (-3.0, 2.0, 0.7))
    parts = ["trash", "TR4SH", "can", "you", "fool", "f00l", "loser", "l0$er", "closer", "no", ",", "!", ".", "é", "xcan", "\n", "\u0441an"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randint(0, 25))) for _ in range(600)] + ["", None]
    a = lexicon.automaton()
    for t in texts:
        assert sorted(tx.matches(a, tx.fold(t or ""))) == plainly(lexicon, t or "")
    rows = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        found = plainly(lexicon, text)
        total = sum(w for *_, w in found)
        x = -3.0 + 2.0 * math.log1p(total) + 0.7 * math.log1p(100 * total / max(1, len(text.split())))
        assert abs(row.score - 1 / (1 + math.exp(-x))) < 1e-9 and row.n_matches == len(found) and row.predicted == (row.score >= 0.5)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_many_exceptions_cost_little():
    a = tx.Lexicon({"trash": 1.0}, ("trash can",)).automaton()
    began = time.time()
    assert len(tx.matches(a, "trash can, trash " * 40_000)) == 40_000
    assert time.time() - began < 5
