from collections import Counter

from papyrine.llm import quality


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    "a b c d e a b c d e f", "x " * 40, "one two\none two\n\n \t\none  two\n", "a b c d e f g", "a b c d e\x85a b c d e", "## $ |", "é é é é é é", "a b c d a b c d a b c d a", "\n".join(["same line here"] * 9), "A B! C? #x",
]


def test_counts(spark, odd):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for rows in (quality.measured(docs).collect(), quality.measured(odd).collect()):
        texts = dict(enumerate(TEXTS)) if len(rows) == len(TEXTS) else None
        for r, text in zip(rows, (texts.values() if texts else [x.text for x in odd.collect()]), strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text


def rows_of(spec):
    return [{"doc_id": i, "bad": bad, "part": i % 3, **{s: 0.0 for s in quality.STATISTICS}, **values} for i, (bad, values) in enumerate(spec)]


def test_decision_list_covers_in_order():
    junk = [(1, {"symbols_per_word": 1.0 + i / 50}) for i in range(40)] + [(1, {"capitals": 0.6 + i / 200, "symbols_per_word": 0.001}) for i in range(40)]
    good = [(0, {"symbols_per_word": 0.0, "capitals": i / 1000}) for i in range(200)]
    rules = quality.decision_list(rows_of(junk + good))
    fits = lambda r: any(all(c.holds(r) for c in rule) for rule in rules)
    assert 1 <= len(rules) <= 3 and all(fits(r) == bool(r["bad"]) for r in rows_of(junk + good))


def test_decision_list_without_both_kinds():
    assert quality.decision_list([]) == [] and quality.decision_list(rows_of([(1, {})] * 9)) == [] and quality.decision_list(rows_of([(0, {})] * 9)) == []
    assert quality.decision_list(rows_of([(1, {}), (0, {})] * 9)) == []  # nothing tells them apart


def test_judged_and_filtered(odd, none, marks):
    rules = [(quality.Condition("distinct_words", False, 0.05),)]
    judged = quality.judged(odd, rules).collect()
    for r, text in zip(judged, [x.text for x in odd.collect()], strict=True):
        words = brute(text)
        failed = words[0] < 10 or 100 * words[4] > 20 * words[0]
        assert r.base_failed == failed and (not failed or not r.kept)
    kept = quality.filtered(odd, rules)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in judged)
    assert quality.judged(none, rules).count() == 0 and quality.filtered(none, []).count() == 0
    assert quality.learn(none, marks) == [] and isinstance(quality.learn(odd, marks), list)
