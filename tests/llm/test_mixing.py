import random

from papyrine.llm import mixing


def poured(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess by weight until no source is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, shares = total - sum(fixed.values()), sum(weight[s] for s in rest)
        target = {s: left * weight[s] / shares for s in rest} | fixed
        above = [s for s in rest if target[s] > most * sizes[s] + 1e-9]
        if not above:
            return target
        fixed |= {s: most * sizes[s] for s in above}


def table(spark, sizes):
    return spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")


def test_targets(spark):
    r = random.Random(1)
    for case in [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 5}, {"a": 0, "b": 0}, {"a": 0, "b": 10}, {"only": 7}, *({f"s{i}": r.choice([0, 1, 5, 50, 5000, 10**6]) for i in range(r.randint(1, 9))} for _ in range(12))]:
        got = {x.source: x.target for x in mixing.targets(table(spark, case)).collect()}
        want = poured(case)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want), (case, got, want)
        assert abs(sum(got.values()) - sum(case.values())) < 1e-6 * (1 + sum(case.values()))


def test_sizes(odd):
    rows = odd.select("text", mixing.size_of("text").alias("n")).collect()
    assert all(r.n == len((r.text or "").encode().split()) for r in rows)


def corpus(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 10, 40])), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_is_near_the_target_and_repeats(spark):
    docs = corpus(spark)
    first, again = mixing.taken(docs).collect(), mixing.taken(docs.repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 1200
    sources = {r.doc_id: r.source for r in docs.collect()}
    by = {}
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        x = by.setdefault(sources[r.doc_id], [r.target, 0, r.source_size, 0])
        x[1] += r.taken
        x[3] += r.size
    for target, got, size, summed in by.values():
        assert size == summed and abs(got - target) <= max(80, 0.05 * target)


def test_mix_emits_copies(spark):
    docs = corpus(spark)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.taken(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(taken[i][0] == taken[i][1] * times.get(i, 0) for i in taken)


def test_edge_cases(odd, none):
    rows = mixing.taken(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_ranks_follow_class_and_hash_in_buckets_of_any_size(spark):
    r = random.Random(2)
    rows = [(f"k{r.randint(0, 1)}", r.choice([0, 1, 2, 3, 17, 19, 900]), f"{r.getrandbits(128):032x}", r.choice([1, 1, 5])) for _ in range(900)]
    table = spark.createDataFrame(rows, "key string, size long, hash string, n long")
    place = lambda x: (x[0], len(bin(x[1])), (bin(x[1])[2:] + "000")[:4], x[2])
    want, seen = {}, {}
    for x in sorted(rows, key=place):
        want[x[2]] = seen.get(x[0], 0)
        seen[x[0]] = want[x[2]] + x[3]
    for bucket in (3, 4096):
        assert {x.hash: x.before for x in mixing.ranked(table, bucket).collect()} == want


def test_equal_rows_are_dealt_out(spark):
    """Equal ids, null ids and equal texts that are most of a source: no task has more than its share, and the mix is whole."""
    docs = spark.range(0, 20_000, 1, 8).selectExpr("if(id % 2 = 0, null, if(id % 3 = 0, id, 7L)) AS doc_id", "if(id % 5 = 0, '', 'some words here') AS text", "'s' AS source", "1 AS n_chars")
    few, dealt = mixing.taken(docs).collect(), mixing.taken(docs, chunk=1000)
    assert sorted(map(str, few)) == sorted(map(str, dealt.collect())) and len(few) == 20_000
    assert sum(r.taken for r in few) == sum(r.size for r in few)
    groups = mixing.planned(docs, 17, mixing.WEIGHTS, 3)
    assert groups.count() == docs.distinct().count()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, mixing.mix(docs, chunk=1000).collect())) == sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, docs.collect()))


def test_the_mix_takes_what_the_plan_says(spark):
    docs = corpus(spark)
    docs = docs.unionAll(docs.where("doc_id % 3 = 0")).withColumn("size", docs.doc_id % 7)
    taken, got = {}, {}
    for r in mixing.taken(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in mixing.mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
