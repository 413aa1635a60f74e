import random

import numpy as np
import xxhash

from papyrine.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, bits=4):
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= bits
    label = np.arange(len(codes))
    while True:
        new = np.where(near, label[None], len(codes)).min(1)
        if (new == label).all():
            return label
        label = new


def balls(rng, n):
    """Codes in dense balls and chains, and lone ones."""
    out = set()
    for _ in range(6):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(n):
            y = x
            for b in rng.choice(64, int(rng.integers(0, 8)), replace=False):
                y ^= 1 << int(b)
            out.add(y)
            x = y if rng.random() < 0.1 else x
    return np.array(sorted(out), np.uint64)


def test_fingerprints():
    r = random.Random(1)
    for text in [None, "", " \n", "One", "a b c", "a b c d", "É é A a", *(" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 80))) for _ in range(100))]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_gray_rank_orders_neighbours_by_one_bit():
    n = np.arange(256, dtype=np.uint64)
    ordered = n[np.argsort(simhash.gray_rank(n))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_index_finds_all(spark):
    rng = np.random.default_rng(3)
    for _ in range(10):
        codes = balls(rng, 60)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        index = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64))
        for bits in (0, 2, 4):
            found = {(int(a), int(b)) for q, p in index.within(codes, np.zeros(len(codes), np.int64), bits) for a, b in zip(q, p, strict=True)}
            i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= bits)
            assert found == set(zip(i.tolist(), j.tolist(), strict=True))


def test_part_masks_meet_any_pair():
    for bits, share in ((4, 1), (4, 2), (3, 2)):
        masks = simhash.part_masks(bits, share)
        r = random.Random(5)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), bits):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_links_and_components_with_and_without_slices(spark):
    rng = np.random.default_rng(9)
    codes = balls(rng, 80)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    want = brute_components(codes)
    place = {int(x): i for i, x in enumerate(codes.view(np.int64))}
    for share, cell in ((1, 4096), (2, 4096), (1, 16)):
        roots = {r.node: r.root for r in simhash.components(simhash.similar_links(df, 4, share, cell)).collect()}
        got = [place[roots.get(int(x), int(x))] for x in codes.view(np.int64)]
        groups = lambda labels: sorted(map(sorted, {k: [i for i, v in enumerate(labels) if v == k] for k in set(labels)}.values()))
        assert groups(got) == groups(want.tolist())


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (200, 150)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100}
    assert simhash.components(links.where("false")).count() == 0


def test_operator(odd, none):
    rows = odd.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    labels = brute_components(fps)
    ids = {k: min((r.doc_id for r, v in zip(rows, labels, strict=True) if v == k and r.doc_id is not None), default=None) for k in set(labels.tolist())}
    got = simhash.near_duplicates(odd).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    want = sorted(((r.doc_id, f, ids[v]) for r, f, v in zip(rows, fps, labels.tolist(), strict=True)), key=key)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == want
    assert simhash.near_duplicates(none).count() == 0


def test_representatives(odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    rows = odd.collect()
    labels = brute_components([brute_fingerprint(r.text) for r in rows])
    got = kept.collect()
    assert len(got) == len(set(labels.tolist()))
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(min(r.doc_id for r, v in zip(rows, labels, strict=True) if v == k and r.doc_id is not None) for k in set(labels.tolist()) if any(r.doc_id is not None for r, v in zip(rows, labels, strict=True) if v == k))
    assert simhash.representatives(none).count() == 0


def test_large_keys_are_met_apart(spark):
    """A third of the rows of one key, a third of none, the others a row or two each: every row meets its key's row, once."""
    keys = [7] * 1000 + [None] * 1000 + [k // 2 for k in range(100, 1100)]
    many = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    sizes = {k: keys.count(k) for k in set(keys)}
    one = spark.createDataFrame([(k, f"of {k}", n) for k, n in sizes.items()] + [(5000, "absent", 1)], "k int, name string, n long")
    got = simhash._met(many, one, ["k"], len(keys))
    assert got.columns == ["i", "k", "name", "n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(i, k, f"of {k}", sizes[k]) for i, k in enumerate(keys)]


def test_large_groups_of_copies(spark):
    """Copies of one text, with and without ids, beside nulls and texts of their own."""
    texts = ["a text that many rows hold in whole " * 2] * 1200 + [None] * 700 + [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(300)]
    rows = spark.createDataFrame([(None if i % 3 == 0 else i, x, str(i)) for i, x in enumerate(texts)], "doc_id long, text string, n string")
    want = brute_components([brute_fingerprint(x) for x in texts])
    got = simhash.near_duplicates(rows)
    least = {k: min((i for i, v in enumerate(want) if v == k and i % 3), default=None) for k in set(want.tolist())}
    key = lambda t: (t[0] is None, t[0] or 0, t[1] is None, t[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=key) == sorted(((None if i % 3 == 0 else i, least[v]) for i, v in enumerate(want.tolist())), key=key)
    kept = simhash.representatives(rows).collect()
    assert len(kept) == len(set(want.tolist()))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(x for x in least.values() if x is not None)


def test_wide_codes():
    r = random.Random(3)
    for text in [None, "", "one", "a b c d e f", " ".join(r.choice("abcdefgh") for _ in range(90))]:
        words = (text or "").encode().split()
        ones = [0] * 256
        some = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
        for x in some:
            for lane in range(1, 5):
                z = (xxhash.xxh3_64_intdigest(x) + lane * 0x9E3779B97F4A7C15) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
                for b in range(64):
                    ones[64 * (lane - 1) + b] += z >> b & 1
        want = sum(1 << b for b in range(256) if 2 * ones[b] > len(some))
        assert int.from_bytes(simhash.wide_code(text and text.encode(), 5), "little") == want


def test_checked_components(spark):
    """Links need both codes; brute force over all pairs, in one cell and in slices."""
    rng = np.random.default_rng(12)
    codes = balls(rng, 70)
    wide = rng.integers(0, 2**63, (6, 4), dtype=np.int64).astype(np.uint64)[rng.integers(0, 6, len(codes))]
    wide ^= np.uint64(1) << rng.integers(0, 20, wide.shape).astype(np.uint64)
    far = 6
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 7) & (np.bitwise_count(wide[:, None] ^ wide[None]).sum(2) <= far)
    label = np.arange(len(codes))
    while not (label == (new := np.where(near, label[None], len(codes)).min(1))).all():
        label = new
    assert 6 < len(set(label.tolist())) < len(codes)
    df = spark.createDataFrame([(int(x), bytearray(y.tobytes())) for x, y in zip(codes.view(np.int64), wide, strict=True)], "fp long, wide binary").withColumn("node", simhash._node())
    node = {(r.fp, bytes(r.wide)): bytes(r.node) for r in df.collect()}
    for share, cell in ((2, 4096), (1, 16)):
        roots = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.similar_links(df.select("fp", "wide"), 7, share, cell, far)).collect()}
        got = [roots.get(n, n) for x, y in zip(codes.view(np.int64), wide, strict=True) for n in [node[int(x), y.tobytes()]]]
        groups = lambda labels: sorted(map(sorted, {k: [i for i, v in enumerate(labels) if v == k] for k in set(labels)}.values()))
        assert groups(got) == groups(label.tolist())


def test_settled_nodes_are_passed_over():
    rng = np.random.default_rng(7)
    codes = balls(rng, 90)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    root, place = np.zeros(len(codes), np.int64), np.arange(len(codes))
    index = simhash.GrayIndex(codes, root)
    label = np.array(brute_components(codes))
    assert not any(len(q) for q, _ in index.within(codes, root, 4, place, label, place))
    a, b = simhash.links_of_cells(np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int8), codes, 4)
    assert len(a) == len(codes) - len(set(label.tolist()))


def test_recall_of_checked_near_copies(spark):
    """Five-word similarity of 0.8 and more, against brute force over all pairs; what is below 0.6 stays apart."""
    r = random.Random(21)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(120, 400))]
        texts += [base] + [[w if r.random() > p else r.choice(words) for w in base] for p in (0.005, 0.01, 0.018, 0.15)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    some = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    like = lambda a, b: len(some[a] & some[b]) / len(some[a] | some[b])
    group = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs, shingle=2, bits=7, check=(5, 0.8)).collect()}
    near = [(a, b) for g in range(0, 200, 5) for a in range(g, g + 5) for b in range(a) if b >= g and like(a, b) >= 0.8]
    found = sum(group[a] == group[b] for a, b in near)
    assert len(near) > 80 and found >= 0.9 * len(near), (found, len(near))
    apart = [g + 4 for g in range(0, 200, 5)]
    assert all(group[a] == a for a in apart if all(like(a, b) < 0.6 for b in range(a - 4, a)))
