"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: each text, A-Z lower-cased, is cut into words; every run of `shingle` words (repeats included) is hashed with
XXH64, and a bit of the fingerprint is 1 if more than half the hashes have it.

Links: equal fingerprints are first reduced to one row. Two fingerprints that differ in at most `bits` bits agree wholly on at
least one of `bits` + 1 (or on `share` of `bits` + `share`) parts of the word, so each fingerprint goes to one bucket for each
choice of parts and meets all its partners there. A bucket with more than `cell` fingerprints is dealt out to cells, one for
each pair of its slices, so none of its pairs is lost and no task gets all of it. Within its buckets a task sorts the
fingerprints by Gray rank, and builds a tree over the sorted runs: a node keeps the mask of the bits that all its fingerprints
share and their values, and its parent's bits are factored out of it. A search goes down the tree adding up the bits in which
the query differs from each node's own pattern and drops a whole group once the sum exceeds `bits`. Only the links that join
two groups of a cell not joined before are given out, at most one less than the cell's fingerprints.

A bucket whose fingerprints are joined already is not searched pair by pair: neighbours in Gray order are joined first, and a search
passes over nodes whose fingerprints all belong to the query's group.

A check can be asked for, `check` = (words, similarity): each text then also has a code of 256 bits over shingles of so many words,
and fingerprints are linked only if these codes differ in no more bits than texts of that similarity (shared over all shingles) do,
give or take one standard error. The fingerprint then only has to find candidates, so it can have shorter shingles and more bits.

Components: alternating star contraction over the links, each round cut from its lineage by a checkpoint in the shared folder.
Nothing about single documents is collected; the driver sees one count for each round.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; very long texts are whole, a block of hashes
at a time; a bit that exactly half the hashes have is 0; rows with a null doc_id have a fingerprint and the component of their
fingerprint, but don't name it (the component is null if no member has an id); repeated rows stay, and representatives() keeps one of
them; of equal ids in a group it keeps the row with the least hash of its text; an empty table gives no rows; further columns of docs,
whatever their names, are not used, and representatives() hands them on.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shared_dir

FANOUT = 8
#: Places where a node of many links meets its least neighbour.
SALTS = 16
#: A key of more than one row in so many is joined by a broadcast list; there are fewer than that many such keys.
SHARE = 1024
#: Bits of the code of a check.
WIDE = 256
#: Pairs of a query and a node that a search holds at once.
FRONTIER = 1 << 20
#: Fingerprints in buckets that a task works on at once.
STEP = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def wide_code(text: bytes | None, shingle: int) -> bytes:
    """256 bits: which are set in over half of the shingles' hashes; each hash of 64 bits is mixed to four."""
    import xxhash

    words = (text or b"").lower().split()
    some = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in some], np.uint64)
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        lanes = hashes[at : at + (1 << 14), None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            lanes = (lanes ^ (lanes >> np.uint64(shift))) * np.uint64(factor)
        ones += np.unpackbits((lanes ^ (lanes >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def differing(similarity: float) -> int:
    """Bits of WIDE in which codes of texts with that share of common shingles differ: their cosine is 2s / (1 + s); one standard
    error more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(WIDE * p + math.sqrt(WIDE * p * (1 - p)))


def fingerprints(docs: DataFrame, shingle: int = 4, check: int | None = None) -> DataFrame:
    """doc_id, `text_hash` (of the text as it is) and `fp`, the fingerprint's bits as a (signed) long; with `check`, also `wide`, the
    code over shingles of so many words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py(), shingle) for x in texts], np.uint64)
            wide = [] if check is None else [pa.array([wide_code(x.as_py(), check) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64), pa.int64()), *wide], names=["doc_id", "text_hash", "fp", "wide"][: 3 + len(wide)])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long" + (", wide binary" if check else ""))


# --- the index of a task ---------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over the codes of several groups; a search stays within its group.

    codes must be sorted by (group, Gray rank). levels[0] is the codes themselves; a node of the next level covers a run of up
    to FANOUT nodes of one group, until each group has one root. Of a node, `own` is the mask of the bits shared by all of its
    codes that its parent doesn't share already, and `value` its codes' bits.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        full = np.uint64(2**64 - 1)
        self.levels = []
        value, shared = codes, np.full(len(codes), full)
        first = np.arange(len(codes))  # of each node's children, at the level below
        last = first + 1
        while True:
            node = {"value": value, "shared": shared, "group": group, "first": first, "last": last}
            self.levels.append(node)
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            if len(edge) == len(group):
                break
            size = np.diff(np.r_[edge, len(group)])
            place = np.arange(len(group)) - np.repeat(edge, size)
            first = np.flatnonzero(place % FANOUT == 0)
            last = np.r_[first[1:], len(group)]
            ones = np.bitwise_and.reduceat(value & shared, first)
            zeros = np.bitwise_and.reduceat(~value & shared, first)
            value, shared, group = ones, ones | zeros, group[first]
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            low["own"] = low["shared"] & ~np.repeat(high["shared"], high["last"] - high["first"])
        self.levels[-1]["own"] = self.levels[-1]["shared"]

    def settle(self, label: np.ndarray) -> None:
        """Notes the codes' labels: `one` of a node is the label that all codes under it have, or -1."""
        self.levels[0]["one"] = label
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            least, most = np.minimum.reduceat(low["one"], high["first"]), np.maximum.reduceat(low["one"], high["first"])
            high["one"] = np.where(least == most, least, -1)

    def within(self, queries: np.ndarray, root: np.ndarray, bits: int, beyond: np.ndarray | None = None, label: np.ndarray | None = None, own: np.ndarray | None = None):
        """Blocks (query's number, code's place) of all codes under the query's root at most `bits` bits away; with `beyond`,
        only codes placed after it; with `label` (which the caller may change in between) and the queries' `own` places, only nodes
        of other labels. root is a place in the last level."""
        step, seen = max(1, FRONTIER // 4096), None
        for at in range(0, len(queries), step):
            if label is not None and (seen is None or not np.array_equal(seen, label)):
                seen = label.copy()
                self.settle(seen)
            yield from self._search(queries, np.arange(at, min(at + step, len(queries))), root, bits, beyond, own)

    def _search(self, queries, number, root, bits, beyond, own=None):
        node, top = root[number], self.levels[-1]
        far = np.bitwise_count((queries[number] ^ top["value"][node]) & top["own"][node]).astype(np.int16)
        stack = [(len(self.levels) - 1, number, node, far)]
        while stack:
            level, number, node, far = stack.pop()
            near = far <= bits
            if own is not None:
                near &= self.levels[level]["one"][node] != self.levels[0]["one"][own[number]]
            number, node, far = number[near], node[near], far[near]
            if not level:
                if beyond is not None:
                    near = node > beyond[number]
                    number, node = number[near], node[near]
                if len(number):
                    yield number, node
                continue
            here, low = self.levels[level], self.levels[level - 1]
            n = here["last"][node] - here["first"][node]
            if n.sum() > FRONTIER and len(node) > 1:
                half = len(node) // 2
                stack += [(level, number[:half], node[:half], far[:half]), (level, number[half:], node[half:], far[half:])]
                continue
            child = np.repeat(here["first"][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            number = np.repeat(number, n)
            far = np.repeat(far, n) + np.bitwise_count((queries[number] ^ low["value"][child]) & low["own"][child])
            stack.append((level - 1, number, child, far))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the labels of a's and b's items in place; which links were needed for it."""
    used = np.zeros(len(a), bool)
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not open_.size:
            return used
        low, high = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        order = np.lexsort((low, high))
        firsts = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        to = np.arange(len(label))
        to[high[firsts]] = low[firsts]  # every root points to one lower root: no cycle
        used[open_[firsts]] = True
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def links_of_cells(cell: np.ndarray, side: np.ndarray, codes: np.ndarray, bits: int, wide: np.ndarray | None = None, far: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of every cell, as places of the rows given. side: 0 a cell whose pairs all count; 1 and 2 the two slices of a
    cell of which only pairs across count. wide (rows x 4): codes that may differ in `far` bits at most. The same row isn't in a cell
    twice."""
    order = np.lexsort((gray_rank(codes), side, cell))
    if not len(cell):
        return order, order
    cell, side, codes = cell[order], side[order], codes[order]
    wide = None if wide is None else wide[order]
    group = np.cumsum(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]) - 1

    def similar(a, b):
        return np.ones(len(a), bool) if wide is None else np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) <= far

    index = GrayIndex(codes, group)
    start = np.searchsorted(group, np.arange(group[-1] + 1))
    partner = np.where(side[start] == 0, np.arange(len(start)), -1)
    pair = np.flatnonzero((side[start] == 1) & np.r_[(side[start[1:]] == 2) & (cell[start[1:]] == cell[start[:-1]]), False])
    partner[pair] = pair + 1
    target, beyond = partner[group], np.arange(len(codes))
    asks = np.flatnonzero(target >= 0)
    label = np.arange(len(codes))
    out_a, out_b = [], []

    def join(a, b):
        like = similar(a, b)
        a, b = a[like], b[like]
        needed = _joined(label, a, b)
        out_a.append(order[a[needed]])
        out_b.append(order[b[needed]])

    for shift in (1, 2):  # neighbours in Gray order first
        a = np.flatnonzero((group[shift:] == group[:-shift]) & (side[shift:] == 0))
        a = a[np.bitwise_count(codes[a] ^ codes[a + shift]) <= bits]
        join(a, a + shift)
    for number, place in index.within(codes[asks], target[asks], bits, beyond[asks], label, asks):
        join(asks[number], place)
    none = np.zeros(0, order.dtype)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


# --- the plan --------------------------------------------------------------------------------------------------------


def part_masks(bits: int, share: int) -> list[int]:
    """One mask for each choice of `share` of `bits` + `share` parts of a 64-bit word: codes within `bits` bits agree on one."""
    n = bits + share
    edges = [64 * i // n for i in range(n + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, share)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _node() -> Column:
    """A fingerprint and its wide code as one binary value."""
    return F.concat(F.unhex(F.lpad(F.hex("fp"), 16, "0")), F.col("wide"))


def _met(many: DataFrame, one: DataFrame, key: list[str], total: int) -> DataFrame:
    """many joined with one, which has one row for each key (null: a key too), and in `n` how many rows of many that key has, in all
    not more than `total`. Keys of more than one row in SHARE are fewer than SHARE, so their rows of one are broadcast and those of many
    stay where they are; the others are shuffled, and none of them is large."""
    one = one.withColumnsRenamed({c: f"met_{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"met_{c}")) for c in key]
    large = F.col("n") * SHARE > total
    hot = F.broadcast(one.where(large))
    rest = many.join(hot, same, "left_anti").join(one.where(~large), same)
    return many.join(hot, same).unionByName(rest).drop(*[f"met_{c}" for c in key])


def similar_links(codes: DataFrame, bits: int = 4, share: int = 2, cell: int = 4096, far: int | None = None, total: int | None = None) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints (`fp`), that connect what is within `bits` bits; each is itself
    within `bits` bits. codes: one row for each fingerprint. With `far`, codes has a column `wide` too, whose codes must be within
    `far` bits; one row for each pair of both, and the links are between values of _node(). total: the rows of codes, or more; counted
    if not given."""
    total = codes.count() if total is None else total
    wide = [] if far is None else ["wide"]
    masks = part_masks(bits, share)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_long(m)).alias("pattern")) for i, m in enumerate(masks)])
    dealt = codes.select("fp", *wide, F.explode(keys).alias("k")).select("fp", *wide, "k.part", "k.pattern")
    crowded = dealt.groupBy("part", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    slices = F.ceil(F.col("n") / cell).cast("int")
    # a fingerprint alone in its bucket has no partner there; each mask deals out every fingerprint once
    met = _met(dealt, crowded, ["part", "pattern"], total * len(masks))
    met = met.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("fp", *wide), F.col("slices")).cast("int"))
    other = F.sequence(F.lit(0), F.col("slices") - 1)
    met = met.select("fp", *wide, "part", "pattern", "own", F.explode(other).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    cells = met.select("fp", *wide, "part", "pattern", low.alias("low"), high.alias("high"), side.cast("byte").alias("side"))
    key = ("part", "pattern", "low", "high")
    cells = cells.select("fp", *wide, *key, "side").repartition(*key).sortWithinPartitions(*key)

    def linked(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        codes = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64) if wide else None
        a, b = links_of_cells(np.cumsum(new), rows.column("side").to_numpy(), fps, bits, codes, far or 0)
        if wide:
            nodes = lambda at: [x.tobytes() + y.tobytes() for x, y in zip(fps[at].byteswap(), codes[at], strict=True)]
            ends = [sorted(x) for x in zip(nodes(a), nodes(b), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in ends], pa.binary()) for i in (1, 0)], names=["a", "b"])
        a, b = fps[a].view(np.int64), fps[b].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches):
        held = None  # whole cells are worked on some STEP rows at a time; the cell that may go on waits
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= STEP:
                new = _starts(held, key)
                cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
                if cut:
                    yield linked(held.slice(0, cut), new[:cut])
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield linked(held, _starts(held, key))

    return cells.mapInArrow(run, "a binary, b binary" if wide else "a long, b long")


def _starts(rows: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """Whether a row of the sorted rows has another key than the one before."""
    new = np.zeros(rows.num_rows, bool)
    for c in key:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _with_least(seen: DataFrame, least: DataFrame) -> DataFrame:
    """seen (u, v) with u's m; a node with very many neighbours meets its row in SALTS places. Never by a broadcast: the table of
    nodes grows with the corpus."""
    salted = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return seen.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "salt"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: of each node, the neighbours (large: those above it, by its least neighbour; small: those below it and
    itself) are linked to the least. Minima are combined before the shuffle and joined back, so a hot node is never one group."""
    if large:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = _with_least(seen, least).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = seen.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(seen, least).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node can reach; roots aren't listed."""
    shared_dir(links.sparkSession)
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        now = _star(_star(now, large=True), large=False).checkpoint()
        # a star forest: every node has one parent, and no parent has one
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, share: int = 2, cell: int = 4096, check: tuple[int, float] | None = None) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint, with its wide code if there is a check, that stands for the component) and
    component_id (the least doc_id that links reach) of every row of docs."""
    shared_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle, check and check[0]).checkpoint()
    total = prints.count()
    key = ["fp", "wide"] if check else ["fp"]
    codes = prints.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", _node() if check else F.col("fp"))
    roots = components(similar_links(codes.select(*key), bits, share, cell, check and differing(check[1]), total))
    rooted = codes.join(roots, "node", "left").select(*key, "least", "copies", F.coalesce("root", "node").alias("root")).checkpoint()
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    members = _met(rooted, named, ["root"], total).select(*key, "root", "component_id", F.col("copies").alias("n")).checkpoint()
    return _met(prints, members, key, total).select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of the least doc_id (null last), then of the least hash of
    its text; of equal rows any one. Only ids and hashes are grouped; the texts move once, to be joined with the rows that stay."""
    rows = near_duplicates(docs, **how).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("x")).select("x.doc_id", "x.text_hash", "x.n")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    kept = _met(whole, first.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"}), ["own_id", "own_hash"], docs.count())
    once, again = kept.where("n = 1"), kept.where("n > 1")
    place = F.row_number().over(W.partitionBy("own_id", "own_hash").orderBy("own_hash"))
    return once.select("row").unionAll(again.withColumn("place", place).where("place = 1").select("row")).select("row.*")
