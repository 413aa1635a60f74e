"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets share out the total size by weight; none exceeds `most` times its source's size, and what is above goes to the others by
weight (the sources with the least room for their weight are the ones at their bound). A source's rate is its target over its
size: the expected copies of each of its documents. The prefix sum of these within the source, shifted by one random
offset of the source, crosses an integer once for each copy to emit; as documents are taken in the order of their size, the
words taken follow the target closely.

A source is never one group. Rows of one source and id with equal texts are counted together first; what is left is ordered by
size class (eight to an octave) and a hash of id and text, and ranked within buckets of a class and as many first digits of the
hash as make a bucket some BUCKET groups, however large the class is. The counts of a class's buckets and of a source's at most 512
classes are summed up in turn to give the rank before each bucket. All this is done on narrow rows; texts are read once for it and
once more for the mix, whose rows meet their copies by hash. The table of sources itself (one row for each) is ordered in one task:
a mix names its sources.

Edge cases: null texts have size 0; a null source is a source of its own, last in the order; sources of size 0 have target 0 and
nothing is taken from them; an empty table gives no rows; very long texts are whole; rows with null or repeated doc_id are each a
document; equal sizes are ordered by hashes of id and text, and rows that are the same in these take the ranks one after the other;
the mix keeps all columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Groups that a bucket holds, and equal rows that a task gives out at once.
BUCKET, CHUNK = 4096, 1 << 16


def size_of(text: str) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def offset_of(source: str, seed: int) -> Column:
    """A uniform number in [0, 1) in steps of 2^-20 from the source's name, and 'null' apart from null."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 5), 16, 10).cast("long") / F.lit(float(1 << 20))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target; sizes: one row (source, source_size) for each source. In the order of bound over weight, the
    sources at their bound come first; the first one with room for its share of what those before it leave ends them."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    each = sizes.withColumn("place", place)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("long"))
    each = each.withColumn("bound", F.col("source_size") * most).withColumn("ratio", F.col("bound") / F.col("weight"))
    order = W.orderBy("ratio", "place")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    for name, column, total in (("left", "bound", "source_size"), ("shares", "weight", "weight")):
        each = each.withColumn(name, F.sum(total).over(whole) - F.coalesce(F.sum(column).over(before), F.lit(0)))
    each = each.withColumn("level", F.col("left").cast("double") / F.col("shares"))
    each = each.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.col("level") * F.col("weight")
    return each.select("source", "source_size", F.least(F.col("bound").cast("double"), F.coalesce(share, F.col("bound").cast("double"))).alias("target"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _hash(doc_id: str, text: str) -> Column:
    named = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.md5(named.cast("binary"))


def _class(size: str) -> Column:
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 1, 4), 4, "0"))


def ranked(groups: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """groups (key, size, hash, n, ...) with `before`: the documents of the key in the groups before it, in the order of size class
    and hash. Groups of one hash follow each other in any order."""
    groups = groups.withColumn("class", _class("size"))
    preceding = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    classes = groups.groupBy("key", "class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("groups") / bucket) / 4)).cast("int")
    classes = classes.select("key", "class", digits.alias("digits"), F.coalesce(F.sum("n").over(preceding("key", "class")), F.lit(0)).alias("in_key"))
    # a class may hold most groups, so it meets its row by a digit of the hash too
    salted = classes.withColumn("digit", F.explode(F.array(*map(F.lit, "0123456789abcdef"))))
    dealt = groups.withColumn("digit", F.substring("hash", 32, 1)).join(salted, ["key", "class", "digit"]).drop("digit").withColumn("prefix", F.substring(F.col("hash"), F.lit(1), F.col("digits")))
    buckets = dealt.groupBy("key", "class", "prefix").agg(F.sum("n").alias("n"))
    buckets = buckets.select("key", "class", "prefix", F.coalesce(F.sum("n").over(preceding("key", "class", "prefix")), F.lit(0)).alias("in_class"))
    within = dealt.withColumn("in_bucket", F.coalesce(F.sum("n").over(preceding("key", "class", "prefix", "hash")), F.lit(0)))
    made = within.join(buckets, ["key", "class", "prefix"]).withColumn("before", F.col("in_key") + F.col("in_class") + F.col("in_bucket"))
    return made.drop("class", "digits", "prefix", "in_key", "in_class", "in_bucket")


def planned(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int, extra: list[Column] = ()) -> DataFrame:
    """One row for each group of rows of docs with equal source, id and text (and `extra`): key, id, size, hash, n, before,
    source_size, target, rate and offset."""
    narrow = docs.select(_key("source").alias("key"), "source", F.col("doc_id").alias("id"), size_of("text").alias("size"), _hash("doc_id", "text").alias("hash"), *extra)
    small = written(narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = small.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = targets(sources.select("source", "source_size"), weights, most)
    sources = sources.select(_key("source").alias("key"), "source_size", "target", offset_of("source", seed).alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    return ranked(small.drop("source")).join(sources, "key")


def _crossed(first: Column, last: Column) -> Column:
    """Integers that the shifted prefix sum crosses from rank `first` to `last`."""
    return F.floor(last * F.col("rate") + F.col("offset")) - F.floor(first * F.col("rate") + F.col("offset"))


def _one_by_one(rows: DataFrame, n: str, at: str, chunk: int) -> DataFrame:
    """Each row n times, numbered 1 to n by `at`; a row of many is dealt out to tasks in chunks."""
    few, many = rows.where(F.col(n) <= chunk), rows.where(F.col(n) > chunk)
    starts = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / chunk))
    dealt = many.withColumn("chunk", F.explode(starts)).repartition("hash", "chunk")
    dealt = dealt.withColumn(at, F.explode(F.sequence(F.col("chunk") * chunk + 1, F.least(F.col(n), (F.col("chunk") + 1) * chunk)))).drop("chunk")
    return few.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).unionByName(dealt)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its copies. Of rows that are wholly equal one stands for all in the
    shuffle and is given out as often as all of them are taken."""
    same = F.xxhash64(*docs.columns).alias("same")
    plan = planned(docs, seed, weights, most, [same]).withColumn("copies", F.least(_crossed(F.col("before"), F.col("before") + F.col("n")), F.col("n") * most).cast("long"))
    plan = written(plan.where("copies > 0").select("hash", "same", "copies"), "copies")
    whole = docs.select(F.struct("*").alias("row"), _hash("doc_id", "text").alias("hash"), same)

    def emitted(plan: DataFrame, by_chunk: bool) -> DataFrame:
        rows = whole.join(plan.select("hash", "same"), ["hash", "same"], "left_semi") if by_chunk else whole
        joined = rows.groupBy("hash", "same").agg(F.first("row").alias("row")).join(plan, ["hash", "same"])
        if not by_chunk:
            return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row")
        return _one_by_one(joined, "copies", "at", chunk).select("row")

    made = emitted(plan.where(F.col("copies") <= chunk), False)
    many = plan.where(F.col("copies") > chunk)
    return (made if many.isEmpty() else made.unionAll(emitted(many, True))).select("row.*")


def taken(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs; texts aren't shuffled."""
    plan = written(planned(docs, seed, weights, most), "ranks")
    rank = F.col("before") + F.col("at")
    copies = F.least(_crossed(rank - 1, rank), F.lit(most))
    return _one_by_one(plan, "n", "at", chunk).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS bound FROM sources),
ordered AS (
  SELECT *, bound / weight AS ratio FROM weighed),
shared AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(bound) OVER w, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS own_level
  FROM ordered WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, (SELECT arg_min(own_level, (ratio, place)) FROM shared WHERE own_level <= ratio) AS level FROM shared),
targets AS (
  SELECT source, source_size, least(CAST(bound AS DOUBLE), coalesce(level * weight, CAST(bound AS DOUBLE))) AS target,
    CAST('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS shift FROM levelled),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || rpad(substr(bin(size), 1, 4), 4, '0'), hash) AS rank FROM sized)
SELECT doc_id, size, source_size, target,
  CAST(size * least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), 3) AS BIGINT) AS taken
FROM (SELECT r.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
"""
