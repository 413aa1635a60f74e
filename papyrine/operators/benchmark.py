"""Benchmark of conversion systems: ground truth pairs, scores, summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import metrics
from ..functions import text as tx

METRICS = ("cer", "cer_any_order", "wer", "word_f1", "teds", "teds_structure", "heading_f1", "ms_per_page", "vlm_calls_per_page", "cost_per_page", "needs_review_ratio")
#: Metrics of which the least is best.
LOW = ("cer", "cer_any_order", "wer", "ms_per_page", "vlm_calls_per_page", "cost_per_page", "needs_review_ratio")


def dataset(files: DataFrame, split: str | None = None) -> DataFrame:
    """SRC-13, JN-06: files (path below the root, with `text` for *.gt.md) to documents with their ground truth: stem, category ('-'
    if none) and split (a first folder dev or test)."""
    rows = files.withColumn("dir", F.regexp_extract("path", "^(.*/)?[^/]*$", 1)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    truth = rows.where(F.col("name").endswith(".gt.md")).select("dir", F.regexp_replace("name", r"\.gt\.md$", "").alias("stem"), F.col("text").alias("truth"))
    docs = rows.where(~F.col("name").endswith(".gt.md")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    own = first.isin("dev", "test")
    rest = F.array_join(F.when(own, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), "/")
    made = docs.join(truth, ["dir", "stem"]).select("path", "stem", F.when(own, first).alias("split"), F.when(rest == "", "-").otherwise(rest).alias("category"), "truth")
    return made.where(F.col("split") == split) if split else made


def sample(rows: DataFrame, per_category: int, key: str = "path") -> DataFrame:
    """WN-09: the first documents of each category by hash of the path."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy(F.sha1(key), key))).where(F.col("rn") <= per_category).drop("rn")


def scored(rows: DataFrame) -> DataFrame:
    """MT-10, MT-11: rows (truth, output, error, ...) with the text metrics; a failed document's output is empty."""
    return metrics.scored(rows, F.coalesce("truth", F.lit("")), F.when(F.col("error").isNull(), F.coalesce("output", F.lit(""))).otherwise(""))


def rescored(saved: DataFrame, truth: DataFrame) -> DataFrame:
    """MT-12, JN-13: saved outputs against the ground truth of today."""
    kept = saved.drop("truth", *METRICS[:4], "heading_f1")
    return scored(kept.join(truth.select("path", "truth"), "path"))


def mean4(c: str) -> Column:
    """MT-13: nulls don't count; all null is null."""
    return F.round(F.avg(c), 4)


def printed(c: Column) -> Column:
    """MT-13: a report's cell; null is '-'."""
    return F.coalesce(c.cast("string"), F.lit("-"))


def summary(rows: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """AG-07, AG-08: by category and (category null) overall: documents, pages, failures, and the mean of each metric."""
    present = [c for c in columns if c in rows.columns]
    return rows.groupingSets([["category"], []], "category").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[mean4(c).alias(c) for c in present])


def compared(reports: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """SNK-08, JN-14: reports (system, category, metrics) with each value printed, the best of a category in bold if there are
    several systems; null is '-'."""
    w = W.partitionBy("category")
    many = F.count(F.lit(1)).over(w) > 1
    out = reports
    for c in columns:
        best = (F.min(c) if c in LOW else F.max(c)).over(w)
        said = F.format_string("%.4f", F.col(c).cast("double"))
        out = out.withColumn(f"{c}_text", F.when(F.col(c).isNull(), "-").when(many & (F.col(c) == best), F.concat(F.lit("**"), said, F.lit("**"))).otherwise(said))
    return out


def line_scores(lines: DataFrame, keys: list[str]) -> DataFrame:
    """AG-13: lines (ref, hyp) to micro CER, exact lines, and recall of Vietnamese letters as bags of the whole set."""
    letter = F.lit(f"[{tx.TONED_1}{tx.TONED_2}{tx.VI_MARKS}]")
    base = lines.withColumn("_d", metrics.levenshtein(F.col("ref"), F.col("hyp"))).groupBy(*keys).agg((F.sum("_d") / F.sum(F.length("ref"))).alias("cer"), F.avg((F.col("ref") == F.col("hyp")).cast("double")).alias("line_accuracy"), F.count(F.lit(1)).alias("lines"))
    bag = lambda c, n: lines.select(*keys, F.explode(F.regexp_extract_all(c, letter, F.lit(0))).alias("ch")).groupBy(*keys, "ch").agg(F.count(F.lit(1)).alias(n))
    recall = bag("ref", "r").join(bag("hyp", "h"), [*keys, "ch"], "left").groupBy(*keys).agg((F.sum(F.least("r", F.coalesce("h", F.lit(0)))) / F.sum("r")).alias("vietnamese_letter_recall"))
    return base.join(recall, keys, "left")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AG-14: of each key, the row of the last file."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
