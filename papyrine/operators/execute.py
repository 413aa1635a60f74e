"""Routed execution: engines by name, rounds over pending regions, a result cache, statistics.

An engine is a function from an iterator of pandas frames (region_id, type, content, ...) to frames of (region_id, content, html,
confidence, data); it is run by mapInArrow over the regions whose next method is its own, a frame for each piece of about a MB, and a
frame that fails gives its regions an error instead of failing the job. Every round cuts its lineage with a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as tx
from ..functions.udf import pieces
from . import routing
from .merge import best_attempts

EXTRACTION = "region_id string, content string, html string, confidence double, agreement double, error string"
Engine = Callable[[pd.DataFrame], pd.DataFrame]


def cache_key(method: Column, engine: Column, crop: Column, extra: Column) -> Column:
    """SRC-21."""
    return F.sha2(F.concat_ws("\x1f", method, engine, crop, extra), 256)


def cached(tasks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-11: tasks (key) found in the cache (key, value), with the value; and those that aren't."""
    return tasks.join(cache, "key"), tasks.join(cache, "key", "left_anti")


def merged_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new results; those of a key known already replace it."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new.dropDuplicates(["key"]))


def run_engine(tasks: DataFrame, engine: Engine) -> DataFrame:
    """EX-03: the engine over batches of tasks."""
    schema = to_arrow_schema(_parse_datatype_string(EXTRACTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in pieces(whole):
                batch = piece.to_pandas()
                try:
                    made = engine(batch)
                except Exception as e:  # one batch's failure is a result of its regions, to be escalated
                    made = pd.DataFrame({"region_id": batch["region_id"], "error": f"{type(e).__name__}: {e}"})
                made = made.reindex(columns=schema.names).astype(object)
                yield pa.RecordBatch.from_pandas(made.where(made.notna(), None), schema, preserve_index=False)

    return tasks.mapInArrow(run, EXTRACTION)


def planned(regions: DataFrame, available: tuple[str, ...]) -> DataFrame:
    """EX-01: regions (region_id, type, page_kind, area_ratio, text_layer, cells, full_page) with plan, note, step and status of
    an empty plan."""
    chars = F.length(F.coalesce("text_layer", F.lit("")))
    made = regions.withColumn("route", routing.plan(F.col("type"), F.col("page_kind"), F.col("area_ratio"), chars, F.col("cells"), F.col("full_page"), available))
    status = F.when(F.size("route.plan") > 0, None).when(F.col("route.drop"), "skipped").when(F.col("type").isin("chart", "image"), "unchecked").otherwise("needs_review")
    return made.withColumns({"plan": F.col("route.plan"), "note": F.col("route.note"), "step": F.lit(0), "status": status}).drop("route")


def judged(results: DataFrame) -> DataFrame:
    """FLT-10 on results joined with their regions (type, method, content, error, confidence, agreement, text_layer): `passed`,
    `outcome`, `score` and `issues`."""
    content = F.coalesce("content", F.lit(""))
    results = results.withColumns({"_content": tx.nfkc(content), "_layer": tx.nfkc(F.coalesce("text_layer", F.lit("")))})
    issues = (
        F.when(F.col("type") == "formula", routing.formula_issues(content))
        .when(F.col("type").isin("chart", "image", "table"), routing.number_issues(F.col("_content"), F.col("_layer"), F.trim("_layer") != ""))
        .otherwise(routing.text_issues(content, F.col("method"), F.col("confidence"), F.col("agreement"), F.array().cast("array<double>")))
    )
    # columns of their own: the verdict names its issues in many branches, which don't share what they compute
    made = results.withColumn("_issues", issues).withColumn("v", routing.verdict(F.col("type"), F.col("method"), content, F.col("error"), F.col("_issues"), F.col("confidence")))
    return made.withColumns({"passed": F.col("v.passed"), "outcome": F.col("v.status"), "score": F.round("v.score", 3), "issues": F.col("v.issues")}).drop("v", "_issues", "_content", "_layer")


def rounds(regions: DataFrame, engines: dict[str, Engine], last: tuple[str, ...] = ("vlm",)) -> tuple[DataFrame, DataFrame]:
    """EX-02, EX-04: (regions with their final attempt, all attempts). In each round every pending region tries its next method; the
    methods in `last` wait until no other is pending. At most as many rounds as there are methods, twice. Only the numbers of
    pending regions by method come to the driver."""
    tasks = planned(regions, tuple(engines)).checkpoint()
    columns = tasks.columns
    pending, attempts = tasks.where("size(plan) > 0"), None
    for _ in range(2 * len(engines)):
        now = pending.withColumn("method", F.element_at("plan", F.col("step") + 1))
        waiting = [r[0] for r in now.select("method").distinct().collect()]
        if not waiting:
            break
        methods = [m for m in waiting if m not in last] or waiting
        made = None
        for m in methods:
            own = now.where(F.col("method") == m)
            part = own.join(run_engine(own.select("region_id", "type", "text_layer", "method"), engines[m]), "region_id")
            made = part if made is None else made.unionByName(part)
        made = judged(made).checkpoint()
        attempts = made if attempts is None else attempts.unionByName(made)
        again = made.where(~F.col("passed") & (F.col("step") + 1 < F.size("plan"))).withColumn("step", F.col("step") + 1)
        pending = now.where(~F.col("method").isin(*methods)).select(*columns).unionByName(again.select(*columns)).checkpoint()
    if attempts is None:
        attempts = judged(tasks.where("false").withColumn("method", F.lit("")).selectExpr("*", "'' AS content", "'' AS html", "1D AS confidence", "1D AS agreement", "'' AS error"))
    return finished(tasks, attempts), attempts


def finished(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Regions with the attempt that counts (the last if it passed, else the first of the best score), all attempts in order, and
    the status: that of the attempt, unchecked for a figure whose attempts all failed, or that of the empty plan."""
    best = best_attempts(attempts.select("region_id", "step", "passed", "score"), ["region_id"])
    every = attempts.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("step", "method", "passed", "score", "confidence", "issues"))).alias("attempts"))
    final = attempts.select("region_id", "step", "method", "content", "html", "confidence", "issues", "outcome").join(best.select("region_id", "step"), ["region_id", "step"])
    made = tasks.drop("step").join(final.drop("step"), "region_id", "left").join(every, "region_id", "left")
    status = F.when(F.col("status").isNotNull(), F.col("status")).when((F.col("outcome") == "needs_review") & F.col("type").isin("chart", "image"), "unchecked").otherwise(F.col("outcome"))
    return made.withColumn("status", status).drop("outcome")


def statistics(regions: DataFrame, doc: str = "doc", price: float = 0.0) -> DataFrame:
    """AG-01: of each document: regions, escalations (several attempts), those to review, and calls of the last-resort method."""
    n = F.coalesce(F.size("attempts"), F.lit(0))
    calls = F.size(F.filter("attempts", lambda a: a.method == "vlm"))
    return regions.groupBy(doc).agg(F.count(F.lit(1)).alias("regions"), F.count_if(n > 1).alias("escalations"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.sum(F.greatest(calls, F.lit(0))).alias("vlm_calls"), F.round(F.sum(F.greatest(calls, F.lit(0))) * price / 1e6, 6).alias("estimated_cost"))


def route_log(regions: DataFrame) -> DataFrame:
    """SNK-03: one JSON line for each region."""
    features = F.struct("type", "page_kind", "area_ratio", "cells", "full_page")
    return regions.select(F.to_json(F.struct(F.lit("rules-v1").alias("router"), "region_id", features.alias("features"), "plan", "attempts", F.col("method").alias("final_method"), "status")).alias("value"))
