"""Tables of a folder, and the views that give the engine's operators relational inputs: boxes of pages from lineitem, attempts from
events, a manifest from documents. Each view has the same arithmetic in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_engine


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        workers_find_engine(self.spark)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def boxes(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "image").when(F.col("l_linestatus") == "O", "text").otherwise("caption")
        x0, y0 = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") * 7 % 700).cast("double")
        return self.lineitem.select(
            F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), kind.alias("type"), x0.alias("x0"), y0.alias("y0"),
            (x0 + F.col("l_quantity") * 4 + 10).alias("x1"), (y0 + F.col("l_quantity") * 2 + 5).alias("y1"), F.round(1 - F.col("l_discount"), 4).alias("score"), "l_partkey",
        )

    @property
    def attempts(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("region"), F.col("event_id").alias("step"), F.col("event_type").alias("method"), F.round("value", 3).alias("score"), (F.col("value") > 50).alias("passed"), "ts")

    @property
    def manifest(self) -> DataFrame:
        pages = (F.floor(F.col("n_chars") / 500) + 1).cast("int")
        kind = F.when(F.col("n_chars") > 2000, "digital").when(F.col("n_chars") > 800, "mixed").otherwise("scan")
        doc_type = F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))
        return self.documents.select(
            "doc_id", F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("company"), F.col("lang").alias("language"),
            pages.alias("pages"), kind.alias("kind"), doc_type.alias("doc_type"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("origin"), F.sha2("text", 256).alias("sha256"),
            F.when(F.col("lang") == "en", "VN").otherwise("JP").alias("country"),
        )


BOXES = """boxes AS (
  SELECT l_orderkey AS page, l_linenumber AS idx, CASE WHEN l_returnflag = 'A' THEN 'table' WHEN l_returnflag = 'R' THEN 'image' WHEN l_linestatus = 'O' THEN 'text' ELSE 'caption' END AS type,
    CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0, CAST(l_partkey % 400 AS DOUBLE) + l_quantity * 4 + 10 AS x1,
    CAST(l_suppkey * 7 % 700 AS DOUBLE) + l_quantity * 2 + 5 AS y1, round(1 - l_discount, 4) AS score, l_partkey FROM lineitem)"""
ATTEMPTS = "attempts AS (SELECT user_id AS region, event_id AS step, event_type AS method, round(value, 3) AS score, value > 50 AS passed, ts FROM events)"
MANIFEST = """manifest AS (
  SELECT doc_id, 'https://example.com/' || source || '/' || doc_id AS url, source AS company, lang AS language, CAST(floor(n_chars / 500) + 1 AS INT) AS pages,
    CASE WHEN n_chars > 2000 THEN 'digital' WHEN n_chars > 800 THEN 'mixed' ELSE 'scan' END AS kind, 't' || (doc_id % 5) AS doc_type, 's' || (doc_id % 3) AS origin, sha256(text) AS sha256,
    CASE WHEN lang = 'en' THEN 'VN' ELSE 'JP' END AS country FROM documents)"""
