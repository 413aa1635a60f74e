"""Sinks: Markdown and JSON of documents, route logs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_json(documents: DataFrame) -> DataFrame:
    """SNK-02: each row as JSON without the Markdown and the pictures."""
    return documents.select(F.to_json(F.struct(*[c for c in documents.columns if c not in ("markdown", "figures")])).alias("value"))


def write_outputs(documents: DataFrame, path: str) -> None:
    """SNK-01: Markdown by stem as Parquet, and JSON lines."""
    documents.select("stem", "markdown").write.mode("overwrite").parquet(f"{path}/markdown")
    documents_json(documents).write.mode("overwrite").text(f"{path}/json")


def append_route_log(log: DataFrame, path: str) -> None:
    """SNK-03."""
    log.write.mode("append").text(path)


def write_manifest(items: DataFrame, path: str) -> None:
    """SNK-10: JSON lines in folders of split and category."""
    items.write.mode("overwrite").partitionBy("split", "category").json(path)


def resume_report(rows: DataFrame, key: str, path: str) -> None:
    """SNK-09: appends the rows whose key the report at path lacks, so that a run that was broken off goes on where it stood."""
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)
