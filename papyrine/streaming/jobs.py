"""Streams: an inbox of files, job states, deduplication, windows, and an upserted manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def inbox(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """STR-01, STR-04: new files of a folder as (path, content, sha256, arrived)."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("arrived"))


def new_documents(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """STR-03: each content once within the delay."""
    return files.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sha256"])


def run_jobs(files: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """STR-01: every batch's documents through `work`; results and job rows (path, batch, state, error) are written once for each batch
    number, so a batch that is run again replaces its own files. A failed batch is recorded and doesn't stop the stream."""

    def each(batch: DataFrame, number: int) -> None:
        state, error = "done", None
        try:
            work(batch).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        except Exception as e:
            state, error = "failed", f"{type(e).__name__}: {e}"[:500]
        jobs = batch.select("path", F.lit(state).alias("state"), F.lit(error).cast("string").alias("error"))
        jobs.write.mode("overwrite").json(f"{out}/jobs/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """STR-02: rows appended as JSON lines, each once."""
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upserted(known: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """STR-03: the manifest with new rows; of a key the row of the highest version stays, new before known."""
    rows = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "_new")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("x")).select(key, "x.*")


def event_windows(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Tumbling windows by event type; with `late`, a stream that drops later rows."""
    rows = events.withWatermark("ts", late) if late else events
    made = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows of each user."""
    made = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def within_budget(rows: DataFrame, order: list[str], size: str, budget: int, groups: str) -> DataFrame:
    """STR-05: the rows, in order within each group, before the sum of their sizes passes the budget."""
    from pyspark.sql import Window as W

    w = W.partitionBy(groups).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")
