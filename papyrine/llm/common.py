"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_engine

#: ASCII white space; bytes.split() with no argument cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_find_engine(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold_of(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs on one machine (tests), a
    temporary folder is used; on a cluster that is an error, as each executor would write to its own disk. The context's checkpoint
    folder is then set to the same place."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="papyrine-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM has gone; the shared folder outlives it and is emptied by its owner
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and executors can be lost without
    recomputing it. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyrine-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def hash_below(expected: int, distinct: int) -> int:
    """A bound of signed 64-bit hashes below which, of so many distinct ones, some 4 * expected + 100 lie: enough for the `expected`
    least ones, and few to put in order."""
    return min((1 << 64) - 1, (4 * expected + 100 << 64) // max(1, distinct)) - (1 << 63)


def bounded_sample(df: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    """The `rows` rows of the smallest hash of the key, the same in every run; df has n rows of distinct keys, narrow ones, as one task
    puts those of small hashes in order."""
    return df.where(F.xxhash64(key) <= hash_below(rows, n)).orderBy(F.xxhash64(key), F.col(key)).limit(rows)


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, rows_per_class: int, train: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most rows_per_class rows of docs for each label. Only a bounded list of ids is
    broadcast; the texts aren't shuffled. Repeated labels of an id: the larger counts; ids in several rows of docs come after the
    others, and only if all their rows are within the bound; null ids and labels: left out."""
    marks = marks.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if train is not None:
        marks = marks.where(train)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    of_label = dict(map(tuple, marks.groupBy("label").count().collect()))
    first, second = (bounded_sample(marks.where(F.col("label") == k), "doc_id", rows_per_class, of_label.get(k, 0)) for k in (1, 0))
    times = docs.select("doc_id").join(F.broadcast(first.unionByName(second)), "doc_id").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("times"))
    # one array of rows_per_class ids at most for each label; of it the first ids whose rows are within the bound
    listed = times.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("times", F.xxhash64("doc_id").alias("hash"), "doc_id"))).alias("ids"))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).alias("n"))
    counted = F.aggregate("ids", start, lambda acc, x: F.struct((acc["rows"] + x["times"]).alias("rows"), (acc["n"] + (acc["rows"] + x["times"] <= rows_per_class).cast("int")).alias("n")))
    within = listed.select("label", F.explode(F.slice(F.col("ids"), F.lit(1), counted["n"])).alias("x")).select("x.doc_id", "label")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(within), "doc_id")
