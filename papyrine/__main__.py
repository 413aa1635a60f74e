"""python -m papyrine list | sql NAME | query NAME FOLDER | extract PATH OUT | bench FOLDER OUT | rescore OUT FOLDER | compare OUT OUT..."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="papyrine", description="Run the engine's queries, extractions and benchmarks.")
    commands = made.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    sql = commands.add_parser("sql", help="the SQL of a query")
    sql.add_argument("name")
    run = commands.add_parser("query", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    extract = commands.add_parser("extract", help="files to Markdown, JSON and a route log")
    extract.add_argument("path")
    extract.add_argument("out")
    extract.add_argument("--product", default="vi_en")
    bench = commands.add_parser("bench", help="a system's outputs for a folder of documents with *.gt.md, and their scores")
    bench.add_argument("folder")
    bench.add_argument("out")
    bench.add_argument("--system", default="papyrine")
    bench.add_argument("--split", choices=("dev", "test"))
    rescore = commands.add_parser("rescore", help="saved outputs against the ground truth of today")
    rescore.add_argument("report")
    rescore.add_argument("folder")
    compare = commands.add_parser("compare", help="several reports side by side")
    compare.add_argument("report", nargs="+")
    return made


def truth_of(engine, folder: str, split: str | None = None):
    """(files, truth) of a folder: path and content of its documents; path, truth and category."""
    from pyspark.sql import functions as F

    from .operators import benchmark

    found = engine.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    found = found.withColumn("path", F.substring("path", F.lit(len(folder.rstrip("/")) + 2), F.lit(1 << 20)))
    named = found.select("path", F.when(F.col("path").endswith(".gt.md"), F.decode("content", "UTF-8")).alias("text"))
    return found.where(~F.col("path").endswith(".gt.md")), benchmark.dataset(named, split).select("path", "truth", "category")


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    from .plans import registry

    if given.command == "list":
        print("\n".join(registry.queries()))
        return 0
    if given.command == "sql":
        found = registry.oracle_sql().get(given.name)
        print(found or f"{given.name} has no SQL", file=sys.stdout if found else sys.stderr)
        return 0 if found else 1
    from .engine import Engine, Systems
    from .operators import benchmark
    from .session import local_session
    from .settings import Settings

    spark = local_session()
    if given.command == "query":
        made = registry.queries()[given.name](spark, given.folder)
        if given.out:
            made.write.mode("overwrite").parquet(given.out)
        else:
            made.show(given.rows, truncate=80)
        return 0
    if given.command == "extract":
        engine = Engine(spark, Settings.load(product=given.product))
        engine.extract(engine.files(given.path)).write(given.out)
        return 0
    if given.command == "bench":
        engine = Engine(spark)
        files, truth = truth_of(engine, given.folder, given.split)
        Systems.of(engine).run(given.system, files, truth).write.mode("overwrite").parquet(given.out)
        benchmark.summary(spark.read.parquet(given.out)).show(truncate=False)
        return 0
    if given.command == "rescore":
        engine = Engine(spark)
        saved = spark.read.parquet(given.report)
        benchmark.summary(benchmark.rescored(saved, truth_of(engine, given.folder)[1])).show(truncate=False)
        return 0
    from functools import reduce

    shared = ("cer", "wer", "word_f1", "heading_f1")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in given.report])
    each = rows.groupBy("system", "category").agg(*[benchmark.mean4(c).alias(c) for c in shared if c in rows.columns])
    benchmark.compared(each, tuple(c for c in shared if c in each.columns)).show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
