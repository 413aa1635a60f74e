"""Corpus-wide word tables and sums of a word's value over each document's words.

counts(): the number of times that each word (or other token) occurs in all texts. Tasks count in memory and give out partial
counts whenever they hold FLUSH words or have read FLUSH_BYTES since the last time, so memory is bounded; Spark adds them up.

document_sums(): for each document the sum of frequency times a value that a table has for each word. The most frequent words, at
most HEAD of them and HEAD_BYTES bytes of them in all, whatever the corpus and however long a word, are looked up where the text is
read; only the rest goes through a shuffle join, as one row for each distinct rare word of a document, in batches of bounded bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH = 200_000
FLUSH_BYTES = 1 << 26
HEAD = 1 << 17
HEAD_BYTES = 1 << 22
#: A batch of joined words ends with the document that reaches one of these.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 24


def _partial(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()).cast(pa.string()), pa.array(counter.values(), pa.int64())], names=["word", "n"])


def counts(texts: DataFrame, words: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """(word, n) over texts, a table of one string column; null texts count as empty."""

    def run(batches):
        seen: Counter = Counter()
        read = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                seen.update(words(text))
                read += len(text)
                if len(seen) >= FLUSH or read >= FLUSH_BYTES:
                    yield _partial(seen)
                    seen, read = Counter(), 0
        yield _partial(seen)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(table: DataFrame, *values: str, size: int | None = None, in_all: int | None = None) -> dict[bytes, tuple]:
    """The values of the most frequent words: whole classes (eight to an octave of frequency, one to an octave of length) from the
    most frequent down, until the next one would make more than `size` words; a class that would make more than `in_all` bytes is passed
    over. A table of classes decides, so the driver gets no more rows than it keeps."""
    size, left = HEAD if size is None else size, HEAD_BYTES if in_all is None else in_all
    by = table.withColumns({"often": F.floor(8 * F.log2("n")).cast("int"), "long": F.floor(F.log2(F.greatest(F.octet_length("word"), F.lit(1)))).cast("int")})
    sizes = by.groupBy("often", "long").agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).collect()
    kept, held = [], 0
    for often, long, n, of_bytes in sorted(map(tuple, sizes), key=lambda x: (-x[0], x[1])):
        held += n
        if held > size:
            break
        if of_bytes <= left:
            left -= of_bytes
            kept.append(64 * often + long)
    if not kept:
        return {}
    return {bytes(r[0]): tuple(r)[1:] for r in by.where((64 * F.col("often") + F.col("long")).isin(kept)).select(F.col("word").cast("binary"), *values).collect()}


def document_sums(docs: DataFrame, base: str, rows: Callable, table: DataFrame, sums: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row for each row of docs.

    rows(batches) yields, for each row of docs, a batch row whose word is no_word(rid) and that carries the columns `base` (DDL),
    and further rows (word, f) for the words that the head lacks; all rows of a document have the same `rid`. sums: what to add up over the
    rows of a document after the left join with table on word. keep: base columns to hand on.
    """
    flow = docs.mapInArrow(rows, f"rid long, word string, f long, {base}")
    joined = flow.join(table, "word", "left")
    return joined.groupBy("rid").agg(*[F.max(c).alias(c) for c in keep], *[c.alias(name) for name, c in sums.items()]).drop("rid")


def no_word(rid: int) -> bytes:
    """A join key that no word equals, as it starts with white space; each document's own, so that these rows don't meet in one task."""
    return b"\n%d" % rid


def row_ids():
    """Ids for the rows of this task, apart from those of any other task."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1
