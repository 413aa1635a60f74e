"""Token counts without token ids.

Pre-tokens are the words between ASCII white space: the tokeniser drops white space and merges nothing across it, so the pieces of a
text are those of its words (special strings hold no white space and are found inside words as in whole texts). Three steps:
count the corpus's pre-tokens; let the tokeniser count the pieces of each distinct one, once; join these to each document's
pre-token frequencies and add up. No ids are kept for any document.

Edge cases: null and empty texts have 0 tokens; very long texts are whole, words of any length too; rows with null or repeated ids
and repeated rows are counted one by one; there are no ties to break; an empty table gives no rows; further columns of docs, whatever
their names, are not used.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import written

#: Words that the tokeniser takes at once, and their bytes.
BATCH, BATCH_BYTES = 2048, 1 << 22


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """words (word, n, ...) with `pieces`, the tokens of the word."""

    def run(batches):
        made = tokenizer(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                few = batch.column(0).slice(at, BATCH)
                fit = int(np.searchsorted(np.cumsum(pc.binary_length(few).to_numpy(zero_copy_only=False)), BATCH_BYTES, side="right"))
                part = batch.slice(at, max(1, fit))
                encoded = made.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in encoded], pa.int64())], names=["word", "n", "pieces"])
                at += part.num_rows

    return words.select("word", "n").mapInArrow(run, "word string, n long, pieces long")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    pieces = written(piece_counts(vocab.counts(docs.select("text"), bytes.split), path), "pieces")
    head = spark.sparkContext.broadcast({k: v[0] for k, v in vocab.head_of(pieces, "pieces").items()})
    id_type = docs.select("doc_id").schema

    def rows(batches):
        known, ids = head.value.get, vocab.row_ids()
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_id = to_arrow_schema(id_type).field(0).type
        def made(batch, out):
            rid, word, f, at, n_bytes, base = out
            return pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(f, pa.int64()), batch.column(0).take(pa.array(at, pa.int32())).cast(arrow_id), pa.array(n_bytes, pa.int64()), pa.array(base, pa.int64())],
                names=["rid", "word", "f", "doc_id", "n_bytes", "base"],
            )

        for batch in batches:
            out, held = tuple([] for _ in range(6)), 0
            rid, word, f, at, n_bytes, base = out
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                text, own, total = text.as_py() or b"", next(ids), 0
                for w, n in Counter(text.split()).items():
                    k = known(w)
                    if k is None:
                        rid.append(own), word.append(w), f.append(n), at.append(None), n_bytes.append(None), base.append(None)
                    else:
                        total += k * n
                rid.append(own), word.append(vocab.no_word(own)), f.append(None), at.append(i), n_bytes.append(len(text)), base.append(total)
                held += len(text)
                if len(rid) >= vocab.BATCH_ROWS or held >= vocab.BATCH_BYTES:
                    yield made(batch, out)
                    held = 0
                    for x in out:
                        x.clear()
            yield made(batch, out)

    rare = F.coalesce(F.sum(F.col("f") * F.col("pieces")), F.lit(0))
    made = vocab.document_sums(docs.select("doc_id", "text"), f"doc_id {kind}, n_bytes long, base long", rows, pieces.select("word", "pieces"), {"rare": rare}, ["doc_id", "n_bytes", "base"])
    total = F.col("base") + F.col("rare")
    return made.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
