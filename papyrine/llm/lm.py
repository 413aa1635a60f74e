"""Log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

Tokens are A-Z-lower-cased words and one end for each text. The corpus's word table (every word of every training text, counted
in Spark) gives the base model, an add-0.1 unigram with one unseen word. The neural model predicts classes from the two tokens
before: the CORE most frequent words (of at most CORE_BYTES bytes) and the end are classes by themselves, any other word belongs to
the class of its last two bytes (the CLASSES most frequent such endings, or a rest). Within a class words have add-0.1 unigram
probabilities with one unseen word for each class, so probabilities add up to 1 over classes and over the words of a class.

Context vectors of both places are projected, added and multiplied with the class vectors; as exp(a + b) = exp(a) exp(b), the
normaliser of all pairs of contexts is one product of two matrices, computed once in a task. Every token gets a normalised
log-probability.

The neural parameters are fitted on every position of all training texts: started on at most `examples` positions drawn in all
tasks, they go to all tasks, each takes NCE steps over all positions of its own texts, and the tasks' parameters are averaged by
their positions. So do all counts and class totals cover all training texts. The model depends on the texts (and on how they are
dealt to tasks), not on which words are looked up where the texts are read: the core is taken from the word table itself.

Edge cases: null and empty texts are one end token; very long texts are whole; without training rows (an empty table among others)
every base probability is 1 (one unseen word); of equally frequent words and endings the lower bytes go first; repeated rows are
texts of their own, in training and in the result; rows with a null doc_id are scored, not held out and not learnt from; further
columns of docs, whatever their names, are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import fold_of, written

#: The end token's word in the table; no word holds white space.
END = b"\n"
CORE, CORE_BYTES, CLASSES = 1023, 256, 160
#: Positions that a task holds, shuffles and trains on at once.
CHUNK = 1 << 18
ADD = 0.1


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


class Classes(dict):
    """The class of each word, kept for a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> int:
        k = self.model.class_of(word)
        if len(word) <= CORE_BYTES:
            if len(self) >= vocab.FLUSH:
                self.clear()
            self[word] = k
        return k


@dataclass
class Model:
    """vectors: R (classes x size); left and right: projections of the tokens one and two places back; bias: of the classes.
    Class number len(bias) - 1 is the rest; contexts before the first token use the end's class."""

    core: dict[bytes, int]
    endings: dict[bytes, int]
    vectors: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray

    def class_of(self, word: bytes) -> int:
        k = self.core.get(word)
        return self.endings.get(word[-2:], len(self.bias) - 1) if k is None else k

    def classes(self) -> Classes:
        return Classes(self)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """one[u, w], two[v, w] and normaliser[u, v] so that log p(w | u one back, v two back) = one + two - normaliser."""
        one = (self.vectors @ self.left) @ self.vectors.T + self.bias
        two = (self.vectors @ self.right) @ self.vectors.T
        top, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.exp(one - top) @ np.exp(two - top2).T
        return one.astype(np.float32), two.astype(np.float32), (np.log(z) + top + top2.T).astype(np.float32)


def untrained(totals: np.ndarray, size: int = 32, seed: int = 7) -> list[np.ndarray]:
    """vectors, left, right and bias before training, and AdaGrad's memory of each."""
    rng = np.random.default_rng(seed)
    p = (totals + 1.0) / (totals + 1.0).sum()
    made = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((len(totals), size), (size, size), (size, size))] + [np.log(p).astype(np.float32)]
    return made + [np.full(x.shape, 1e-2, np.float32) for x in made]


def summed(rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of its rows."""
    width = rows.shape[1]
    cells = np.multiply(place, width, dtype=np.intp)[:, None] + np.arange(width)
    return np.bincount(cells.ravel(), rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def train(triples: np.ndarray, totals: np.ndarray, size: int = 32, noise: int = 64, passes: int = 4, batch: int = 2048, rate: float = 0.1, seed: int | list[int] = 7, state: list[np.ndarray] | None = None):
    """NCE over rows (one back, two back, class): each batch is told apart from `noise` classes drawn for the batch from the
    unigram; AdaGrad. totals: how often each class occurs in all training texts. A state is trained further in place."""
    rng = np.random.default_rng(seed)
    n = len(totals)
    p = (totals + 1.0) / (totals + 1.0).sum()
    state = untrained(totals, size, seed) if state is None else state
    vectors, left, right, bias = state[:4]
    log_p, drawn_at = np.log(p).astype(np.float32), p.cumsum() / p.sum()
    shift = np.float32(math.log(noise))
    places = triples.astype(np.int16 if n < 1 << 15 else np.int32)  # short ones are sorted by radix
    for _ in range(passes):
        order = rng.permutation(len(triples))
        for start in range(0, len(order), batch):
            u, v, w = np.ascontiguousarray(places[order[start : start + batch]].T)
            drawn = drawn_at.searchsorted(rng.random(noise), side="right")
            # Classes are projected once, not at each position, and gradients are added up for each class before they are projected.
            q = (vectors @ left).take(u, 0) + (vectors @ right).take(v, 0)
            goal, others = vectors.take(w, 0), vectors[drawn]
            good = np.einsum("ij,ij->i", q, goal) + (bias - log_p - shift).take(w)
            bad = q @ others.T + (bias[drawn] - log_p[drawn] - shift)
            g = (1 / (1 + np.exp(-good)) - 1) / np.float32(len(u))
            np.exp(np.negative(bad, out=bad), out=bad)
            bad += 1
            b = np.divide(np.float32(1 / len(u)), bad, out=bad)
            dq = g[:, None] * goal + b @ others
            by_u, by_v = summed(dq, u, n), summed(dq, v, n)
            on_vectors = summed(g[:, None] * q, w, n) + by_u @ left.T + by_v @ right.T
            np.add.at(on_vectors, drawn, (q.T @ b).T)
            on_bias = (np.bincount(w, g, n) + np.bincount(drawn, b.sum(0), n)).astype(np.float32)
            for x, gradient, memory in zip(state[:4], (on_vectors, vectors.T @ by_u, vectors.T @ by_v, on_bias), state[4:], strict=True):
                memory += gradient**2
                x -= rate * gradient / np.sqrt(memory)
    return vectors, left, right, bias


def class_totals(table: DataFrame, core: dict[bytes, int]) -> dict[bytes, tuple[int, int]]:
    """(tokens, words) of every two-byte ending of the words outside the core: at most 65,793 endings, whatever the corpus."""
    ending = F.substring(F.col("word").cast("binary"), -2, 2)
    words = [k.decode() for k in core]
    rest = table.where(~F.col("word").isin(words)) if words else table
    return {bytes(r[0]): (int(r[1]), int(r[2])) for r in rest.groupBy(ending.alias("e")).agg(F.sum("n"), F.count(F.lit(1))).collect()}


@dataclass
class Fitted:
    """What is learnt. counts: of the core's words and the end, and of the words that are looked up where texts are read; inside:
    (tokens, words) of every class that isn't a word's own."""

    model: Model
    table: DataFrame
    counts: dict[bytes, int]
    n_tokens: int
    n_words: int
    inside: dict[int, tuple[int, int]]


def counted(docs: DataFrame, train_rows: Column, core_size: int = CORE, classes: int = CLASSES, head: int | None = None) -> tuple[Fitted, np.ndarray]:
    """The counts of the rows of docs that train_rows takes and a model without parameters; how often each class occurs. head: how
    many words are looked up without a join at most (vocab.HEAD)."""
    table = written(vocab.counts(docs.where(train_rows).select("text"), tokens), "words")
    n_tokens, n_words, n_texts = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == END.decode(), F.col("n"))), F.lit(0))).first()
    short = table.where((F.col("word") != END.decode()) & (F.octet_length("word") <= CORE_BYTES))
    common = [(bytes(w), n) for w, n in short.orderBy(F.desc("n"), F.col("word").cast("binary")).limit(core_size).select(F.col("word").cast("binary"), "n").collect()]
    own = {END: int(n_texts), **dict(common)}
    core = {w: i for i, w in enumerate(own)}
    by_ending = class_totals(table, core)
    frequent = sorted(by_ending, key=lambda e: (-by_ending[e][0], e))[:classes]
    endings = {e: len(core) + i for i, e in enumerate(frequent)}
    size = len(core) + len(endings) + 1
    inside = {k: [0, 0] for k in range(len(core), size)}
    for e, (t, w) in by_ending.items():
        k = endings.get(e, size - 1)
        inside[k][0] += t
        inside[k][1] += w
    totals = np.array([*own.values(), *(inside[k][0] for k in range(len(core), size))], np.float64)
    model = Model(core, endings, *(np.zeros(0, np.float32),) * 3, np.zeros(size, np.float32))
    looked_up = {w: x[0] for w, x in vocab.head_of(table, "n", size=head).items()} | own
    return Fitted(model, table, looked_up, int(n_tokens), int(n_words), {k: tuple(x) for k, x in inside.items()}), totals


def fit(docs: DataFrame, train_rows: Column, examples: int = 1_000_000, head: int | None = None) -> Fitted:
    """Counts and neural parameters from the rows of docs that train_rows takes."""
    fitted, totals = counted(docs, train_rows, head=head)
    model, texts = fitted.model, docs.where(train_rows)
    state = untrained(totals)
    train(sampled(texts, model, fitted.n_tokens, examples), totals, state=state)
    (model.vectors, model.left, model.right, model.bias), _ = trained(texts, model, totals, state)
    return fitted


def contexts(classes: Classes, words: list[bytes]) -> np.ndarray:
    """Rows (one back, two back, class) for each token."""
    k = np.fromiter(map(classes.__getitem__, words), np.int32, len(words))
    out = np.zeros((len(k), 3), np.int32)
    out[:, 2] = k
    out[1:, 0], out[2:, 1] = k[:-1], k[:-2]
    return out


def trained(docs: DataFrame, model: Model, totals: np.ndarray, state: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """(vectors, left, right and bias, positions): each task trains the state on every position of its texts; the means of the
    tasks' parameters, weighted by positions. Sums are made on executors, so the driver's part doesn't grow with the input."""
    shared = docs.sparkSession.sparkContext.broadcast((model, totals, state))

    def run(batches):
        from pyspark import TaskContext

        model, totals, state = shared.value
        own, classes, part = [x.copy() for x in state], model.classes(), TaskContext.get().partitionId()
        held, size, n, turn = [], 0, 0, 0

        def learn():
            train(np.concatenate(held), totals, passes=1, seed=[part, turn], state=own)
            held.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(contexts(classes, tokens(text or b"")))
                size += len(held[-1])
                if size >= CHUNK:
                    learn()
                    n, size, turn = n + size, 0, turn + 1
        if held:
            learn()
        if n + size:
            yield pa.RecordBatch.from_arrays([pa.array([n + size], pa.int64()), pa.array([np.concatenate([x.ravel() for x in own[:4]]).tobytes()], pa.binary())], names=["n", "parameters"])

    def add(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    made = docs.select("text").mapInArrow(run, "n long, parameters binary").rdd
    got = made.map(lambda r: (r[0], r[0] * np.frombuffer(r[1], np.float32).astype(np.float64))).treeAggregate(None, add, add)
    if got is None:
        return state[:4], 0
    cuts = np.cumsum([x.size for x in state[:3]])
    return [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(got[1] / got[0], cuts), state[:4], strict=True)], got[0]


def sampled(docs: DataFrame, model: Model, n_tokens: int, examples: int) -> np.ndarray:
    """At most `examples` context rows to start from: of a share of the texts drawn in every task, positions spread over the
    whole text; a task hands on no more than its part of them, drawn evenly from what it has."""
    share = min(1.0, examples / max(1, 2 * n_tokens))
    of_texts = min(1.0, share * 8)
    step = max(1, round(of_texts / share))
    tasks = max(1, docs.rdd.getNumPartitions())
    each = -(-examples // tasks)

    def run(batches):
        from pyspark import TaskContext

        rng, classes = np.random.default_rng([11, TaskContext.get().partitionId()]), model.classes()
        held, key, new = np.zeros((0, 3), np.int32), np.zeros(0), []

        def drawn(held, key):
            rows = np.concatenate([held, *new])
            key = np.r_[key, rng.random(len(rows) - len(key))]
            new.clear()
            if len(rows) <= each:
                return rows, key
            least = np.argpartition(key, each)[:each]
            return rows[least], key[least]

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if rng.random() < of_texts:
                    new.append(contexts(classes, tokens(text.as_py() or b""))[rng.integers(step) :: step])
                    if sum(map(len, new[-64:])) > CHUNK or len(new) >= 4096:
                        held, key = drawn(held, key)
        held, key = drawn(held, key)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["rows"])

    got = docs.select("text").mapInArrow(run, "rows binary").collect()
    return np.concatenate([np.zeros((0, 3), np.int32), *(np.frombuffer(r[0], np.int32).reshape(-1, 3) for r in got)])[:examples]


def score(docs: DataFrame, modulus: int = 10, examples: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) of every row of docs; rows whose
    crc32(doc_id) is 0 modulo `modulus` are held out of all learning."""
    docs = docs.select("doc_id", "text")
    made = scored(docs, fit(docs, fold_of("doc_id", modulus) != 0, examples))
    return made.select("doc_id", F.coalesce(fold_of("doc_id", modulus) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def scored(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    n_all = fitted.n_tokens
    shared = spark.sparkContext.broadcast((fitted.model, {w: math.log10(n + ADD) for w, n in fitted.counts.items()}))
    end_known = int(fitted.counts[END] > 0)
    id_schema = docs.select("doc_id").schema
    bottom = math.log10(n_all + ADD * (fitted.n_words + 1))
    within = {k: math.log10(t + ADD * (w + 1)) for k, (t, w) in fitted.inside.items()}

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_id = to_arrow_schema(id_schema).field(0).type
        model, logs = shared.value
        one, two, normaliser = model.tables()
        ids, classes = vocab.row_ids(), model.classes()
        # of a word's class, what its log10(count + ADD) is divided by; the core's own logs, which are not part of the neural score
        add = np.array([*map(logs.__getitem__, model.core), *(within[k] for k in range(len(model.core), len(model.bias)))])

        def made(batch, out):
            return pa.RecordBatch.from_arrays(
                [pa.array(out["rid"], pa.int64()), pa.array(out["word"], pa.binary()).cast(pa.string()), pa.array(out["f"], pa.int64()), batch.column(0).take(pa.array(out["at"], pa.int32())).cast(arrow_id), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64())],
                names=["rid", "word", "f", "doc_id", "n_tokens", "known", "base", "neural"],
            )

        for batch in batches:
            out, held = {c: [] for c in ("rid", "word", "f", "at", "n", "known", "base", "score")}, 0
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                own, words = next(ids), tokens(text)
                neural = 0.0
                triples = contexts(classes, words)
                for at in range(0, len(triples), CHUNK):
                    u, v, w = triples[at : at + CHUNK].T
                    neural += float((one[u, w] + two[v, w] - normaliser[u, v]).sum(dtype=np.float64)) / math.log(10) - float(add[w].sum())
                found, known = 0.0, end_known - 1
                for word, n in Counter(words).items():
                    x = logs.get(word)
                    if x is None:  # never one of the core, nor the end
                        out["rid"].append(own), out["word"].append(word), out["f"].append(n)
                        for c in ("at", "n", "known", "base", "score"):
                            out[c].append(None)
                    else:
                        found += n * x
                        known += n
                for c, x in zip(out, (own, vocab.no_word(own), None, i, len(words), known, found - len(words) * bottom, neural + found), strict=True):
                    out[c].append(x)
                held += len(text)
                if len(out["rid"]) >= vocab.BATCH_ROWS or held >= vocab.BATCH_BYTES:
                    yield made(batch, out)
                    held = 0
                    for x in out.values():
                        x.clear()
            yield made(batch, out)

    more = {"rare_known": F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("f"))), F.lit(0)), "rare": F.coalesce(F.sum(F.col("f") * F.log10(F.coalesce("c", F.lit(0)) + ADD)), F.lit(0.0))}
    made = vocab.document_sums(docs, f"doc_id {kind}, n_tokens long, known long, base double, neural double", rows, fitted.table.select("word", F.col("n").alias("c")), more, ["doc_id", "n_tokens", "known", "base", "neural"])
    return made.select(
        "doc_id", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare")).alias("base_score"), (F.col("neural") + F.col("rare")).alias("score"),
    )
