"""Language identification by a convolutional network over bytes.

Every text is cut into windows of `length` bytes (the last one ends with the text and overlaps; short texts are padded). For each
width the network has filters over that many bytes, whose first layer is a table of the 256 bytes for each place of the filter;
each filter's maximum over the window, through a ramp, goes to a softmax over the languages learnt. The probabilities of a text are the
means over its windows, weighted by the bytes that a window adds. Training is Adam in numpy on windows spread evenly over
documents of every language that labels name: at most `per_language` of each and, where there are very many languages, `most` in
all, dealt out evenly (one of each at least). Texts are cut to windows where they are read; only those are ranked and collected.

Edge cases: null texts and texts without a letter are `und` with score 0; a short text is one padded window, a very long one is
whole, some windows at a time; of equally likely languages the first by name is taken; repeated rows are each predicted, and learnt
from once; without training rows (an empty table among others) every text is `und`; rows with a null doc_id are predicted,
not held out and not learnt from; further columns of docs, whatever their names, are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fold_of, hash_below

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bytes that a step of prediction takes at once.
STEP = 1 << 18


@dataclass
class Network:
    """tables: for each width, width x 256 x filters; shift: filters of all widths; dense: all filters x languages; bias."""

    languages: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def filtered(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' values at every place: places x windows x filters, so that maxima run over whole planes."""
        turned = np.ascontiguousarray(windows.T)
        out = []
        for table in self.tables:
            k = len(table)
            places = len(turned) - k + 1
            total = table[0][turned[:places]]
            for j in range(1, k):
                total += table[j][turned[j : j + places]]
            out.append(total)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([x.max(0) for x in self.filtered(windows)], axis=1)
        logits = np.maximum(pooled + self.shift, 0) @ self.dense + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def windows_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the text and the bytes that each adds."""
    n = max(1, -(-len(text) // length))
    data = np.zeros((n, length), np.uint8)
    flat = np.frombuffer(text, np.uint8)
    whole = len(text) // length
    data[:whole] = flat[: whole * length].reshape(whole, length)
    if n > whole:
        tail = flat[-length:] if whole else flat
        data[-1, : len(tail)] = tail
    weight = np.full(n, length, np.float64)
    weight[-1] = len(text) - (n - 1) * length
    return data, weight


def train(windows: np.ndarray, classes: np.ndarray, languages: list[str], passes: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = Network(languages, [rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32), np.zeros(n, np.float32))
    params = [*net.tables, net.shift, net.dense, net.bias]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    count = 0
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x, y = windows[some], classes[some]
            values = net.filtered(x)
            best = [v.argmax(0) for v in values]
            pooled = np.concatenate([v.max(0) for v in values], axis=1) + net.shift
            hidden = np.maximum(pooled, 0)
            logits = hidden @ net.dense + net.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.dense.T) * (pooled > 0)
            grads = []
            for i, (place, k) in enumerate(zip(best, WIDTHS, strict=True)):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(net.tables[i])
                rows, columns = np.arange(len(y))[:, None], np.arange(FILTERS)
                for j in range(k):
                    np.add.at(grad[j], (x[rows, place + j], columns), part)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            count += 1
            for w, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.999**count)) + 1e-8)
    return net


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 400, windows: int = 6, most: int = 40_000) -> Network | None:
    """The network from documents whose crc32(doc_id) isn't `held` modulo `modulus`: at most per_language documents of each
    language, or `most` over their number if that is less (but one), and at most `windows` windows of each, spread over the whole text."""
    got = training_windows(docs, modulus, held, per_language, windows, most)
    rows = [] if got is None else sorted((lang, bytes(x)) for lang, x in got.collect())
    names = sorted({lang for lang, _ in rows})
    if not names:
        return None
    place = {lang: i for i, lang in enumerate(names)}
    classes = np.repeat([place[lang] for lang, _ in rows], [len(x) // LENGTH for _, x in rows])
    return train(np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(-1, LENGTH), classes, names)


def training_windows(docs: DataFrame, modulus: int, held: int, per_language: int, windows: int, most: int) -> DataFrame | None:
    """(lang, windows) of the documents to learn from, those of the least hashes of id and text in each language, repeated ones once;
    None if there are none. A bound of hashes, from the number of distinct ones, tells which texts to cut to windows; the rank
    of what is cut, little more than wanted, then holds the limit."""
    rows = docs.select("doc_id", "text", "lang").where((fold_of("doc_id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("doc_id", "text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash")).collect()
    if not sizes:
        return None
    each = max(1, min(per_language, most // len(sizes)))
    known = docs.sparkSession.createDataFrame([(lang, hash_below(each, n)) for lang, n in sizes], f"lang {docs.schema['lang'].dataType.simpleString()}, last long")
    picked = rows.join(F.broadcast(known), "lang").where(F.col("hash") <= F.col("last")).select("lang", "hash", "text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()):
                data, _ = windows_of(text.as_py())
                out.append(data[sorted({int(k * len(data) / windows) for k in range(windows)})].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.binary())], names=["lang", "hash", "windows"])

    cut = picked.mapInArrow(run, "lang string, hash long, windows binary")
    once = cut.groupBy("lang", "hash").agg(F.first("windows").alias("windows"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    return once.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "windows")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, x in enumerate(texts) if net and x and has_letter(x)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            group: list[tuple[int, np.ndarray, np.ndarray]] = []
            sums: dict[int, np.ndarray] = {}

            def flush(group):
                p = net.probabilities(np.concatenate([w for _, w, _ in group]))
                at = 0
                for i, w, weight in group:
                    sums[i] = sums.get(i, 0) + weight @ p[at : at + len(w)]
                    at += len(w)
                group.clear()

            held_bytes = 0
            for i in known:
                data, weight = windows_of(texts[i].encode())
                for at in range(0, len(data), STEP // LENGTH):
                    group.append((i, data[at : at + STEP // LENGTH], weight[at : at + STEP // LENGTH]))
                    held_bytes += group[-1][1].size
                    if held_bytes >= STEP:
                        flush(group)
                        held_bytes = 0
            if group:
                flush(group)
            for i in known:
                p = sums[i] / sums[i].sum()
                best = int(p.argmax())
                lang[i], score[i] = net.languages[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return made.select("doc_id", F.coalesce(fold_of("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
