"""Toxicity by a weighted lexicon.

Texts are folded: lower case, accents and look-alike letters to plain Latin ones, digits and signs that stand for letters
to those letters (l, i, 1 and ! are one letter). An Aho-Corasick automaton finds the lexicon's terms as whole words in the folded
text; terms inside an exception phrase don't count. The summed weights, by themselves and over the text's length, go
through a logistic function.

The lexicon is learnt from a bounded sample of labelled training documents (rows_per_class of each label, near copies taken once):
over document counts made in Spark, all words whose log-likelihood ratio is beyond what chance gives to the best of a vocabulary
and whose share of toxic documents is at least 8 times that of others become terms; the weights are the log-odds, and the logistic is fitted on the
sample. Phrases of a term and the word before or after that occur in documents without the label only are learnt as exceptions.

Edge cases: null and empty texts have no words and get the score of no match; very long texts are whole; terms that overlap all
count; a score of exactly 0.5 is predicted 1; repeated rows are each scored, and their words counted once in learning; without labels
of both kinds (an empty table among others) every score is the share of toxic labels (0 if none); rows with a null doc_id are scored
and not held out; further columns of docs, whatever their names, are not used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, written

#: Letters of other scripts and signs that look like Latin letters. Fixed values.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3€", "g": "ɡ9", "h": "һ", "i": "іιı1!|lӏ", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "оοσ0", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7+", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ2",
}
WORD = re.compile("[a-z]+")
#: Least log-likelihood ratio of a term: 2 log(100,000 words) + 10.
RATIO = 33.0
#: Phrases in which a usual lexicon word insults nobody.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "idiot proof", "class clown")


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    table = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        if "a" <= base <= "z":
            table[point] = base
    table |= {x: chr(x).lower() for x in range(65, 91)}
    for plain, others in LOOKALIKES.items():
        table |= {ord(o): plain for o in others + others.upper() if len(o) == 1}
    table |= {k: "i" for k, v in table.items() if v == "l"} | {ord("l"): "i", ord("L"): "i"}
    table |= {k: None for k in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return table


def fold(text: str) -> str:
    """The folded text. Only signs between letters stand for letters, so closing punctuation ends a word: '!', '+', '|' and
    currency signs are folded before a letter only."""
    return SIGNS.sub(" ", text).translate(folding())


SIGNS = re.compile(r"[!|+$€@](?!\w)")


def n_words(text: str) -> int:
    return len(text.split())


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-30.0, 0.0, 0.0)  # constant, summed weight, weight for each hundred words

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            made.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            made.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(made):
            made.make_automaton()
        return made


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of whole-word terms outside exception phrases."""
    if not len(automaton):
        return []
    terms, spared = [], []
    n = len(folded)
    for last, (size, weight) in automaton.iter(folded):
        a, b = last + 1 - size, last + 1
        if (a == 0 or not folded[a - 1].isalnum()) and (b == n or not folded[b].isalnum()):
            (spared if weight is None else terms).append((a, b, weight))
    if not spared:
        return terms
    spared.sort(key=lambda x: x[:2])
    starts, reach = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
    # of the phrases that start at or before the term, the one that reaches furthest tells
    return [t for t in terms if not (k := bisect_right(starts, t[0])) or reach[k - 1] < t[1]]


def features(automaton, text: str | None) -> tuple[float, float, int]:
    """Summed weight (over the sum's growth: log1p), weight for each hundred words, matches."""
    text = text or ""
    found = matches(automaton, fold(text))
    if not found:
        return 0.0, 0.0, 0
    total = sum(w for _, _, w in found)
    return math.log1p(total), math.log1p(100 * total / max(1, n_words(text))), len(found)


def terms_of(sample: DataFrame, n_bad: int, n_good: int, least: int) -> list[tuple[str, int, int]]:
    """(word, toxic documents, other documents) of every word in at least `least` toxic documents that passes both tests; the sample
    bounds their number."""

    def run(batches):
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(set(WORD.findall(fold(text))))
            for label, counter in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array([label] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())], names=["word", "label", "n"])

    words = sample.select("text", "label").mapInArrow(run, "word string, label int, n long")
    by = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    by = by.where((F.col("bad") >= least) & (F.length("word") >= 3) & (F.col("bad") * n_good >= F.col("good") * 8 * n_bad))
    return [tuple(r) for r in by.where(significant(F.col("bad"), F.col("good"), n_bad, n_good) >= RATIO).orderBy("word").collect()]


def sketch(text: bytes, shingle: int = 5, bands: int = 8, rows: int = 4) -> list[int]:
    """A hash for each band of `rows` least hashes of the word shingles: near copies share one, other texts hardly ever."""
    import xxhash

    words = text.lower().split()
    some = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in some], np.uint64)
    mixed = np.random.default_rng(23).integers(1, 2**63, (bands * rows, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    least = np.array([(hashes * m ^ (hashes >> np.uint64(29)) * k).min() for m, k in mixed], np.uint64)
    return [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in least.reshape(bands, rows)]


def distinct_texts(sample: DataFrame) -> DataFrame:
    """The sample without near copies, which would count the words of one text many times: of documents that share a band of
    their sketches, the one with the least id stays. The sample is bounded, so its sketches are too."""

    def run(batches):
        for batch in batches:
            bands = [sketch(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "bands"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    seen: set[tuple[int, int]] = set()
    keep = []
    for doc_id, bands in sorted(map(tuple, sample.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bands array<long>").collect())):
        own = set(enumerate(bands))
        if not own & seen:
            keep.append((doc_id,))
        seen |= own
    ids = sample.sparkSession.createDataFrame(keep, f"doc_id {kind}")
    return sample.join(F.broadcast(ids), "doc_id", "left_semi")


def significant(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """The log-likelihood ratio of a word's documents by label against none; 0 for words that toxic documents have less often."""
    n, total = bad + good, n_bad + n_good
    parts = ((bad, n * n_bad), (good, n * n_good), (n_bad - bad, (total - n) * n_bad), (n_good - good, (total - n) * n_good))
    ratio = sum((F.when(o > 0, o * F.log(o * total / e)).otherwise(0.0) for o, e in parts), F.lit(0.0))
    return F.when(bad * total <= n * n_bad, 0.0).otherwise(2 * ratio)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge on all but the constant."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, marks: DataFrame, modulus: int = 5, rows_per_class: int = 5000, least: int = 3) -> Lexicon:
    """The lexicon from labelled rows whose crc32(doc_id) isn't 0 modulo `modulus`; at most rows_per_class of each label."""
    sample = written(labelled_sample(docs, marks, "toxic", rows_per_class, fold_of("doc_id", modulus) != 0), "labelled")
    sample = written(distinct_texts(sample), "distinct")
    of_label = dict(map(tuple, sample.groupBy("label").count().collect()))
    n_bad, n_good = of_label.get(1, 0), of_label.get(0, 0)
    if not n_bad or not n_good:
        rate = n_bad / (n_bad + n_good) if of_label else 0.0
        return Lexicon(coefficients=(math.log((rate + 1e-9) / (1 - rate + 1e-9)), 0.0, 0.0))
    found = terms_of(sample, n_bad, n_good, least)
    weights = {t: math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1)) for t, b, g in found}
    lexicon = Lexicon(weights, EXCEPTIONS + exceptions(sample, [t for t, _, g in found if g]))
    fitted = fitted_features(sample, lexicon)
    lexicon.coefficients = tuple(logistic(fitted[:, :2], fitted[:, 2]))
    return lexicon


def exceptions(sample: DataFrame, terms: list[str], least: int = 3) -> tuple[str, ...]:
    """Pairs of a term and a neighbour in at least `least` documents of label 0 and in none of label 1."""
    if not terms:
        return ()
    known = set(terms)

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if (a in known or b in known) and a.isalpha() and b.isalpha()}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(pairs), pa.string()), pa.array([label] * len(pairs), pa.int32())], names=["pair", "label"])

    pairs = sample.select("text", "label").mapInArrow(run, "pair string, label int").groupBy("pair").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    return tuple(r[0] for r in pairs.where((F.col("bad") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "pair").collect())


def fitted_features(sample: DataFrame, lexicon: Lexicon) -> np.ndarray:
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            made = [features(automaton, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.float64()), batch.column(1)], names=["total", "dense", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "total double, dense double, label int").collect()
    return np.array(sorted(map(tuple, rows)), np.float64).reshape(-1, 3)


def score(docs: DataFrame, lexicon: Lexicon, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    a, b, c = lexicon.coefficients

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            made = [features(automaton, x.as_py()) for x in batch.column(1)]
            scores = np.array([1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * m[0] + c * m[1])))) for m in made], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([m[2] for m in made], pa.int64())], names=["doc_id", "score", "predicted", "n_matches"])

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_matches long")
    return made.select("doc_id", F.coalesce(fold_of("doc_id", modulus) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_matches")
