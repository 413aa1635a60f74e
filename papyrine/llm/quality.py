"""Quality rules: counts of every text, two fixed rules, and a learnt decision list, all in DataFrame functions.

measured() gives the counts of each text by built-in functions; a text's 5-word windows are compared within its own row (and only
where hashes of its windows show a repeat are the windows themselves put side by side), so nothing is exploded or shuffled.

learn() reads a bounded sample of labelled texts' statistics and runs sequential covering: a rule grows by the threshold condition
with the best information gain on two thirds of the sample, is pruned on the other third by dropping trailing
conditions, and is kept if it is precise there; the texts it covers go, and the next rule is grown. rejected() turns the list
into one ordered conditional expression.

Edge cases: null and empty texts have zero counts, and fail the fixed rule on few words; very long texts are counted whole; without
labels of both kinds (an empty table among others) the list is empty; ties between conditions go to the first statistic and the
lowest threshold; repeated rows stay, each judged; rows with a null doc_id are judged and not learnt from; judged() doesn't use
further columns of docs, filtered() hands them on, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What the rules may test.
STATISTICS = ("n_words", "mean_chars", "symbols_per_word", "duplicate_lines", "repeated_words", "distinct_words", "capitals", "marks_per_word")


def _without(column: Column, signs: str) -> Column:
    return F.translate(column, signs, "")


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array, the first occurrence included."""
    places = F.when(F.size(words) > WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(_):
        windows = F.transform(places, lambda i: F.struct(F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i")))
        return F.array_sort(windows)

    def count(windows):
        # places of windows equal to a neighbour in sorted order, then each adds the words up to the next one's start
        marked = F.transform(windows, lambda x, k: F.when((x.w == F.get(windows, k - 1).w) | (x.w == F.get(windows, k + 1).w), x.i))
        starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc.n + WINDOW - F.greatest(acc.end - i, F.lit(0))).alias("n")), lambda acc: acc.n)

    distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
    # a one-element array holds the sorted windows once for all their uses
    return F.when(distinct, 0).otherwise(F.element_at(F.transform(F.array(covered(words)), count), 1)).cast("long")


def measured(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, `extra` columns and the counts and statistics of each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    out = docs.select("doc_id", *extra, F.array_remove(F.split(plain, " "), "").alias("words"), lines.alias("lines"))
    out = out.withColumn("joined", F.array_join("words", ""))
    return out.select(
        "doc_id", *extra, F.size("words").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(_without(F.col("joined"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("joined") - F.length(_without(F.col("joined"), CAPITALS))).alias("n_capitals"),
        (F.length("joined") - F.length(_without(F.col("joined"), "!?"))).alias("n_marks"),
    )


def with_statistics(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns({
        "mean_chars": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words, "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words, "distinct_words": F.col("n_distinct") / words, "capitals": F.col("n_capitals") / chars, "marks_per_word": F.col("n_marks") / words,
    })


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.statistic] > self.threshold if self.above else row[self.statistic] <= self.threshold

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _best_condition(rows: list[dict], cuts: int) -> tuple[float, Condition] | None:
    """FOIL's gain: rejected rows kept, times the growth of the log of their share."""
    p0 = sum(r["bad"] for r in rows)
    before = math.log2(p0 / len(rows))
    best = None
    for name in STATISTICS:
        ordered = sorted((r[name], r["bad"]) for r in rows)
        values = [v for v, _ in ordered]
        places = sorted({len(values) * k // cuts for k in range(1, cuts)} | {k for k in range(1, len(values)) if ordered[k][1] != ordered[k - 1][1]} if len(values) <= 4 * cuts else {len(values) * k // cuts for k in range(1, cuts)})
        low, at = 0, 0
        for k in places:
            if not values[k - 1] < values[k]:
                while k < len(values) and values[k] == values[k - 1]:
                    k += 1
                if k >= len(values):
                    continue
            low += sum(b for _, b in ordered[at:k])
            at = max(at, k)
            middle = (values[k - 1] + values[k]) / 2
            for above, p, n in ((False, low, k), (True, p0 - low, len(values) - k)):
                if p and n < len(values):
                    gain = p * (math.log2(p / n) - before)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, Condition(name, above, middle))
    return best


def _grown(rows: list[dict], cuts: int, conditions: int) -> Rule:
    rule: Rule = ()
    while len(rule) < conditions and any(not r["bad"] for r in rows) and any(r["bad"] for r in rows):
        found = _best_condition(rows, cuts)
        if found is None or found[0] <= 0:
            break
        rule += (found[1],)
        rows = [r for r in rows if found[1].holds(r)]
    return rule


def _pruned(rule: Rule, rows: list[dict]) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on rows it wasn't grown on; the shorter of equal ones."""

    def worth(k: int) -> tuple[float, int]:
        hit = _covers(rule[:k], rows)
        p = sum(r["bad"] for r in hit)
        return ((2 * p - len(hit)) / len(hit) if hit else -1.0, -k)

    return rule[: max(range(1, len(rule) + 1), key=worth)]


def decision_list(rows: list[dict], rules: int = 12, conditions: int = 4, cuts: int = 64, precision: float = 0.97, least: int = 3) -> list[Rule]:
    """Ordered rules that reject; rows: statistics, `bad` 0 or 1 and `part`, 0 to 2 (2: pruning)."""
    out: list[Rule] = []
    while len(out) < rules:
        grow, prune = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
        if not any(r["bad"] for r in grow) or all(r["bad"] for r in grow):
            break
        rule = _grown(grow, cuts, conditions)
        if not rule:
            break
        rule = _pruned(rule, prune) if prune else rule
        hit = _covers(rule, rows)
        p = sum(r["bad"] for r in hit)
        if p < least or p < precision * len(hit):
            break
        out.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return out


def learn(docs: DataFrame, marks: DataFrame, rows_per_class: int = 4000, **how) -> list[Rule]:
    """The list from the statistics of at most rows_per_class labelled documents of each quality (1: good). Those that fail the
    fixed rules are left out: the list only has to judge the others."""
    sample = labelled_sample(docs, marks, "quality", rows_per_class)
    # the flag is tested here and not by a filter, which Spark would push below the counts and work them out again for
    rows = with_statistics(measured(sample, ["label"])).select("label", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)).alias("part"), "doc_id", base_failed().alias("failed"), *STATISTICS)
    got = [{"bad": 1 - r["label"], **r.asDict()} for r in rows.collect() if not r["failed"]]
    return decision_list(sorted(got, key=lambda r: r["doc_id"]), **how)


def rejected(rules: list[Rule]) -> Column:
    """The number of the first rule that a row of with_statistics() falls under, or null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        condition = rules[k][0].column()
        for c in rules[k][1:]:
            condition &= c.column()
        out = F.when(condition, k).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rule that rejects, for each row of docs."""
    made = with_statistics(measured(docs)).withColumn("rule", rejected(rules))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.col("rule").isNull()).alias("kept"), "rule")


def filtered(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, with all their columns, that neither the fixed rules nor the list reject."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    made = with_statistics(measured(rows, ["row"])).withColumn("kept", ~base_failed() & rejected(rules).isNull())
    # an array of the row or of none: a filter would be pushed below the counts, and each of its terms would repeat them
    return made.select(F.explode(F.when(F.col("kept"), F.array("row")).otherwise(F.slice(F.array("row"), 1, 0))).alias("row")).select("row.*")
