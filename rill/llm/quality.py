"""Quality rules: text statistics in native expressions, and a decision list learned from labelled statistics.

The list is learned by sequential covering. A rule is a conjunction of thresholds on rates; it is grown on two
thirds of the labelled rows by information gain, then pruned on the last third by dropping conditions from its
end. Accepted rules take the rows they cover out of the set, and the next is learned on the rest. The list
becomes ordered `when` clauses of one Spark expression.

The classifier is fitted on at most `SAMPLE` labelled documents, those with the smallest XXH64 of doc_id.
Statistics and verdicts are made for all rows, over whole texts, without Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rill.llm.common import SPACE_CHARS, words

SAMPLE = 20_000
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A rule must be right in this share of the rows it rejects, on those it was pruned on.
MIN_PRECISION = 0.9
MIN_COVERED = 5
MAX_CONDITIONS, MAX_RULES, CUTS = 4, 16, 64

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("n_words", "mean_word", "symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "bang_rate")


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with a struct `rill_stats`: the base counts, `base_failed` and the rates that rules look at.

    Null and blank texts have no words; all their counts are 0 and they fail the base rule. Needs a column
    `text`; all others are carried along.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w, h, at = F.col("rill_words"), F.col("rill_hashes"), F.col("rill_at")
    n = F.size(w)
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    starts = F.when(n > WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    window_hash = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    #: Sorted (hash, start) pairs, only of texts in which some window comes twice.
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pair = F.col("rill_pairs")
    same = lambda x, j: (x["h"] == F.get(pair, j - 1)["h"]) | (x["h"] == F.get(pair, j + 1)["h"])
    twice = F.transform(F.filter(pair, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])
    covered = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))
    steps = (
        docs.withColumn("rill_words", words(F.col("text").cast("string")))
        .withColumn("rill_lines", filled)
        .withColumn("rill_hashes", F.transform(starts, window_hash))
        .withColumn("rill_pairs", F.sort_array(pairs))
        .withColumn("rill_at", F.sort_array(twice))
    )
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join(w, "")), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("rill_lines") - F.size(F.array_distinct("rill_lines")), "n_repeat_words": repeats,
        "n_lines": F.size("rill_lines"), "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")), "n_bang": F.regexp_count(text, F.lit("!")),
    }
    #: The one-element explosion keeps the optimizer from pushing later filters, with all of this in them, below it.
    once = F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))
    counted = steps.withColumn("rill_counts", F.explode_outer(once))
    c = lambda k: F.col(f"rill_counts.{k}")
    per = lambda a, b: F.lit(100.0) * c(a) / F.greatest(c(b), F.lit(1))
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    stats = F.struct(
        *(c(k).alias(k) for k in BASE), failed.alias("base_failed"),
        (c("word_chars") / F.greatest(c("n_words"), F.lit(1))).alias("mean_word"), per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"), per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_upper", "word_chars").alias("upper_rate"), per("n_bang", "n_words").alias("bang_rate"),
    )
    return counted.withColumn("rill_stats", stats).drop(
        "rill_words", "rill_lines", "rill_hashes", "rill_pairs", "rill_at", "rill_counts"
    )


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.rate} {'>' if self.above else '<='} {self.cut:g}"

    def holds(self, rates: np.ndarray) -> np.ndarray:
        column = rates[:, RATES.index(self.rate)]
        return column > self.cut if self.above else column <= self.cut

    def column(self) -> Column:
        value = F.col(f"rill_stats.{self.rate}")
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rates: np.ndarray) -> np.ndarray:
    held = np.ones(len(rates), bool)
    for c in rule:
        held &= c.holds(rates)
    return held


def _candidates(rates: np.ndarray) -> list[Condition]:
    out = []
    for k, name in enumerate(RATES):
        values = np.unique(rates[:, k])
        if len(values) > CUTS:
            values = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="nearest"))
        cuts = (values[1:] + values[:-1]) / 2
        out += [Condition(name, above, float(c)) for c in cuts for above in (True, False)]
    return out


def _grow(rates: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions by FOIL's information gain until only bad rows are covered."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        share = np.log2(max(bad[inside].mean(), 1e-9))
        best, gain, kept = None, 1e-6, inside
        for c in _candidates(rates[inside]):
            held = inside & c.holds(rates)
            p = int((held & bad).sum())
            if p and (g := p * (np.log2(p / held.sum()) - share)) > gain:
                best, gain, kept = c, g, held
        if best is None:
            break
        rule, inside = (*rule, best), kept
    return rule


def _prune(rule: Rule, rates: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (right - wrong) / covered; the shorter of equals."""

    def worth(r: Rule) -> float:
        held = _covered(r, rates)
        return (2 * int((held & bad).sum()) - int(held.sum())) / max(int(held.sum()), 1) if r else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn_rules(rates: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Rules that reject, in order. `rates` has a row for each labelled document, columns as `RATES`."""
    rules: list[Rule] = []
    left, pruning = np.ones(len(bad), bool), np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~pruning, left & pruning
        if not bad[grow].any():
            break
        rule = _grow(rates[grow], bad[grow])
        if not rule:
            break
        rule = _prune(rule, rates[prune], bad[prune])
        held, checked = _covered(rule, rates) & left, _covered(rule, rates) & prune
        wrong = int((checked & ~bad).sum())
        if held.sum() < MIN_COVERED or wrong > (1 - MIN_PRECISION) * checked.sum() or not (held & bad).sum() >= MIN_PRECISION * held.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from `labels` (doc_id, quality: 1 good, 0 bad) of at most `sample` documents; no labels, no rules.

    The sample's ids are broadcast, and a row for each comes to the driver: `sample` bounds both. Of several labels
    of a document the smallest counts, of several documents of an id the one of the smallest rates.
    Documents that fail the base rule teach nothing and are left out.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("rill_id"))
    chosen = quality.agg(F.min("quality").alias("rill_quality")).orderBy(F.xxhash64("rill_id"), "rill_id").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long").alias("rill_id"), "text").join(F.broadcast(chosen), "rill_id")
    stats = with_statistics(joined).where("not rill_stats.base_failed")
    one = F.min(F.struct("rill_quality", *(f"rill_stats.{k}" for k in RATES))).alias("one")  # of rows with one id
    rows = stats.groupBy("rill_id").agg(one).select("rill_id", "one.*").collect()
    if not rows:
        return []
    rows.sort(key=lambda r: tuple(r))
    rates = np.array([[float(v) for v in r[2:]] for r in rows])
    order = np.random.default_rng(0).permutation(len(rows))
    return learn_rules(rates[order], np.array([r[1] == 0 for r in rows])[order])


def verdict(rules: list[Rule]) -> Column:
    """Whether a document is kept: the first rule that holds rejects it."""
    if not rules:
        return ~F.col("rill_stats.base_failed")
    out = F.when(F.col("rill_stats.base_failed"), False)
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = out.when(held, False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, base counts, base_failed, kept) of every row of `docs`; repeated rows and null ids are kept."""
    judged = with_statistics(docs.select("doc_id", "text")).withColumn("kept", verdict(rules))
    return judged.select("doc_id", *(f"rill_stats.{k}" for k in (*BASE, "base_failed")), "kept")


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    return with_statistics(docs).where(verdict(rules)).drop("rill_stats")
