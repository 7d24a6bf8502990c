"""Quality rules as a learned decision list, in DataFrame operations only.

Sequential covering: on the labelled statistics a conjunction of threshold conditions is grown by information gain on two thirds of them,
pruned on the rest, and what it covers is set aside, until no rule is worth keeping. The list is one ordered conditional column.
Labelled rows are first counted by the cells of a threshold grid, so the covering itself works on counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import table, training_sample, written
from lumenfold.llm.quality import MAX_TRAINING_ROWS, Condition, conjunction
from lumenfold.llm.textstats import RATIOS, with_statistics

#: Quantiles of each class that serve as thresholds.
GRID = [0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.975, 0.99, 1.0]


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each of which rejects; a text that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        column = None
        for rule in self.rules:
            column = F.when(conjunction(rule), F.lit(False)) if column is None else column.when(conjunction(rule), F.lit(False))
        return F.lit(True) if column is None else column.otherwise(F.lit(True))


def cover(cells: np.ndarray, bad: np.ndarray, good: np.ndarray, prune: np.ndarray, thresholds: list[tuple[str, list[float]]], max_rules: int, max_conditions: int, precision: float) -> list[tuple[Condition, ...]]:
    """Rules for the cells of a grid: cells[i, f] counts the thresholds of statistic f that row i is above."""
    options = [(f, up, j) for f, (_, ts) in enumerate(thresholds) for j in range(len(ts)) for up in (True, False)]
    holds = lambda o: cells[:, o[0]] > o[2] if o[1] else cells[:, o[0]] <= o[2]
    table_ = np.array([holds(o) for o in options]) if options else np.zeros((0, len(cells)), bool)
    left, rules = np.ones(len(cells), bool), []
    gain_of = lambda p, n: np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9))
    for _ in range(max_rules):
        grow, check = left & ~prune, left & prune
        inside, chosen = grow.copy(), []
        while len(chosen) < max_conditions:
            p0, n0 = bad[inside].sum(), good[inside].sum()
            if not p0 or not n0:
                break
            p, n = table_[:, inside] @ bad[inside], table_[:, inside] @ good[inside]
            gain = p * (gain_of(p, n) - gain_of(p0, n0))
            best = int(np.argmax(gain))
            if gain[best] <= 1e-6:
                break
            chosen.append(best)
            inside &= table_[best]
        while chosen:  # prune from the end while that doesn't lower worth on the other rows
            worth = lambda c: (lambda m: (bad[m].sum() - good[m].sum()) / max(bad[m].sum() + good[m].sum(), 1))(check & table_[c].all(0))
            if len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
                chosen.pop()
            else:
                break
        covered = left & (table_[chosen].all(0) if chosen else False)
        p, n = bad[covered].sum(), good[covered].sum()
        if not chosen or p < 3 or p < precision * (p + n):
            break
        rules.append(tuple((thresholds[options[o][0]][0], options[o][1], thresholds[options[o][0]][1][options[o][2]]) for o in chosen))
        left &= ~covered
    return rules


def fit(train: DataFrame, names: list[str] = RATIOS, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.9) -> DecisionList:
    """The list for train(doc_id, label, statistics): a rule covers at least 3 rows of label 0, which are at least `precision` of what it covers.

    Without rows of both labels the list is empty and keeps all.
    """
    quantiles = train.groupBy("label").agg(*[F.percentile_approx(n, GRID, 1000).alias(n) for n in names]).collect()  # two rows
    if len(quantiles) < 2:
        return DecisionList(())
    thresholds = [(n, sorted({float(t) for q in quantiles for t in q[n]})) for n in names]
    cell = [reduce(add, [(F.col(n) > t).cast("int") for t in ts]).alias(n) for n, ts in thresholds]
    counted = train.select("label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *cell).groupBy("prune", *names)
    rows = counted.agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).orderBy("prune", *names).collect()  # no more than the sample
    grid = np.array([[r[n] for n in names] for r in rows])
    count = lambda k: np.array([r[k] for r in rows], float)
    return DecisionList(tuple(cover(grid, count("bad"), count("good"), count("prune") > 0, thresholds, max_rules, max_conditions, precision)))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, the base counts, ratios, base_failed, kept).

    Null and empty texts have no words and fail the base rule; rows that repeat are judged each; an empty table gives no rows.
    """
    stats = written(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    sample = training_sample(labels, "quality", 5, 0, max_rows)
    rules = fit(written(stats.join(F.broadcast(sample), "doc_id").select("doc_id", "label", *RATIOS).repartition(4), "training"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.keeps())


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by the base rule and the learned list."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
