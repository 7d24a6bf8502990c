"""Quality classifier as a sparse rule ensemble.

Paths of a forest's trees become conjunctive rules over statistics of the text, a lasso logistic regression keeps few of
them, and the kept rules with their weights are one Spark column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import crc_of_id, table, training_sample, written
from lumenfold.llm.textstats import RATIOS, with_statistics

#: Labelled documents that a model is fitted on, at most.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3

#: (statistic, True for > and False for <=, threshold)
Condition = tuple[str, bool, float]


def condition(c: Condition) -> Column:
    name, above, threshold = c
    return F.col(name) > threshold if above else F.col(name) <= threshold


def conjunction(rule: tuple[Condition, ...]) -> Column:
    return reduce(and_, map(condition, rule))


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + the weights of the rules that hold)."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        parts = [F.when(conjunction(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        return 1 / (1 + F.exp(-reduce(add, parts, F.lit(self.intercept))))


def paths(model, names: list[str]) -> list[tuple[Condition, ...]]:
    """Each way from a root to a node as a conjunction, of each statistic the tightest bounds; no rule twice."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node, held: dict[tuple[str, bool], float]) -> None:
        if held:
            found.setdefault(tuple(sorted((n, up, t) for (n, up), t in held.items())))
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        for child, up, tighter in ((node.leftChild(), False, min), (node.rightChild(), True, max)):
            walk(child, held | {(name, up): tighter(held.get((name, up), at), at)})

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), {})
    return list(found)


def fit(train: DataFrame, names: list[str] = RATIOS, trees: int = 12, depth: int = 3, strength: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """The ensemble of train(label double, statistics). With labels of one kind or none it has no rules, and scores the share of 1 (none: 0.5)."""
    n, ones = train.agg(F.count("label"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max((ones or 0) / n if n else 0.5, 1e-3), 1 - 1e-3)
        return RuleEnsemble((), (), math.log(share / (1 - share)))
    rows = train.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=max(1, min(20, n // 50)), subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed).fit(rows)
    rules = paths(forest, names)
    if not rules:
        return RuleEnsemble((), (), math.log(ones / (n - ones)))
    # rows in which the same rules hold count once, by their number: few rows, for many iterations
    held = train.select("label", F.array(*[conjunction(r).cast("double") for r in rules]).alias("held")).groupBy("label", "held").agg(F.count("*").cast("double").alias("n"))
    inputs = written(held.select("label", "n", array_to_vector("held").alias("features")).coalesce(1), "rules")  # no more rows than the sample
    lasso = LogisticRegression(weightCol="n", elasticNetParam=1.0, regParam=strength, maxIter=60, standardization=False).fit(inputs)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, score, predicted int, statistics); learns from labels(doc_id, quality) outside the held-out fold.

    Null, empty and one-word texts have statistics (zeros) and a score like any other; rows that repeat are scored each; an empty table gives
    no rows. The score sees nothing but the text.
    """
    stats = written(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    sample = training_sample(labels, "quality", 5, 0, max_rows)
    train = written(stats.join(F.broadcast(sample), "doc_id").select("label", *RATIOS).repartition(4), "training")  # at most max_rows labels
    model = fit(train)
    return stats.withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored from labels of four fifths of the labelled ones."""
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns.

    Rows are written with their statistics once: the model is fitted on that table and its rules then filter it. Without that table
    the filter would be pushed below the statistics and work them out again for each condition of each rule.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stats = written(with_statistics(docs.select(row, F.col("text").alias("_text")), "_text").drop("_text"), "statistics")
    sample = F.broadcast(training_sample(labels, "quality", 5, 0, MAX_TRAINING_ROWS))
    train = written(stats.withColumn("doc_id", F.col("_row.doc_id")).join(sample, "doc_id").select("label", *RATIOS).repartition(4), "training")
    return stats.where(fit(train).score() >= THRESHOLD).select("_row.*")
