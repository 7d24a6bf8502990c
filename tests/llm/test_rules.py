"""Decision lists and rule ensembles against a plain evaluation of their conditions, values on thresholds included."""

import numpy as np

from lumenfold.llm import quality, rulelist

VALUES = [(i, float(i % 5), float(i // 5)) for i in range(25)] + [(99, None, 1.0)]


def holds(row, rule):
    return all(row[n] is not None and (row[n] > t if up else row[n] <= t) for n, up, t in rule)


def test_list_rejects_by_its_first_rule_that_holds(spark):
    df = spark.createDataFrame(VALUES, "id long, a double, b double")
    rules = (((("a", True, 2.0)), ("b", False, 1.0)), (("b", True, 3.0),), (("a", False, 0.0), ("b", True, 2.0)))
    for some in ((), rules[:1], rules):
        model = rulelist.DecisionList(some)
        for r in df.select("*", model.keeps().alias("kept")).collect():
            assert r.kept == (not any(holds(r, rule) for rule in some)), (r, some)


def test_cover_finds_planted_rules_and_prunes_conditions():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 4, (4000, 3))
    bad = ((cells[:, 0] > 2) & (cells[:, 1] <= 0)) | (cells[:, 2] > 2)
    thresholds = [(n, [0.5, 1.5, 2.5]) for n in "xyz"]
    prune = rng.random(4000) < 0.33
    rules = rulelist.cover(cells, bad.astype(float), (~bad).astype(float), prune, thresholds, 12, 3, 0.9)
    at = {n: i for i, n in enumerate("xyz")}
    covered = np.zeros(4000, bool)
    for rule in rules:
        here = np.all([cells[:, at[n]] - 0.5 > t - 1 if up else cells[:, at[n]] - 0.5 <= t - 1 for n, up, t in rule], axis=0)
        new = here & ~covered
        assert bad[new].sum() >= 3 and bad[new].mean() >= 0.9  # of what earlier rules leave
        covered |= here
    assert (covered == bad).all() and {frozenset((n, up) for n, up, _ in r) for r in rules} == {frozenset({("z", True)}), frozenset({("x", True), ("y", False)})}
    assert rulelist.cover(cells, np.zeros(4000), np.ones(4000), prune, thresholds, 12, 3, 0.9) == []


def test_ensemble_scores_values_on_thresholds(spark):
    rules, weights = ((("a", True, 2.0),), (("a", False, 2.0), ("b", False, 3.0)), (("b", True, 4.0),)), (1.5, -0.75, 2.0)
    model = quality.RuleEnsemble(rules, weights, -0.25)
    df = spark.createDataFrame([v for v in VALUES if v[1] is not None], "id long, a double, b double")
    for r in df.select("*", model.score().alias("score")).collect():
        z = -0.25 + sum(w for rule, w in zip(rules, weights) if holds(r, rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12
