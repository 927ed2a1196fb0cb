"""Attributions against all subsets, the parameter search, batched scoring, calibration, factors and text vectors."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from sparrowmill.operators import attribution, models, tuning


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    made = []
    for n in range(400):
        a, b, c, k = rng.random(), rng.random(), rng.random(), rng.choice("xyz")
        made.append((n, a, b, c, k, float(a + b * (k == "x") + 0.3 * rng.random() > 0.9), n % 4 == 0))
    return spark.createDataFrame(made, "id long, a double, b double, c double, k string, y double, held boolean")


@pytest.fixture(scope="module")
def model(data):
    return models.train_gbt(data, ["a", "b", "c"], ["k"], "y", maxIter=4, maxDepth=4)


def _value(leaves, x, known):
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for f, share, tests in zip(leaf.features, leaf.shares, leaf.tests, strict=True):
            part *= float(attribution._passes(x[f : f + 1], tests)[0]) if f in known else share
        total += part
    return total


def test_tree_attributions_equal_brute_force(spark, data, model, tmp_path):
    got, base = attribution.tree_attributions(data, model, ["a", "b", "c", "k"], "id", str(tmp_path / "trees"))
    found = {}
    for r in got.collect():
        found.setdefault(r.id, {})[r.feature] = r.attribution
    leaves, again = attribution.export(model, str(tmp_path / "again"))
    assert base == again and len(found) == 400
    scored = {r.id: r for r in model.transform(data).select("id", vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert any(t[0][2] >= 0 for leaf in leaves for tests in leaf.tests for t in tests)  # a split by categories is among them
    for n, r in scored.items():
        assert abs(sum(found[n].values()) - (r.m - base)) < 1e-9
    for n in range(0, 400, 40):
        x = np.array(scored[n].x)
        for j, name in enumerate(("a", "b", "c", "k")):
            want, others = 0.0, [f for f in range(4) if f != j]
            for size in range(4):
                for known in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += w * (_value(leaves, x, {*known, j}) - _value(leaves, x, set(known)))
            assert abs(found[n][name] - want) < 1e-9
    assert abs(_value(leaves, np.zeros(4), set()) - base) < 1e-9


def test_importance_and_dependence_follow_the_attributions(data, model, tmp_path):
    got, _ = attribution.tree_attributions(data, model, ["a", "b", "c", "k"], "id", str(tmp_path / "trees"))
    share = {r.feature: r.importance for r in models.importance(got).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and max(share, key=share.get) == "a" and share["c"] < 0.1
    top = models.dependence_of_top(data, model, models.importance(got), 2, 3).collect()
    first = sorted((float(r.value), r.mean_score) for r in top if r.feature == "a")
    assert len({r.feature for r in top}) == 2 and len(first) == 3 and first[0][1] < first[-1][1]
    text = {r.value: r.mean_score for r in models.partial_dependence(data, model, "k", 5).collect()}
    assert set(text) == {"x", "y", "z"} and text["x"] > max(text["y"], text["z"])


SPACE = {"n": tuning.Whole(1, 50), "r": tuning.Real(1e-4, 1.0, log=True), "u": tuning.Real(-5, 5), "c": tuning.Choice(("p", "q", "s"))}


def _loss(p, budget=1):
    return abs(p["n"] - 20) / 50 + abs(math.log10(p["r"]) + 2) / 4 + abs(p["u"] - 1) / 10 + (p["c"] != "q") + 0.2 / budget


def test_search_beats_random_draws_and_repeats():
    better = 0
    for seed in range(8):
        best, trials = tuning.search(SPACE, _loss, "minimize", rounds=12, width=4, budgets=(1, 1), seed=seed)
        again = tuning.search(SPACE, _loss, "minimize", rounds=12, width=4, budgets=(1, 1), seed=seed)[1]
        assert [t.params for t in trials] == [t.params for t in again] and len(trials) == 48
        assert all(1 <= t.params["n"] <= 50 and 1e-4 <= t.params["r"] <= 1 and -5 <= t.params["u"] <= 5 for t in trials)
        rng = random.Random(seed + 100)
        better += best.value < min(_loss(tuning._random(SPACE, rng)) for _ in range(48))
    assert better >= 6
    up, _ = tuning.search(SPACE, lambda p, b: -_loss(p, b), "maximize", rounds=12, width=4, budgets=(1, 1), seed=0)
    assert -up.value < 0.7


def test_search_halves():
    fits = []
    best, trials = tuning.search(SPACE, lambda p, b: fits.append(b) or _loss(p, b), "minimize", rounds=2, width=4, budgets=(1, 4), seed=3, parallelism=1)
    assert sorted(fits) == [1] * 8 + [2] * 4 + [4] * 2 and best.budget == 4
    for bad in ({"direction": "up"}, {"budgets": (4, 1)}, {"rounds": 0}):
        with pytest.raises(ValueError):
            tuning.search(SPACE, _loss, **bad)


def test_tune_fits_models(data):
    space = {"maxDepth": tuning.Whole(1, 3), "stepSize": tuning.Real(0.05, 0.5, log=True)}
    model, tried = models.tune(data, ["a", "b", "c"], ["k"], "y", "held", space, "logLoss", "minimize", rounds=1, width=3, iterations=(1, 2))
    assert len(tried) == 3 and all(1 <= p["maxDepth"] <= 3 for p, _, _ in tried) and max(b for _, b, _ in tried) == 2
    assert min(m for _, b, m in tried if b == 2) == min(m for _, b, m in tried if b == 2 and m > 0)
    assert models.score(data, model).where("probability between 0 and 1").count() == 400
    with pytest.raises(ValueError):
        models.tune(data, ["a"], [], "y", "held", metric="nothing")


def test_scores_and_calibration(data, model):
    scored = models.score(data, model)
    raw = {r.id: r.m for r in model.transform(data).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert all(abs(r.probability - 1 / (1 + math.exp(-2 * raw[r.id]))) < 1e-9 for r in scored.collect())
    iso = models.calibrate(scored, "probability", "y")(scored).select("probability", "calibrated", "y").collect()
    pairs = sorted((r.probability, r.calibrated) for r in iso)
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(pairs, pairs[1:], strict=False))
    assert abs(sum(r.calibrated for r in iso) - sum(r.y for r in iso)) < 1e-6  # pools keep their means
    sig = models.calibrate(scored, "probability", "y", "sigmoid")(scored).collect()
    assert abs(sum(r.calibrated for r in sig) - sum(r.y for r in sig)) < 1 and all(0 < r.calibrated < 1 for r in sig)


def test_factors_prefer_what_similar_users_took(spark):
    rows = [(u, i, 1.0) for u in range(20) for i in range(8) if (u % 2 == i % 2) and not (u == 0 and i == 6)]
    fitted = models.train_factors(spark.createDataFrame(rows, "u int, i int, r float"), "u", "i", "r")
    best = {r.user: r.prediction for r in models.predict_factors(fitted, 4).collect()}
    assert set(best[0]) == {0, 2, 4, 6} and set(best[1]) == {1, 3, 5, 7}
