"""Stacking weights against a grid, and inverse skew-normals against bisection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelcast.functions import stats
from levelcast.operators import skewed, stacking


def test_weights_equal_those_of_a_grid():
    pick = np.random.default_rng(6)
    for _ in range(5):
        table = pick.normal(size=(30, 3)) - np.array([0.0, 0.3, 1.0])
        score = lambda w: float(np.log(np.exp(table) @ w).mean())
        grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
        best = max(grid, key=score)
        found = stacking.em_weights(table)
        assert np.abs(found - best).max() < 0.011 and score(found) >= score(best) - 1e-8 and found.sum() == pytest.approx(1)


def test_a_line_is_found_by_its_future_and_folds_have_influence(spark):
    pick = np.random.default_rng(9)
    t = np.arange(80) / 4
    rows = [(k, float(x), float((0.5 * x if k else 0) + 0.1 * pick.normal())) for k in (0, 1) for x in t]
    df = spark.createDataFrame(rows, "k int, t double, y double")
    ends = spark.createDataFrame([(e,) for e in (8.0, 10.0, 12.0, 14.0)], "end double")
    scores = stacking.fold_scores(df, "y", "t", ["k"], ends, {"flat": 0, "line": 1, "curve": 2}, 2.0)
    weights, influence = stacking.stacked(scores, ["k"])
    w = weights.toPandas().set_index(["k", "model"]).weight
    assert w[1, "line"] > 0.7 and w[1, "flat"] < 0.05 and w[0, "flat"] > 0.5 and w.groupby("k").sum().to_numpy() == pytest.approx([1, 1])
    own = scores.filter("k = 1").toPandas().pivot_table(index=["end", "t"], columns="model", values="log_density")
    assert stacking.em_weights(own.to_numpy())[list(own.columns).index("line")] == pytest.approx(w[1, "line"])
    f = influence.toPandas()
    assert len(f) == 2 * 4 * 3 and f.moved.between(0, 1).all() and f.groupby(["k", "end"]).weight.sum().to_numpy() == pytest.approx(np.ones(8))


def test_inverse_equals_bisection(spark):
    cases = [(a, u) for a in (-12.0, -2.0, 0.0, 0.5, 3.0, 20.0) for u in (1e-6, 0.01, 0.17, 0.5, 0.83, 0.999, 1 - 1e-6)]
    cells = skewed.with_grid(spark.createDataFrame(sorted({(a,) for a, _ in cases}), "alpha double"))
    rows = spark.createDataFrame(cases, "alpha double, u double").join(F.broadcast(cells), "alpha")
    for r in skewed.inverse(rows, "u", "x").select("alpha", "u", "x").collect():
        assert r.x == pytest.approx(stats.skew_normal_quantile(r.u, r.alpha), abs=2e-4 if abs(r.alpha) > 10 else 1e-6), r


def test_draws_have_the_cells_quantiles(spark):
    fits = spark.createDataFrame([("a", 1.0, 2.0, 4.0), ("b", -3.0, 0.5, -1.0)], "k string, loc double, scale double, alpha double")
    d = skewed.sampled(fits, spark.range(4000).withColumnRenamed("id", "sample_id"), ["k"]).toPandas()
    for k, loc, scale, alpha in (("a", 1.0, 2.0, 4.0), ("b", -3.0, 0.5, -1.0)):
        own = d[d.k == k].value
        for p in (0.05, 0.5, 0.95):
            assert (own <= loc + scale * stats.skew_normal_quantile(p, alpha)).mean() == pytest.approx(p, abs=4 * np.sqrt(p * (1 - p) / 4000))
