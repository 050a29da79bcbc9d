"""The registered calibrations run chains long enough to converge."""

import numpy as np
import pytest

from levelcast.operators import bayes
from levelcast.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["bayes_joint"])
def test_chains_of_every_series_converge(name, spark):
    found = registry.queries()[name](spark, SF).toPandas()
    assert found.groupby(["priority", "nation"]).ngroups > 100 and found.converged.all()


def test_the_hierarchical_query_keeps_as_many_draws_as_its_operator(spark, monkeypatch):
    given = {}

    def caught(*args, **options):
        given.update(options)
        raise StopIteration

    monkeypatch.setattr(bayes, "hierarchical", caught)
    with pytest.raises(StopIteration):
        registry.queries()["bayes_hierarchical"](spark, SF)
    assert given.get("keep", 600) >= 600


def blocks_of(spark, chains):
    """Written chains of plain arrays (chain, step, walker, parameter)."""
    rows = []
    for c, x in enumerate(chains):
        for b, part in enumerate(np.array_split(x, bayes.BLOCKS)):
            points = part.reshape(-1, x.shape[-1])
            mean = points.mean(axis=0)
            rows.append(("s", c, b, ["p", "q"], len(points), mean.tolist(), ((points - mean) ** 2).sum(axis=0).tolist()))
    return spark.createDataFrame(rows, "k string, chain int, block int, params array<string>, n long, mean array<double>, m2 array<double>")


def test_merged_moments_equal_those_of_all_points(spark):
    pick = np.random.default_rng(3)
    chains = [pick.normal([0.1 * c, 5], [1, 1e-4], (200, 8, 2)) for c in range(4)]
    got = bayes.diagnostics(blocks_of(spark, chains), ["k"]).toPandas().set_index("param")
    halves = np.array([h.reshape(-1, 2) for c in chains for h in (c[:100], c[100:])])
    within, n = halves.var(axis=1, ddof=1).mean(axis=0), halves.shape[1]
    pooled = (n - 1) / n * within + halves.mean(axis=1).var(axis=0, ddof=1)
    assert np.allclose(got.r_hat[["p", "q"]], np.sqrt(pooled / within)) and np.allclose(got["std"][["p", "q"]], np.sqrt(pooled))
    assert np.allclose(got["mean"][["p", "q"]], halves.mean(axis=(0, 1)))
    means = np.array([x.reshape(-1, 2).mean(axis=0) for c in chains for x in np.array_split(c, bayes.BLOCKS)])
    assert np.allclose(got.ess[["p", "q"]], np.minimum(len(means) * pooled / means.var(axis=0, ddof=1), 6400))
    assert got.r_hat["p"] > 1.004 > got.r_hat["q"]


def test_a_chain_does_not_depend_on_the_series_beside_it(spark):
    t = np.arange(30) / 4
    rows = [(k, float(x), 0.5, float(np.sin(3 * x + k)), 0.3) for k in range(5) for x in t[: 20 + 2 * k]]
    df = spark.createDataFrame(rows, "k int, t double, temp double, level double, sigma double")
    run = lambda d: {(r.k, r.chain, r.block): r.mean for r in bayes.chains(d, bayes.level_model, ["k"], walkers=12, burn=20, keep=20, count=2, moves="mixed").collect()}
    every, two = run(df), run(df.filter("k >= 3"))
    assert len(every) == 5 * 2 * bayes.BLOCKS and len(two) == 2 * 2 * bayes.BLOCKS
    assert all(np.allclose(every[k], m, rtol=1e-6) for k, m in two.items())


def test_relaxation_of_arrays_equals_one_step_at_a_time():
    t, f = np.cumsum(np.random.default_rng(0).random(40)), np.random.default_rng(1).normal(size=(3, 1, 40))
    tau = np.array([[0.001, 2.0], [5.0, 1e7], [30.0, 0.5]])
    got = bayes.relax(t[None, None], f, tau)
    for i in range(3):
        for j in range(2):
            s = [f[i, 0, 0]]
            for k in range(1, 40):
                m = (f[i, 0, k] + f[i, 0, k - 1]) / 2
                s.append(f[i, 0, k] if tau[i, j] < 0.01 else s[-1] if tau[i, j] >= 1e6 else m + (s[-1] - m) * np.exp(-(t[k] - t[k - 1]) / tau[i, j]))
            assert np.allclose(got[i, j], s)
