"""Exact quantiles by refinement, and recurrences by blocks, against plain computations."""

import numpy as np
import pytest

from levelcast.operators import quantiles, sequence

QS = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p83": 0.83, "p100": 1.0}


def values():
    pick = np.random.default_rng(4)
    groups = {
        "normal": pick.normal(size=3000), "ties": pick.integers(0, 3, 2000).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(700, -0.0),
        "far": np.concatenate([pick.normal(size=900), [1e300, -1e300, 1.7e308, -1.7e308]]), None: pick.exponential(size=501) ** 5,
    }
    return {k: v.tolist() for k, v in groups.items()}


@pytest.mark.parametrize("limit", [5, 100, 10_000])
def test_quantiles_equal_those_of_sorted_values(spark, limit):
    groups = values()
    rows = [(k, x) for k, v in groups.items() for x in v] + [("ties", None), ("empty", None), ("normal", float("nan"))]
    got = {r.k: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], QS, limit).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v)
        for name, q in QS.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-300), (k, name)


def test_quantiles_of_a_whole_table_and_of_several_keys(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0)
    df = spark.range(10_000).selectExpr("id % 2 AS a", "id % 3 AS b", "double(id * 7919 % 10007) AS x")
    table = df.toPandas()
    got = quantiles.exact_quantiles(df, "x", ["a", "b"], QS, 50).collect()
    for r in got:
        assert r.p83 == pytest.approx(np.quantile(table.x[(table.a == r.a) & (table.b == r.b)], 0.83))
    assert len(got) == 6 and quantiles.exact_quantiles(df, "x", [], {"m": 0.5}, 50).first().m == pytest.approx(np.quantile(table.x, 0.5))
    assert quantiles.exact_quantiles(df.filter("x < 0"), "x", ["a"], QS).count() == 0
    with pytest.raises(Exception, match="infinite"):
        quantiles.exact_quantiles(spark.createDataFrame([(float("inf"),)], "x double"), "x", [], QS).collect()


def stepped(t, f, tau, start=None):
    s = [f[0] if start is None or tau < 0.01 else start]
    for i in range(1, len(t)):
        m = (f[i] + f[i - 1]) / 2
        s.append(f[i] if tau < 0.01 else m + (s[-1] - m) * np.exp(-(t[i] - t[i - 1]) / tau))
    return np.array(s)


@pytest.mark.parametrize("start", [None, 3.0])
def test_blocks_equal_one_step_at_a_time(spark, start):
    pick = np.random.default_rng(8)
    rows, want = [], {}
    for k, (tau, n) in enumerate([(0.005, 30), (0.01, 200), (0.3, 500), (5.0, 400), (80.0, 300), (1e6, 50), (2.0, 1), (1.0, 60)]):
        # uneven steps, some over many blocks
        t = np.cumsum(np.where(pick.random(n) < 0.05, 90.0, pick.random(n)))
        f = pick.normal(size=n)
        name = None if k == 7 else f"s{k}"
        rows += [(name, tau, float(a), float(b)) for a, b in zip(t, f, strict=True)]
        want[name] = (t, stepped(t, f, tau, start))
    got = sequence.relaxation(spark.createDataFrame(rows, "k string, tau double, t double, f double"), "f", "t", "tau", "state", ["k"], start).toPandas()
    for name, (t, s) in want.items():
        own = got[got.k.isna() if name is None else got.k == name].sort_values("t")
        assert np.allclose(own.t, t) and np.allclose(own.state, s, rtol=1e-9, atol=1e-12), name


def test_a_long_series_is_dealt_to_blocks(spark):
    n = 400_000
    df = spark.range(n).selectExpr("1 AS k", "2.0D AS tau", "id / 12.0D AS t", "double(sin(id / 100.0D)) AS f")
    got = sequence.relaxation(df, "f", "t", "tau", "state", ["k"])
    t = np.arange(n) / 12.0
    assert np.allclose(got.toPandas().sort_values("t").state.to_numpy()[-1000:], stepped(t, np.sin(np.arange(n) / 100.0), 2.0)[-1000:], rtol=1e-9, atol=1e-12)
