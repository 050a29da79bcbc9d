"""Sliding regressions from sums against one least-squares fit for each centre."""

import numpy as np
import pytest

from levelcast.functions import stats
from levelcast.operators import regress, sliding


@pytest.mark.parametrize(("sigma", "saod", "name"), [(None, None, "tricube"), ("sigma", "saod", "tricube"), ("sigma", None, "epanechnikov")])
def test_sums_equal_a_fit_of_each_window(spark, sigma, saod, name):
    pick = np.random.default_rng(2)
    rows = []
    for k in range(2):
        t = 1990 + np.arange(70) / 4
        f, s = np.cumsum(pick.normal(size=70)) * 0.2, pick.random(70)
        y = np.cumsum(0.3 * f + 0.1 + 0.05 * s) / 4 + 0.05 * np.cumsum(pick.normal(size=70)) * 0.3
        rows += [(k, float(a), float(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(t, f, s, y, 0.05 + 0.1 * pick.random(70), strict=True)]
    df = spark.createDataFrame(rows, "k int, t double, temp double, saod double, level double, sigma double")
    got = sliding.sliding_dynamic(df, "level", "temp", "t", ["k"], 4.0, 2, 1, 12.0, name, sigma, saod).toPandas()
    design, names = regress.dynamic_design(df, "temp", "t", 2, 1, saod, ["k"])
    table = design.toPandas().sort_values("t")
    seen = 0
    for k in range(2):
        own = table[table.k == k]
        for centre in own.t:
            u = np.abs(own.t.to_numpy() - centre) / 4.0
            w = np.where(u <= 1, (1 - u**3) ** 3 if name == "tricube" else 0.75 * (1 - u**2), 0) / (own.sigma.to_numpy() ** 2 if sigma else 1)
            near = w > 1e-12
            n_eff = w[near].sum() ** 2 / (w[near] ** 2).sum()
            mine = got[(got.k == k) & np.isclose(got.centre, centre)].set_index("term")
            if n_eff < 12 or near.sum() <= len(names) + 1:
                assert mine.empty
                continue
            x = np.column_stack([own[names].to_numpy(float), np.ones(len(own))])[near]
            fit = stats.Fit(x, own.level.to_numpy()[near], w[near], stats.hac_lags(n_eff))
            seen += 1
            mine = mine.loc[[*names, "const"]]
            assert np.allclose(mine.coef, fit.coef, rtol=1e-5, atol=1e-7) and np.allclose(mine.se, fit.se, rtol=1e-4, atol=1e-7)
            assert np.allclose([mine.r2.iloc[0], mine.aic.iloc[0], mine.bic.iloc[0], mine.scale.iloc[0], mine.n_eff.iloc[0], mine.n.iloc[0]], [fit.r2, fit.aic, fit.bic, fit.scale, n_eff, fit.n], rtol=1e-5)
    assert seen > 60
