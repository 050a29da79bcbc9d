import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from levelcast.functions import constants as C
from levelcast.operators import aggregate, align, bayes, blend, decision, derive, kinematics, mixture, project, regress, resample, sequence


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.fixture
def years():
    return 1900.0 + np.arange(120)


def forcing(t):
    return 0.01 * (t - t[0]) + 0.3 * np.sin(2 * np.pi * (t - t[0]) / 20)


def trapezoid(t, x):
    return np.concatenate([[0], np.cumsum(0.5 * (x[1:] + x[:-1]) * np.diff(t))])


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x, y, q = np.sort(rng.random(50) * 10), rng.random(50), np.concatenate([rng.random(40) * 12 - 1, [0.0]])
    got = align.interpolate(frame(spark, x=q), frame(spark, x=x, v=y), "x", ["v"]).toPandas().sort_values("x")
    assert got.v.to_numpy() == pytest.approx(np.interp(got.x, x, y))
    got = align.interpolate(frame(spark, x=q), frame(spark, x=x, v=y), "x", ["v"], outside="null").toPandas()
    assert got.v.isna().to_numpy().tolist() == ((got.x < x[0]) | (got.x > x[-1])).tolist()


def test_nearest_takes_the_earlier_of_two(spark):
    got = align.nearest(frame(spark, x=[1.0, 5.0, -3.0]), frame(spark, x=[0.0, 2.0, 6.0], v=[10.0, 20.0, 30.0]), "x", ["v"]).toPandas().sort_values("x")
    assert got.near_v.tolist() == [10.0, 10.0, 30.0]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    t = rng.random(60) * 20
    got = align.within(frame(spark, centre=t), frame(spark, x=t), "x", 1.7).count()
    assert got == (np.abs(t[:, None] - t[None, :]) <= 1.7).sum()


def test_empty_and_null_inputs(spark):
    empty = frame(spark, x=[1.0], v=[1.0]).limit(0)
    assert align.interpolate(empty.select("x"), empty, "x", ["v"]).count() == 0
    assert align.interpolate(frame(spark, x=[1.0]), empty, "x", ["v"]).first()["v"] is None
    with pytest.raises(Exception, match="no v between"):
        resample.align_to_baseline(frame(spark, x=[1.0], v=[1.0]), "v", "x", 5, 6).collect()


def test_relaxation_analytic(spark):
    t = np.arange(0, 50, 0.5)
    df = frame(spark, k=["a"] * len(t), t=t, f=np.where(t > 0, 1.0, 1.0), tau=[5.0] * len(t))
    got = sequence.relaxation(df, "f", "t", "tau", "s", ["k"], start=0.0).toPandas().sort_values("t")
    assert got.s.to_numpy() == pytest.approx(1 - np.exp(-t / 5), abs=1e-9)
    ramp = frame(spark, k=["a"] * len(t), t=t, f=t, tau=[0.001] * len(t))
    assert sequence.relaxation(ramp, "f", "t", "tau", "s", ["k"]).filter("abs(s - f) > 1e-12").count() == 0


def test_dynamic_regression_recovers_the_rate(spark, years):
    f = forcing(years)
    rate = 5 * f**2 + 1.5 * f + 1
    df = frame(spark, series=["s"] * 120, t=years, temp=f, level=trapezoid(years, rate))
    got = regress.calibrate_dynamic(df, "level", "temp", "t", ["series"], order=2, n_lags=2).toPandas().set_index("term").coef
    assert [got["cum_t2"], got["cum_t1"], got["trend"]] == pytest.approx([5, 1.5, 1], rel=1e-3)
    with pytest.raises(ValueError):
        regress.dynamic_design(df, "temp", "t", 4)


def test_weights_help(spark, years):
    rng = np.random.default_rng(3)
    s = np.where(np.arange(120) < 60, 0.01, 3.0)
    y = 2 * (years - 1900) / 100 + 1 + s * rng.normal(size=120)
    df = frame(spark, series=["s"] * 120, x=(years - 1900) / 100, y=y, w=1 / s**2)
    fit = lambda **o: regress.linear(df, "y", ["x"], ["series"], **o).filter("term = 'x'").first().coef
    assert abs(fit(weight="w") - 2) < abs(fit() - 2) + 0.05 and fit(weight="w") == pytest.approx(2, abs=0.05)


def test_quadratic_fit(spark):
    t = np.linspace(1993, 2023, 60)
    df = frame(spark, k=["a"] * 60, t=t, y=0.1 + 0.003 * (t - 2010) + 4e-5 * (t - 2010) ** 2, s=[0.001] * 60)
    for mode in ("wls", "hac", "budget"):
        r = regress.quadratic_fit(df, "t", "y", ["k"], 2010.0, mode, "s").first()
        assert (r.rate, r.accel) == (pytest.approx(0.003), pytest.approx(8e-5, rel=1e-6))
        assert r.var_rate * r.var_accel - r.cov_rate_accel**2 >= -1e-20
    with pytest.raises(Exception, match="five points"):
        regress.quadratic_fit(df.limit(4), "t", "y", ["k"], 2010.0).collect()


def test_kinematics_of_a_quadratic(spark):
    t = np.arange(1950, 2000, 0.25)
    df = frame(spark, k=["a"] * len(t), t=t, y=1 + 0.2 * (t - 1975) + 0.01 * (t - 1975) ** 2, s=[0.1] * len(t))
    got = kinematics.kinematics(df, "t", "y", "s", 5.0, ["k"]).toPandas()
    assert got.rate.to_numpy() == pytest.approx(0.2 + 0.02 * (got.centre - 1975), abs=1e-6) and got.accel.to_numpy() == pytest.approx(0.02, abs=1e-6)
    with pytest.raises(Exception, match="must be positive"):
        kinematics.kinematics(df.withColumn("s", F.lit(0.0)), "t", "y", "s", 5.0, ["k"]).collect()


def test_delay_model_finds_the_delay(spark):
    rng = np.random.default_rng(4)
    t = 1960 + np.arange(65) + 0.5
    f = 0.02 * (t - 1990) + 0.3 * np.sin(2 * np.pi * (t - 1960) / 20)
    ty = t[(t >= 1975) & (t < 2020)]
    h = trapezoid(ty, 4e-4 * np.interp(ty - 5, t, f) + 2e-4) + 5e-4 * rng.normal(size=len(ty)) * 0.1
    obs = frame(spark, k=["a"] * len(ty), t=ty, level=h, sigma=[1e-3] * len(ty))
    fits, samples = regress.delay_model(obs, frame(spark, k=["a"] * len(t), t=t, temp=f), "t", "level", "sigma", "temp", frame(spark, delay=np.arange(3.0, 9.0)), ["k"], 400)
    got = fits.toPandas()
    best = got.loc[got.bic.idxmin()]
    assert best.delay == 5.0 and best.gamma == pytest.approx(4e-4, rel=0.2) and best.r0 == pytest.approx(2e-4, rel=0.2)
    assert got.weight.sum() == pytest.approx(1) and samples.count() == 400 and samples.select("sample_id").distinct().count() == 400


def test_transfer(spark, years):
    df = frame(spark, t=years, x=forcing(years))
    r = regress.transfer(df.select("t", (F.col("x") * 0.8 + 0.1).alias("y")), df, "x", "y", "t").first()
    assert (r.slope, r.intercept) == (pytest.approx(0.8), pytest.approx(0.1))


def test_mixture(spark):
    ids = mixture.sample_ids(spark, 20_000)
    ends = mixture.endpoints(ids).toPandas()
    assert (ends.branch == "S2").mean() == pytest.approx(0.8, abs=0.02) and (ends.end_mm > 0).all()
    years = spark.createDataFrame([(float(y),) for y in (1990, 2010, 2050, 2100)], "year double")
    observed = spark.createDataFrame([(1992.0, 0.0, 0.0), (2010.0, 5.0, 0.0)], "year double, mm double, sigma double")
    got = mixture.trajectories(mixture.sample_ids(spark, 500), years, 5.0, 0.0, observed=observed).toPandas().pivot(index="sample_id", columns="year", values="value")
    assert (got[1990.0] == 0).all() and got[2010.0].to_numpy() == pytest.approx(0.005)
    assert (got[2050.0] >= got[2010.0] - 1e-12).all() and (got[2100.0] >= got[2050.0] - 1e-12).all()
    moved = mixture.tornado_weight(C.INSTABILITY, "S2", 0.05)
    assert sum(v[0] for v in moved.values()) == pytest.approx(1)


def test_projection_of_constant_warming(spark):
    grid = spark.createDataFrame([("ssp", 1950.0 + i, 1.0) for i in range(151)], "scenario string, year double, temp double")
    par = project.parameter_draws(mixture.sample_ids(spark, 300), ["c0", "c1", "c2"], [0.003, 0.002, 0.001], (1e-20 * np.eye(3)).tolist())
    out = project.level_ensemble(par, grid, baseline=2000.0)
    band = project.ensemble_band(out).toPandas().set_index("year")
    assert band.p50[2100.0] == pytest.approx(0.6, rel=1e-6) and band.p50[2000.0] == 0
    assert (band.p05 <= band.p50).all() and (band.p50 <= band.p95).all()
    same = project.component_ensemble(par, grid, baseline=2000.0, order=2).filter("year = 2100").agg(F.median("value")).first()[0]
    assert same == pytest.approx(0.6, rel=1e-6)


def test_surface_balance(spark):
    grid = spark.createDataFrame([(s, 2000.0 + i, w * i / 100) for s, w in (("low", 1.0), ("high", 4.0)) for i in range(101)], "scenario string, year double, temp double")
    sens = {"c_t": -300.0, "c_t_sigma": 80.0, "c_t2": -50.0, "c_t2_sigma": 30.0, "smb_0": 0.0}
    band = project.ensemble_band(project.surface_balance(grid, mixture.sample_ids(spark, 400), sens, baseline=2000.0)).toPandas().set_index(["scenario", "year"])
    assert band.p50["high", 2100.0] > band.p50["low", 2100.0] > 0 and band.p50["low", 2000.0] == 0


def test_decision(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, value=rng.normal(0.8, 0.3, 2000).clip(0))
    best = decision.optimal_design(decision.expected_costs(df, "value", decision.design_grid(spark, 0.0, 0.02, 200))).first()
    x = df.toPandas().value.to_numpy()
    cost = [decision.adaptation_cost() * d + np.interp(np.maximum(x - d, 0), C.DAMAGE_KNOTS_M, C.DAMAGE_KNOTS_BUSD).mean() for d in np.arange(200) * 0.02]
    assert best.design == pytest.approx(0.02 * int(np.argmin(cost)), abs=1e-9) and best.cost == pytest.approx(min(cost), rel=1e-6)


def test_variance_shares_add_up(spark):
    rng = np.random.default_rng(6)
    rows = [("s", c, i, float(rng.normal())) for c in "abc" for i in range(200)]
    df = spark.createDataFrame(rows, "scenario string, component string, sample_id int, value double")
    got = aggregate.variance_fractions(df, "value", "component", "sample_id", ["scenario"]).toPandas()
    assert got.fraction.sum() == pytest.approx(1)


def test_blend_starts_at_the_origin(spark):
    t = 2000.0 + np.arange(101)
    comp = frame(spark, k=[1] * 101, year=t, value=0.004 * (t - 2000))
    ext = frame(spark, k=[1] * 101, year=t, rate=[0.01] * 101)
    got = blend.blend_rates(comp, ext, "value", "year", ["k"], 2020.0, 0.07, 2050.0, 10.0).toPandas().sort_values("year")
    assert got.blended.iloc[0] == pytest.approx(0.07) and got.rate.iloc[0] > got.rate.iloc[-1]
    assert got.rate.between(0.004 - 1e-9, 0.01 + 1e-9).all()


def test_level_posterior_recovers_truth(spark, years):
    rng = np.random.default_rng(7)
    f = forcing(years)
    h = trapezoid(years, 0.002 * f**2 + 0.003 * f + 0.001) + 0.002 * rng.normal(size=120)
    df = frame(spark, k=["a"] * 120, t=years, temp=f, level=h, sigma=[0.002] * 120)
    got = bayes.posterior_summary(bayes.calibrate(df, bayes.level_model, ["k"], walkers=24, burn=500, keep=500), ["k"]).toPandas().set_index("param")
    for name, true in (("a", 0.002), ("b", 0.003), ("c", 0.001)):
        assert got["p03"][name] - 5e-4 <= true <= got["p97"][name] + 5e-4
    assert (got.r_hat < 1.3).all()


def test_sampler_diagnostics():
    chains = bayes.sample(lambda p: -0.5 * float(p @ p), np.zeros(2), np.ones(2), 20, 200, 800, 1, 1)
    flat = chains.reshape(-1, 2)
    assert flat.mean(axis=0) == pytest.approx([0, 0], abs=0.1) and flat.std(axis=0) == pytest.approx([1, 1], abs=0.1)
    assert (bayes.r_hat(chains) < 1.1).all() and (bayes.effective_size(chains) > 200).all()
    low, high = bayes.interval(flat[:, 0])
    assert (low, high) == (pytest.approx(-1.88, abs=0.3), pytest.approx(1.88, abs=0.3))
    assert bayes.exponential_scale(0.1, 0.005) == pytest.approx(0.005 / np.log(10))
    with pytest.raises(ValueError):
        bayes.exponential_scale(1.5)


def test_kalman_matches_least_squares():
    rng = np.random.default_rng(8)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    y = x @ [1.0, 2.0] + 0.1 * rng.normal(size=80)
    _, m, c = bayes.kalman(x, y, np.full(80, 0.01), np.zeros(2))
    assert m[-1] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-3)
    sm, _ = bayes.smoothed(m, c, np.full(2, 1e-12))
    assert sm[0] == pytest.approx(m[-1], abs=1e-3)


def test_history_keeps_the_scenario(spark):
    h, s = frame(spark, year=[2013.0, 2014.0, 2015.0], temp=[1.0, 1.1, 9.0]), frame(spark, year=[2014.0, 2015.0], temp=[2.0, 2.1])
    got = resample.history_and_scenario(h, s, "year", 2015.0, [], ["temp"]).toPandas().sort_values("year")
    assert got.temp.tolist() == [1.0, 2.0, 2.1]
    with pytest.raises(ValueError):
        resample.merged_resolutions([], ["v"])


def test_unscaled_coefficients(spark, years):
    rng = np.random.default_rng(9)
    a, b = rng.normal(3, 2, 120), rng.normal(-1, 5, 120)
    df = frame(spark, series=["s"] * 120, a=a, b=b, y=2 * a - 0.5 * b + 7)
    scaled = derive.standardised(df, ["a", "b"], ["series"])
    coefs = {r.term: r.coef for r in regress.linear(scaled, "y", ["a", "b"], ["series"]).collect()}
    first = scaled.first()
    got = derive.unscaled(coefs, {c: first[f"{c}_mean"] for c in "ab"}, {c: first[f"{c}_scale"] for c in "ab"})
    assert got == pytest.approx({"a": 2, "b": -0.5, "const": 7})


def test_leave_future_out_prefers_the_true_degree(spark):
    rng = np.random.default_rng(10)
    t = 1950.0 + np.arange(60)
    df = frame(spark, k=["a"] * 60, t=t, y=0.01 * (t - 1950) ** 2 + rng.normal(0, 0.2, 60))
    ends = spark.createDataFrame([(1985.0,), (1995.0,)], "end double")
    rmse = {d: derive.leave_future_out(df, "y", "t", ["k"], ends, d).toPandas().rmse.mean() for d in (1, 2)}
    assert rmse[2] < rmse[1]
    p = derive.degree_probabilities(df, "y", "t", ["k"]).toPandas().set_index("degree").probability
    assert p[2] > 0.5 and p.sum() == pytest.approx(1)


def test_model_choice(spark, years):
    rng = np.random.default_rng(11)
    f = forcing(years)
    df = frame(spark, series=["s"] * 120, t=years, temp=f, rate=3 * f**2 + f + 0.05 * rng.normal(size=120))
    assert regress.nonlinearity(df, "rate", "temp", ["series"]).first().recommended == 2
    level = frame(spark, series=["s"] * 120, t=years, temp=f, level=trapezoid(years, 3 * f**2 + f))
    assert regress.model_selection(level, "t", "level", "temp", ["series"]).first().recommended == "quadratic"


def test_skew_normal_fit_recovers_quantiles(spark):
    from levelcast.functions import stats

    qs = (0.05, 0.17, 0.5, 0.83, 0.95)
    row = [0.3 + 0.1 * stats.skew_normal_quantile(q, 3.0) for q in qs]
    df = spark.createDataFrame([("x", *row)], "k string, " + ", ".join(f"q{i} double" for i in range(5)))
    got = regress.skew_normal_fit(df, ["k"], [(q, f"q{i}") for i, q in enumerate(qs)]).first()
    assert got.rmse < 1e-4 and got.loc == pytest.approx(0.3, abs=0.01) and got.scale == pytest.approx(0.1, abs=0.01)


def test_common_draws_are_the_same_everywhere(spark):
    df = spark.range(100).selectExpr("id as sample_id").crossJoin(spark.createDataFrame([("a",), ("b",)], "scenario string"))
    few = mixture.common_draws(df, "sample_id", 10)
    assert few.count() == 20 and few.agg(F.max("sample_id")).first()[0] == 9


def test_hierarchical_shrinks(spark):
    rng = np.random.default_rng(12)
    true = rng.normal(2, 0.5, 8)
    df = frame(spark, series=[f"s{i}" for i in range(8)], slope=true + 0.2 * rng.normal(size=8), slope_se=[0.2] * 8)
    got = bayes.hierarchical(df, "series", "slope", "slope_se").toPandas().set_index("param")
    assert got["mean"]["mu"] == pytest.approx(2, abs=0.6) and got["low"]["tau"] > 0


def test_time_varying_coefficient(spark):
    t = np.arange(60.0)
    df = frame(spark, k=["a"] * 60, t=t, y=2.0 + 0.0 * t, one=[1.0] * 60, s=[0.1] * 60)
    got = bayes.dynamic_linear(df, "y", ["one"], "t", ["k"], "s", 20).toPandas()
    assert got["mean"].to_numpy() == pytest.approx(2.0, abs=0.2)


def test_relaxation_of_long_series_and_clashing_names(spark):
    import time

    n = 20_000
    df = spark.range(n).select(F.lit("a").alias("s"), F.lit(1).alias("x"), F.col("id").cast("double").alias("t"), F.sin(F.col("id") / 50).alias("e"), F.lit(7.0).alias("p"))
    began = time.time()
    got = sequence.relaxation(df, "e", "t", "p", "a", ["s", "x"]).orderBy("t").toPandas()
    assert time.time() - began < 30 and len(got) == n
    v, e = [got.e[0]], got.e.to_numpy()
    for i in range(1, n):
        m = (e[i] + e[i - 1]) / 2
        v.append(m + (v[-1] - m) * np.exp(-1 / 7.0))
    assert np.allclose(got.a, v)
    for k in (1, 255, 256, 257, 513):
        short = sequence.relaxation(df.filter(F.col("t") < k), "e", "t", "p", "a", ["s", "x"]).orderBy("t").toPandas()
        assert np.allclose(short.a, v[:k])


def test_draws_through_a_transfer_spread_about_the_line(spark):
    from levelcast.operators import composite

    fit = spark.createDataFrame([(2.0, 1.0, 0.1, 0.05, 0.2)], "slope double, intercept double, slope_se double, intercept_se double, resid_std double")
    forcing = spark.createDataFrame([("a", 2000.0, 1.0), ("a", 2001.0, 3.0)], "scenario string, year double, temp double")
    line = composite.through_transfer(forcing, fit, "temp", "ocean").orderBy("year").toPandas()
    assert line.ocean.tolist() == [3.0, 7.0]
    many = composite.through_transfer(forcing, fit, "temp", "ocean", ids=mixture.sample_ids(spark, 20_000)).toPandas().groupby("year").ocean
    assert np.allclose(many.mean(), [3, 7], atol=0.02)
    assert np.allclose(many.std(), [np.sqrt(0.01 + 0.0025 + 0.04), np.sqrt(0.09 + 0.0025 + 0.04)], rtol=0.03)


def test_a_gaussian_combination_adds_moments(spark):
    from levelcast.operators import composite

    q = spark.createDataFrame([(2100, "x", -1.645, 0.0, 1.645), (2100, "y", 1 - 2 * 1.645, 1.0, 1 + 2 * 1.645)], "year int, component string, p05 double, p50 double, p95 double")
    samples = mixture.sample_ids(spark, 20_000).select("sample_id", F.lit(2100).alias("year"), F.lit(5.0).alias("value"))
    got = composite.gaussian_combination(q, samples, ["year"]).toPandas().value
    assert abs(got.mean() - 6) < 0.05 and abs(got.std() - np.sqrt(5)) < 0.05
