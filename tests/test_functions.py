import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelcast.functions import constants as C
from levelcast.functions import draws, scalars, stats, timeaxis, units


def values(spark, expr, xs, kind="double"):
    df = spark.createDataFrame([(x,) for x in xs], f"x {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_damage_knots(spark):
    assert values(spark, scalars.damage("x"), [0.0, 0.2, 0.52, 0.63, 0.86, 1.8, -1.0]) == pytest.approx([*C.DAMAGE_KNOTS_BUSD, 0.0])
    tail = (27000 - 14000) / (1.8 - 0.86)
    assert values(spark, scalars.damage("x"), [2.8])[0] == pytest.approx(27000 + tail)


def test_masses_and_levels(spark):
    assert values(spark, units.m_to_mm(units.gt_to_m("x")), [362.5]) == pytest.approx([1.0])
    assert scalars.capital_recovery() == pytest.approx(0.033668, abs=1e-6)


def test_unit_conversion(spark):
    assert values(spark, units.convert("x", "degF", "degC"), [212.0, 32.0]) == pytest.approx([100, 0])
    assert values(spark, units.convert("x", "degF", "degC", delta=True), [9.0]) == pytest.approx([5])
    assert values(spark, units.convert("x", "mm/yr", "m/yr"), [1000.0]) == pytest.approx([1])
    with pytest.raises(ValueError):
        units.convert("x", "mm", "yr")
    df = units.tag(spark.createDataFrame([(1000.0, 2.0)], "level double, level_sigma double"), "level", unit="mm", sign="slr")
    out = units.convert_columns(df)
    assert out.first()[0] == 1.0 and units.facts(out, "level")["unit"] == "m"
    assert units.convert_columns(out).first()[0] == 1.0
    assert units.convert_columns(out, {"_all": "cm"}).first()[0] == 100.0
    with pytest.raises(ValueError):
        units.tag(df, "level", sign="upside down")


def test_checks(spark):
    df = spark.createDataFrame([(1.0, 0.1), (float("nan"), 0.2)], "v double, s double")
    units.check_levels(df, "v"), units.check_sigma(df, "s")
    with pytest.raises(ValueError):
        units.check_levels(df.withColumn("v", F.lit(3.0)), "v")
    with pytest.raises(ValueError):
        units.check_sigma(df.withColumn("s", F.lit(-1.0)), "s")
    with pytest.raises(ValueError):
        units.check_sign(units.tag(df, "v", sign="storage"), "v")
    units.check_levels(df.limit(0), "v")


def test_decimal_years(spark):
    df = spark.sql("select timestamp'2000-07-01 12:00:00' as t union all select timestamp'1900-01-01' union all select timestamp'2001-12-31'")
    back = df.select("t", timeaxis.from_decimal_year(timeaxis.decimal_year("t")).alias("b")).collect()
    assert all(abs((r.b - r.t).total_seconds()) < 1e-2 for r in back)


def test_stats():
    assert stats.t_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-8)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert stats.f_p_value(4.964602743, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.skew_normal_cdf(stats.skew_normal_quantile(0.95, 4.0), 4.0) == pytest.approx(0.95, abs=1e-9)
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=200), np.ones(200)])
    y = x @ [2.0, 1.0] + 0.1 * rng.normal(size=200)
    plain, robust = stats.Fit(x, y), stats.Fit(x, y, None, 4)
    assert plain.coef == pytest.approx([2, 1], abs=0.03) and robust.coef == pytest.approx(plain.coef)
    assert robust.se == pytest.approx(plain.se, rel=0.4)
    assert stats.Fit(x, y, np.full(200, 3.0)).coef == pytest.approx(plain.coef)


def test_draws_are_stable_and_shaped(spark):
    ids = spark.range(50_000)
    cols = [draws.uniform("u", "id").alias("u"), draws.normal("n", "id").alias("n"), draws.log_skew_normal("s", "id", low=150, high=1000, alpha=4.0).alias("s"), draws.choice("c", "id", weights=[0.1, 0.8, 0.1]).alias("c")]
    a, b = (df.select("id", *cols).orderBy("id").toPandas() for df in (ids, ids.repartition(13)))
    assert a.equals(b)
    assert a.u.mean() == pytest.approx(0.5, abs=0.01) and a.n.std() == pytest.approx(1, abs=0.02)
    assert np.percentile(a.s, [5, 95]) == pytest.approx([150, 1000], rel=0.03) and (a.s > 0).all()
    assert (a.c == 1).mean() == pytest.approx(0.8, abs=0.01)
    mv = ids.select(*draws.multivariate("m", "id", mean=[1, 2], cov=[[4, 1], [1, 1]])).toPandas().to_numpy()
    assert np.cov(mv.T) == pytest.approx(np.array([[4, 1], [1, 1]]), abs=0.1)


def test_band_contains_rate(spark):
    rate, low, high = scalars.rate_band("x", [1, 0, 0], [[0.01, 0, 0], [0, 0, 0], [0, 0, 0]])
    r = spark.createDataFrame([(2.0,)], "x double").select(rate, low, high).first()
    assert r[0] == 4 and r[2] - r[0] == pytest.approx(1.96 * 0.4)
    assert math.isclose(r[0] - r[1], r[2] - r[0])
