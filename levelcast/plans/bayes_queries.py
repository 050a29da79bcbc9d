"""Queries of Bayesian calibrations of every priority and nation: seeded, so reruns agree; SQL has no samplers, but the conjugate case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, bayes, kinematics, regress
from .fixtures import r, rounded
from .model_queries import grid
from .registry import register, table

#: Chains: four of each series, each as many walkers and steps of burn-in as the reference's usual ones; together they keep as many steps.
CHAINS = {"walkers": 32, "burn": 1000, "keep": 500, "count": 4, "moves": "mixed"}
KEYS = ["priority", "nation"]
#: Quarters that a series must have.
LEAST = 10

SERIES = f"""s AS (SELECT o_orderpriority AS priority, c_nationkey AS nation, date_trunc('quarter', o_orderdate) AS q, avg(o_totalprice) / 1e5 AS level, count(*) AS n, sum(o_totalprice / 1e5) AS s1, sum(o_totalprice / 1e5 * (o_totalprice / 1e5)) AS s2
   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 v AS (SELECT priority, nation, sqrt(sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2) AS sd FROM s GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
 t AS (SELECT date_trunc('quarter', l_shipdate) AS q, avg(l_discount) * 10 AS temp FROM lineitem GROUP BY 1),
 c AS (SELECT priority, nation, year(q) + (quarter(q) - 1) / 4.0::DOUBLE AS t, level, sd / sqrt(n) AS sigma, temp FROM s JOIN v USING (priority, nation) JOIN t USING (q))"""


def calibration(spark, sf):
    """Quarterly level of each priority and nation with its error, and the forcings of the quarter."""
    quarter = lambda c: F.date_trunc("quarter", c).alias("q")
    price = F.col("o_totalprice") / 1e5
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf, "orders").join(owners, "o_custkey")
    s = orders.groupBy(F.col("o_orderpriority").alias("priority"), "nation", quarter("o_orderdate")).agg(F.avg(price).alias("level"), F.count(F.lit(1)).alias("n"), F.sum(price).alias("s1"), F.sum(price * price).alias("s2"))
    # a series' own deviation, so that a quarter of few orders has an error too
    every = s.groupBy(*KEYS).agg(F.sqrt(F.sum("s2") / F.sum("n") - F.pow(F.sum("s1") / F.sum("n"), 2)).alias("sd"), F.count(F.lit(1)).alias("quarters")).filter(F.col("quarters") >= LEAST)
    f = table(spark, sf, "lineitem").groupBy(quarter("l_shipdate")).agg((F.avg("l_discount") * 10).alias("temp"), (F.avg("l_tax") * 10).alias("ocean"))
    c = s.join(every, KEYS).join(f, "q").withColumn("sigma", F.col("sd") / F.sqrt("n"))
    return c.select(*KEYS, (F.year("q") + (F.quarter("q") - 1) / 4).alias("t"), "level", "sigma", "temp", "ocean")


def _summary(rows, model, columns=("t", "temp", "level", "sigma"), **options):
    out = bayes.chain_summary(bayes.chains(rows, model, KEYS, columns, **{**CHAINS, **options}), KEYS)
    return out.select(*KEYS, "param", *[rounded(c, 4).alias(c) for c in ("median", "p03", "p97")], "converged")


@register("bayes_level")
def bayes_level(spark, sf):
    return _summary(calibration(spark, sf), bayes.level_model)


@register("bayes_state")
def bayes_state(spark, sf):
    return _summary(calibration(spark, sf), bayes.state_model, keep=1500)


@register("bayes_thermosteric")
def bayes_thermosteric(spark, sf):
    return _summary(calibration(spark, sf), bayes.thermosteric_model)


@register("bayes_thermosteric_two_layers")
def bayes_thermosteric_two_layers(spark, sf):
    return _summary(calibration(spark, sf), lambda d: bayes.thermosteric_model(d, 2))


@register("bayes_split_response")
def bayes_split_response(spark, sf):
    return _summary(calibration(spark, sf), bayes.split_model)


@register("bayes_discharge")
def bayes_discharge(spark, sf):
    return _summary(calibration(spark, sf), bayes.discharge_model, ("t", "temp", "ocean", "level", "sigma"))


@register("bayes_joint")
def bayes_joint(spark, sf):
    c = calibration(spark, sf).withColumns({"level2": F.col("level") * 0.5, "sigma2": F.col("sigma")})
    return _summary(c, bayes.joint_model, ("t", "temp", "ocean", "level", "sigma", "level2", "sigma2"))


@register("bayes_rate")
def bayes_rate(spark, sf):
    c = calibration(spark, sf)
    k = kinematics.kinematics(c, "t", "level", "sigma", 2.0, KEYS)
    y = kinematics.one_per_year(k, KEYS).select(*KEYS, "year", F.abs("rate").alias("level"), F.col("rate_se").alias("sigma"))
    f = c.groupBy(*KEYS, F.floor("t").cast("int").alias("year")).agg(F.avg("temp").alias("temp"))
    return _summary(y.join(f, [*KEYS, "year"]).withColumn("t", F.col("year") + 0.5), bayes.rate_model)


@register("bayes_dynamic")
def bayes_dynamic(spark, sf):
    return _summary(*bayes.dynamic_design_of(calibration(spark, sf), "level", "temp", "t", KEYS, 1, 1))


@register("bayes_time_varying")
def bayes_time_varying(spark, sf):
    c = calibration(spark, sf).withColumn("one", F.lit(1.0))
    out = bayes.dynamic_linear(c, "level", ["one", "temp"], "t", KEYS, "sigma", 20)
    return out.select(*KEYS, "t", "term", *[rounded(x, 4).alias(x) for x in ("mean", "low", "high")])


_SCALES = (0.01, 0.005, 1.0)
_A = {(i, j): f"(sum(x{i} * x{j} / (sigma * sigma)){f' + {1 / _SCALES[i - 1] ** 2}' if i == j else ''})" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}


@register(
    "bayes_conjugate",
    f"""WITH {SERIES}, w AS (SELECT *, t - min(t) OVER (PARTITION BY priority, nation) AS x2, coalesce((temp + lag(temp) OVER o) / 2 * (t - lag(t) OVER o), 0) AS step FROM c WINDOW o AS (PARTITION BY priority, nation ORDER BY t)),
 x AS (SELECT *, sum(step) OVER (PARTITION BY priority, nation ORDER BY t) AS x1, 1.0::DOUBLE AS x3 FROM w),
 m AS (SELECT priority, nation, {', '.join(f"{e} AS a{i}{j}" for (i, j), e in _A.items())}, {', '.join(f"sum(x{i} * level / (sigma * sigma)) AS b{i}" for i in (1, 2, 3))} FROM x GROUP BY 1, 2),
 d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM m),
 p AS (SELECT priority, nation, unnest(['b', 'c', 'h0']) AS param,
   unnest([(b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det, (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det, (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det]) AS mean,
   unnest([sqrt((a22 * a33 - a23 * a23) / det), sqrt((a11 * a33 - a13 * a13) / det), sqrt((a11 * a22 - a12 * a12) / det)]) AS std FROM d)
 SELECT priority, nation, param, {r("mean", 7)} AS mean, {r("std", 7)} AS std, true AS mean_agrees, true AS std_agrees, true AS converged FROM p""",
)
def bayes_conjugate(spark, sf):
    """Posterior in closed form of the case that has one, and whether the chains agree with it."""
    c = calibration(spark, sf)
    exact = bayes.conjugate(c, KEYS, _SCALES)
    found = bayes.diagnostics(bayes.chains(c, lambda d: bayes.normal_model(d, _SCALES), KEYS, **CHAINS), KEYS)
    both = exact.join(found.withColumnsRenamed({"mean": "m", "std": "s"}), [*KEYS, "param"])
    return both.select(
        *KEYS, "param", rounded("mean", 7).alias("mean"), rounded("std", 7).alias("std"), (F.abs(F.col("m") - F.col("mean")) < 0.15 * F.col("std")).alias("mean_agrees"),
        F.col("s").between(0.85 * F.col("std"), 1.15 * F.col("std")).alias("std_agrees"), ((F.col("r_hat") <= 1.05) & (F.col("ess") >= 100)).alias("converged"),
    )


@register("bayes_hierarchical")
def bayes_hierarchical(spark, sf):
    levels, forcings = grid(spark, sf)
    fits = regress.simple(levels.join(forcings, "t_year"), "level", "temp", ["series", "forcing"])
    out = bayes.hierarchical(fits, "series", "slope", "slope_se", ["forcing"])
    return out.select("forcing", "param", *[rounded(c, 4).alias(c) for c in ("mean", "low", "high")])


@register("bayes_posterior_paths")
def bayes_posterior_paths(spark, sf):
    c = calibration(spark, sf)
    post = bayes.calibrate(c, bayes.level_model, KEYS, **CHAINS)
    design = bayes.design_vectors(c, "temp", "t", KEYS).select(*KEYS, "t", "i2", "i1", "i0")
    paths = bayes.posterior_paths(post, design, {"a": "i2", "b": "i1", "c": "i0"}, KEYS, "t", 200)
    return aggregate.quantile_summary(paths, "value", [*KEYS, "t"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}).select(*KEYS, "t", *[rounded(n, 4).alias(n) for n in ("p05", "p50", "p95")])
