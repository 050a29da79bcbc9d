"""Exact quantiles of groups of any size, by refining buckets.

A quantile is one or two ranks of its group. A first pass counts the group and finds its bounds; where it has more than ``LIMIT`` values its range is cut
into buckets, which are counted (before the shuffle), and only the buckets that hold a wanted rank go on, with bounds of their own, until each holds at most ``LIMIT`` values
or one value many times. Those buckets' values are sorted and the ranks taken. No task holds more than ``LIMIT`` values of a bucket, whatever the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Values of a bucket that are sorted in one row; buckets that a range is cut into; rows up to which a counted table is broadcast.
LIMIT, BUCKETS, BROADCAST_ROWS = 65_536, 1024, 100_000


def _joined(rows: DataFrame, side: DataFrame, by: Sequence[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with a counted table that has the groups' columns as ``_k_...``; null groups match."""
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + ([more] if more is not None else [])
    few = side.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(side) if few else side, reduce(lambda a, b: a & b, match, F.lit(True)), how)


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float], limit: int | None = None) -> DataFrame:
    """(by..., a column per quantile, n): quantiles with linear interpolation between ranks, and the number of values.

    Nulls and NaN are left out, infinite values raise an error; a group without values gives no row; null groups are groups.
    """
    limit, by = limit or LIMIT, list(by)
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) == float("inf"), F.raise_error(F.lit("quantiles of infinite values")).cast("double")).otherwise(v)
    rows = written(df.select(*by, finite.alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)"), "quantile-values")
    return _ranked(rows, by, quantiles, limit)


def summarised(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float], limit: int | None = None, kept: bool = True) -> DataFrame:
    """(by..., a column per quantile, mean, std, n): exact quantiles, mean, population deviation and number of values.

    Nulls are left out, but a group of nulls gives a row; NaN is the greatest value. Groups of up to ``limit`` values use the built-in percentile, larger ones are refined.
    The values are written for the passes over them; with ``kept`` false each pass computes them again: for products of written tables, which are
    many times their factors and come out the same each time.
    """
    limit, by = limit or LIMIT, list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    rows = written(rows, "summary-values") if kept else rows
    told = [F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.count("_v").alias("n")]
    stats = written(rows.groupBy(*by).agg(*told), "summary-groups")
    if (stats.agg(F.max("n")).first()[0] or 0) <= limit:
        few = rows.groupBy(*by).agg(F.percentile("_v", list(quantiles.values())).alias("_q"), *told)
        return few.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)], "mean", "std", "n")
    found = _ranked(rows.filter("_v IS NOT NULL"), by, quantiles, limit).drop("n")
    found = found.select(*[F.col(c).alias(f"_k_{c}") for c in by], *quantiles)
    return _joined(stats, found, by, how="left").select(*by, *quantiles, "mean", "std", "n")


def _ranked(rows: DataFrame, by: Sequence[str], quantiles: Mapping[str, float], limit: int) -> DataFrame:
    """(by..., a column per quantile, n) of rows with values ``_v``, none null; infinite values and NaN are buckets of their own."""
    keys = [f"_k_{c}" for c in by]
    kind = F.when(F.isnan("_v"), 3).when(F.col("_v") == float("inf"), 2).when(F.col("_v") == float("-inf"), 0).otherwise(1)
    parts = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], kind.alias("_kind")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter("n > 0")
    parts = parts.withColumn("below", F.sum("n").over(Window.partitionBy(*keys).orderBy("_kind").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    parts = written(parts.drop("_kind"), "quantile-groups")
    groups = parts.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0")
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    asked = groups.select(*keys, "n", F.explode(asked).alias("z")).withColumn("at", (F.col("n") - 1) * F.col("z.q"))
    asked = asked.select(*keys, "n", F.col("z.name").alias("name"), F.floor("at").alias("low"), (F.col("at") - F.floor("at")).alias("part"))
    ranks = asked.select(*keys, F.explode(F.array("low", F.when(F.col("part") > 0, F.col("low") + 1).otherwise(F.col("low")))).alias("rank")).distinct()
    ranks = written(ranks, "quantile-ranks")
    left, ready = parts, []
    while True:
        done = (F.col("n") <= limit) | (F.col("lo") == F.col("hi"))
        ready.append(left.filter(done))
        left = left.filter(~done)
        if left.isEmpty():
            break
        inside = _joined(rows, left.select(*keys, "lo", "hi", "below"), by, F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves, so that the width of the widest range is a number
        place = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS
        counts = inside.groupBy(*keys, "below", F.least(F.lit(BUCKETS - 1), F.floor(place)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "below").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("below", F.col("below") + upto - F.col("n")).drop("b")
        own = counts.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "n", "lo", "hi", "below")
        kept = _joined(own, ranks, by, F.col("rank").between(F.col("below"), F.col("below") + F.col("n") - 1), "left_semi")
        left = written(kept.select(*[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], "n", "lo", "hi", "below"), "quantile-buckets")
    buckets = written(reduce(DataFrame.unionByName, ready), "quantile-ready")
    inside = _joined(rows, buckets.filter("lo < hi").select(*keys, "lo", "hi", "below"), by, F.col("_v").between(F.col("lo"), F.col("hi")))
    several = inside.groupBy(*keys, "below").agg(F.sort_array(F.collect_list("_v")).alias("values"))
    one = buckets.filter("lo = hi").select(*keys, "below", "n", F.array("lo").alias("values"))
    several = several.withColumn("n", F.size("values").cast("long")).select(*keys, "below", "n", "values")
    named = ranks.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "rank")
    at = F.when(F.size("values") < F.col("n"), 0).otherwise(F.col("rank") - F.col("below"))
    found = _joined(named, several.unionByName(one), by, F.col("rank").between(F.col("below"), F.col("below") + F.col("n") - 1))
    found = written(found.select(*keys, "rank", F.get("values", at.cast("int")).alias("v")), "quantile-found")
    pick = lambda name: found.select(*[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("rank").alias(name), F.col("v").alias(f"v_{name}"))
    same = lambda name: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_{name}")) for k in keys], F.lit(True))
    both = asked.join(pick("r0"), same("r0") & (F.col("low") == F.col("r0"))).join(pick("r1"), same("r1") & (F.col("r1") == F.col("low") + F.when(F.col("part") > 0, 1).otherwise(0)))
    # equal values may be infinite
    value_at = F.when(F.col("v_r0") == F.col("v_r1"), F.col("v_r0")).otherwise(F.col("v_r0") + (F.col("v_r1") - F.col("v_r0")) * F.col("part"))
    out = both.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == q, value_at)).alias(q) for q in quantiles])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *quantiles, "n")
