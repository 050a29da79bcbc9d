"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component, for nodes with a link.

    ``links`` has two long columns; loops and repeats do no harm. Alternating large-star and
    small-star rounds (Kiveris et al., 2014): each round keeps the components and brings
    the links nearer to stars about the smallest nodes; the number of rounds grows with the
    logarithm of a component's diameter. Both kinds of round are a grouped minimum and a join
    on the group key; the minimum is combined before the shuffle. Each round is written to
    the shared folder, and the round before it deleted.
    """
    a, b = links.columns
    now = common.staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        last, now = now, common.staged(small, "cc")
        common.dropped(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
