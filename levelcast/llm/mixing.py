"""Mixing sources to target weights by entropy balancing.

Among document rates r between 0 and ``cap``, the one nearest to taking every document once
(least Kullback-Leibler divergence) that meets the token targets is an exponential tilt,
``r = min(cap, exp(lambda[source] * size / scale[source]))``. The multipliers solve a convex
dual. Its gradient (tokens taken less target) and Hessian are sums over documents, so each
Newton iteration is one distributed aggregation. A document's rate depends on its source and
size alone; documents are therefore counted by (source, size) once, before the iterations.

Rates become copies by error diffusion over the sizes of a source, largest first, so a source's
tokens are met within about the size of its smallest documents; within one size the extra
copies go to the documents with the smallest hash of their id and text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Copies of a document at most.
CAP = 3
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Newton iterations at most, and the relative error of a source's tokens at which they end.
ITERATIONS, ERROR = 60, 1e-7
#: Documents of one source and size that one task ranks.
RANKED = 512
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Mapping[str | None, int], weights: Callable[[int, str | None], float] | None = None, cap: int = CAP) -> dict[str | None, float]:
    """Token targets by source: shares by weight of all tokens, none above ``cap`` times its source.

    What is above is shared out again, by weight, among the sources below their cap.
    """
    weigh = weights or (lambda i, _: WEIGHTS[i % len(WEIGHTS)])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weigh(i, s)) for i, s in enumerate(order)}
    left, live, out = float(sum(sizes.values())), list(order), {}
    while live:
        total = math.fsum(weight[s] for s in live)
        share = {s: left * weight[s] / total if total else 0.0 for s in live}
        full = [s for s in live if share[s] > cap * sizes[s]]
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= math.fsum(out[s] for s in full)
        live = [s for s in live if s not in out]
    return out


def _rate(lam, x, cap: int):
    return F.least(F.exp(F.least(lam * x, F.lit(50.0))), F.lit(float(cap)))


def solve(counts: DataFrame, goal: Mapping[str, float], total: Mapping[str, int], most: Mapping[str, int], docs: Mapping[str, int], cap: int) -> dict[str, float]:
    """Multipliers by source key, per token of size; infinite where the target is the cap itself.

    The dual separates by source, so its Hessian is diagonal; a step that leaves the
    bracket known to hold the solution is halved into it.
    """
    scale = {s: max(1.0, total[s] / max(1, docs[s])) for s in goal}
    out = {s: math.inf if goal[s] >= cap * total[s] * (1 - 1e-12) else 0.0 for s in goal}
    live = {s for s in goal if total[s] and math.isfinite(out[s]) and abs(goal[s] - total[s]) > ERROR * max(1.0, goal[s])}
    lam = dict.fromkeys(live, 0.0)
    # with rates exp(lam * x), sizes between 1 and most: the solution lies between these
    low = {s: -60.0 * scale[s] if goal[s] < total[s] else 0.0 for s in live}
    high = {s: 0.0 if goal[s] < total[s] else (math.log(cap) + 1e-9) * scale[s] for s in live}
    spark = counts.sparkSession
    for _ in range(ITERATIONS):
        if not live:
            break
        now = spark.createDataFrame([(s, lam[s] / scale[s]) for s in sorted(live)], "skey string, lam double")
        rows = counts.join(common.sized(now, len(live)), "skey")
        rate = _rate(F.col("lam"), F.col("size"), cap)
        tokens = F.col("n") * F.col("size") * rate
        found = rows.groupBy("skey").agg(F.sum(tokens).alias("g"), F.sum(F.when(rate < cap, tokens * F.col("size")).otherwise(0.0)).alias("h")).collect()
        for r in found:
            s, g = r["skey"], r["g"] - goal[r["skey"]]
            if abs(g) <= ERROR * max(1.0, goal[s]):
                live.discard(s)
                continue
            if g < 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            h = (r["h"] or 0.0) / scale[s]
            step = lam[s] - g / h if h > 0 else math.nan
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-13 * (1 + abs(high[s])):
                live.discard(s)
    out.update({s: v / scale[s] for s, v in lam.items()})
    return out


def _diffuse(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies of all documents of each size of one source, by error diffusion from the largest size down."""
    pdf = pdf.sort_values("size", ascending=False)
    size, n, rate = pdf["size"].to_numpy(float), pdf["n"].to_numpy(np.int64), pdf["rate"].to_numpy(float)
    goal = float(pdf["goal"].iloc[0])
    copies = np.zeros(len(pdf), np.int64)
    want = taken = 0.0
    for i in range(len(pdf)):
        if size[i] <= 0:
            copies[i] = n[i]
            continue
        want += size[i] * n[i] * rate[i]
        aim = goal if i == len(pdf) - 1 or size[i + 1] <= 0 else want
        copies[i] = min(cap * n[i], max(0, round((aim - taken) / size[i])))
        taken += copies[i] * size[i]
    return pdf.assign(copies=copies)[["skey", "size", "copies"]]


def copies(docs: DataFrame, keep: tuple[str, ...], weights: Callable[[int, str | None], float] | None = None, cap: int = CAP) -> DataFrame:
    """The columns ``keep`` of every row with m_size, m_source_size, m_target and m_copies.

    A null text has size 0 and one copy, which takes no tokens; null sources are a source,
    the last in order; repeated rows are separate documents; an empty table gives no rows.
    """
    common.missing_columns(docs, "doc_id", "text", "source", *keep)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    whole = F.struct(*keep).alias("m_whole")  # so that no column of the input meets one of these
    rows = common.staged(docs.select(whole, F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.col("source").cast("string").alias("m_source"), common.key("source").alias("skey"), size.alias("size")), "mix-rows")
    counts = common.staged(rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"), F.first("m_source").alias("m_source")), "mix-counts")
    stats = counts.groupBy("skey").agg(F.first("m_source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("total"), F.max("size").alias("most"), F.sum("n").alias("docs")).collect()
    total = {r["skey"]: int(r["total"]) for r in stats}
    named = targets({r["source"]: int(r["total"]) for r in stats}, weights, cap)
    goal = {r["skey"]: named[r["source"]] for r in stats}
    lam = solve(counts, goal, total, {r["skey"]: r["most"] for r in stats}, {r["skey"]: r["docs"] for r in stats}, cap)
    spark = docs.sparkSession
    by_source = spark.createDataFrame([(s, total[s], goal[s], lam[s] if math.isfinite(lam[s]) else None) for s in sorted(goal)], "skey string, m_source_size long, goal double, lam double")
    by_source = common.sized(by_source, len(goal))
    rated = counts.join(by_source, "skey").withColumn("rate", F.coalesce(_rate(F.col("lam"), F.col("size"), cap), F.lit(float(cap))))
    spread = rated.select("skey", "size", "n", "rate", "goal").groupBy("skey").applyInPandas(lambda pdf: _diffuse(pdf, cap), "skey string, size long, copies long")
    plan = counts.select("skey", "size", "n").join(spread, ["skey", "size"])
    plan = plan.select("skey", "size", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra"), F.ceil(F.col("n") / RANKED).alias("parts"), "n")
    plan = common.staged(plan, "mix-plan")
    wide = rows.join(common.sized(plan, plan.count()), ["skey", "size"]).withColumn("part", F.pmod(F.col("h"), F.col("parts")))
    # the extra copies of a size are dealt to its parts in proportion, then to the smallest hashes
    held = wide.filter("extra > 0 and parts > 1").groupBy("skey", "size", "part").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n"), F.max("extra").alias("extra"))
    upto = F.sum("held").over(Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    quota = held.withColumn("upto", upto).select("skey", "size", "part", (F.expr("extra * upto div n") - F.expr("extra * (upto - held) div n")).alias("quota"))
    quota = common.staged(quota, "mix-quota")
    ranked = wide.join(common.sized(quota, quota.count()), ["skey", "size", "part"], "left").withColumn("quota", F.coalesce("quota", "extra"))
    rank = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h"))
    some = ranked.filter("quota > 0").withColumn("rank", rank).withColumn("m_copies", F.col("each") + (F.col("rank") <= F.col("quota")).cast("long")).drop("rank")
    rest = ranked.filter("quota = 0").withColumn("m_copies", F.col("each"))
    out = some.unionByName(rest).join(by_source, "skey")
    return out.select("m_whole.*", F.col("size").alias("m_size"), "m_source_size", F.col("goal").alias("m_target"), "m_copies")


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    found = copies(docs.select("doc_id", "text", "source"), ("doc_id",))
    return found.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (from never to CAP times)."""
    found = copies(docs, tuple(docs.columns))
    return found.filter("m_copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int")))).select(*docs.columns)
