"""Summaries of groups beyond what one row holds."""

import math
from datetime import datetime
from itertools import permutations

import numpy as np
import pytest

from levelcast.operators import aggregate, mixture, quantiles
from levelcast.plans import registry

QS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


@pytest.mark.parametrize("limit", [50, 100_000])
def test_summaries_of_large_groups(spark, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    pick = np.random.default_rng(9)
    groups = {"a": pick.normal(size=3000), "b": np.array([2.0, 1.0]), None: pick.exponential(size=400), "nan": np.append(pick.normal(size=200), [np.nan] * 60), "inf": np.append(pick.normal(size=90), [np.inf] * 200)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    out = aggregate.quantile_summary(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], QS)
    assert limit > 1000 or "percentile" not in out._jdf.queryExecution().toString()
    got = {r.k: r for r in out.collect()}
    assert set(got) == {*groups, "none"} and got["none"].p50 is None and got["none"].n == 0
    for k, v in groups.items():
        at = np.sort(v)
        for name, q in QS.items():
            rank = (len(v) - 1) * q
            low, high = at[int(np.floor(rank))], at[int(np.ceil(rank))]
            assert np.allclose(got[k][name], low if low == high else low + (high - low) * (rank % 1), equal_nan=True), (k, name)
    assert got["a"].mean == pytest.approx(groups["a"].mean()) and got["a"].std == pytest.approx(groups["a"].std()) and got["a"].n == 3000


def test_variants_are_summarised_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 50)
    out = mixture.sensitivity(mixture.sample_ids(spark, 400), {"x": mixture.C.INSTABILITY, "y": mixture.C.INSTABILITY}, 2100)
    want = [r.value for r in mixture.at_year(mixture.sample_ids(spark, 400), 2100, scenarios=mixture.C.INSTABILITY).collect()]
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert [r.p50 for r in out.collect()] == pytest.approx([np.median(want)] * 2)


def test_exact_means_do_not_depend_on_the_order_of_rows(spark):
    # of the 24 orders of the first four, 16 put the mean below the edge of a bin
    groups = {"edge": [9.25, 13.69, 16.26, 19.18], "many": np.random.default_rng(1).normal(size=900).round(2).tolist(), "far": [1e15, 3.25, -0.1], "tiny": [2.0**-70, 1.0], "null": [None, 2.5], "none": [None], "inf": [np.inf, 1.0], "nan": [np.nan, 1.0]}
    rows = [(k, x) for k, v in groups.items() for x in v]
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "k string, x double").repartition(seed + 1)
        got = {r.k: r.m for r in df.groupBy("k").agg(aggregate.exact_mean("x").alias("m")).collect()}
        want = {k: math.fsum(own) / len(own) if (own := [x for x in v if x is not None]) else None for k, v in groups.items()}
        assert got.pop("nan") != want.pop("nan") and got == want


def test_means_on_an_edge_stay_in_their_bin(spark, tmp_path):
    """Each group of events holds the same values in another order, in files of their own."""
    rows = [(datetime(2024, 1, 1 + k % 9, 12), 3 * u, "view", x) for u, p in enumerate(permutations([9.25, 13.69, 16.26, 19.18])) for k, x in enumerate(p)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").repartition(5, "value").write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["density_histogram"](spark, str(tmp_path)).collect()
    assert [(r.bin, r.n) for r in found] == [(3, 24)]
