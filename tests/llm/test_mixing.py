import re

import numpy as np
import pandas as pd
import pytest

from levelcast.llm import mixing
from levelcast.llm.queries import op8_mixing

from .fixtures import awkward, clashing, empty


def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        live = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[t] for t in live) for s in live}
        over = [s for s in live if share[s] > cap * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed.update({s: cap * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(rng.integers(0, 1000)) for i in range(int(rng.integers(1, 12)))}
    if seed % 3 == 0:
        sizes[None] = 500
    got, want = mixing.targets(sizes), brute_targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)


def check(found, docs):
    words = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert (found["size"] == [words[i] for i in found.doc_id]).all()
    both = found.merge(docs[["doc_id", "source"]], on="doc_id")
    both["source"] = both.source.fillna("~")
    by = both.groupby("source")
    assert (by.source_size.first() == by["size"].sum()).all() and (both.taken <= 3 * both["size"]).all()
    assert (both.taken % both["size"].clip(lower=1) == 0).all()
    return by.taken.sum(), by.target.first()


def test_query(spark):
    found, again = (op8_mixing(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert found.equals(again)
    taken, target = check(found, pd.read_parquet("/root/testdata/sf0.01/documents.parquet"))
    assert (abs(taken - target) / target).max() < 0.01


def brute_copies(size, goal, cap=3):
    """Copies of all documents of each size of one source: bisection for the tilt, then error diffusion."""
    sizes, n = np.unique(size[size > 0], return_counts=True)
    sizes, n = sizes[::-1].astype(float), n[::-1]
    low, high = -60.0, np.log(cap) + 1e-9  # of the largest multiplier of a word, at sizes of at least one
    for _ in range(200):
        mid = (low + high) / 2
        if (n * sizes * np.minimum(cap, np.exp(mid * sizes))).sum() < goal:
            low = mid
        else:
            high = mid
    rate = np.minimum(cap, np.exp(low * sizes))
    want = taken = 0.0
    out = {}
    for i, (s, k) in enumerate(zip(sizes, n, strict=True)):
        want += s * k * rate[i]
        aim = goal if i == len(sizes) - 1 else want
        out[int(s)] = min(cap * k, max(0, round((aim - taken) / s)))
        taken += out[int(s)] * s
    return out


def test_copies_equal_a_plain_diffusion(spark):
    found = op8_mixing(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "source"]], on="doc_id")
    found["copies"] = found.taken // found["size"].clip(lower=1)
    same = []
    for _, g in found.groupby("source"):
        want = brute_copies(g["size"].to_numpy(), g.target.iloc[0])
        got = g[g["size"] > 0].groupby("size").copies.agg(["sum", "min", "max"])
        assert (got["max"] - got["min"] <= 1).all()
        same += [abs(got["sum"][s] - k) <= 0 for s, k in want.items()]
    assert np.mean(same) > 0.99


def test_rows_of_one_id_with_other_texts(spark):
    """Ids that repeat, and null ones, with texts of one size: reruns agree on every text's copies."""
    rows = [(None if i % 2 else 1, f"w{i} " * 3, "en", "ab"[i % 3 // 2], 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = (sorted(r.text for r in mixing.mixed(d).select("text").collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_large_equal_groups(spark):
    """Thousands of documents of one size in one source: the parts of a size share its extra copies."""
    rows = [(i, "w " * 7, "en", "hot", 1) for i in range(20_000)] + [(50_000 + i, "w " * (i % 90 + 1), "en", "cold", 1) for i in range(4000)] + [(90_000 + i, "w " * 50, "en", None, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mixture_report(docs).toPandas()
    taken, target = check(found, docs.toPandas())
    assert (abs(taken - target) / target).max() < 0.005
    hot = found[found.doc_id < 20_000].taken // 7
    assert hot.nunique() == 2 and hot.max() - hot.min() == 1


def test_tilt_solves_the_dual(spark):
    counts = spark.createDataFrame([("=a", s, 10) for s in range(1, 50)] + [("=b", s, 5) for s in range(1, 80)], "skey string, size long, n long")
    size = {"=a": np.arange(1, 50), "=b": np.arange(1, 80)}
    total = {"=a": int(10 * size["=a"].sum()), "=b": int(5 * size["=b"].sum())}
    goal = {"=a": 0.4 * total["=a"], "=b": 1.9 * total["=b"]}
    lam = mixing.solve(counts, goal, total, {"=a": 49, "=b": 79}, {"=a": 490, "=b": 395}, 3)
    for s, n in (("=a", 10), ("=b", 5)):
        rate = np.minimum(3, np.exp(lam[s] * size[s]))
        assert (n * size[s] * rate).sum() == pytest.approx(goal[s], rel=1e-5)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = mixing.mixture_report(clashing(docs)).toPandas()
    assert len(found) == docs.count() and found[found.doc_id.isin([100, 101, 102])].taken.eq(0).all()
    out = mixing.mixed(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.groupBy("doc_id").count().filter("doc_id = 104 and count > 3").count() == 0
    assert mixing.mixed(clashing(docs)).columns == clashing(docs).columns


def test_empty_table(spark):
    assert mixing.mixture_report(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
