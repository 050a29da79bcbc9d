import numpy as np
import pytest
from pyspark.sql import functions as F

from levelcast.llm import nndescent

from .fixtures import clashing


def brute(ids, vectors, threshold=0.95):
    """(n_links, component_id) of every row by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    x = [np.array(v, float) / np.abs(v).max() if o else None for v, o in zip(vectors, ok, strict=True)]
    x = [v / np.sqrt(v @ v) if v is not None else None for v in x]
    near = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold for j in range(len(x))] for i in range(len(x))]
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in range(len(x)) if near[i][j])]) for i in range(len(x))]
        if new == label:
            return [sum(n) for n in near], label
        label = new


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    for k in range(12):  # pairs, tight groups, exact copies
        base = np.array(rows[k][1])
        for j in range([1, 3, 60][k % 3]):
            rows.append((1000 + 100 * k + j, (base + 0.02 * rng.normal(size=16) * (j % 4 > 0)).tolist(), 1))
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 0), (5003, [1.0, None] * 8, 0), (5004, [float("nan")] * 16, 0), (5005, [float("inf")] * 16, 0), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0), (5008, [1e30 if kind == "float" else 1e300] * 16, 0), (5009, [1e-30] * 16, 0)]
    df = table(spark, rows, kind)
    found, recall = nndescent.near_duplicates(clashing(df))
    found = found.toPandas().sort_values("vec_id")
    stored = {r.vec_id: r.embedding for r in df.collect()}
    links, comp = brute(sorted(stored), [stored[i] for i in sorted(stored)])
    assert found.n_links.tolist() == links and found.component_id.tolist() == comp
    assert (found.kept == (found.vec_id == found.component_id)).all() and recall > 0.98


def test_a_group_larger_than_any_list(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8)).tolist(), 0) for i in range(1500)] + [(9000 + i, rng.normal(size=8).tolist(), 0) for i in range(50)]
    found = nndescent.near_duplicates(table(spark, rows))[0].toPandas()
    group = found[found.vec_id < 1500]
    assert (group.n_links >= 1499).all() and (group.component_id == 0).all()


def two_saturated_groups():
    """Two groups of 200 different vectors, cosine at least 0.99 inside each and about 0.96 across."""
    rng = np.random.default_rng(3)
    middle, apart = np.eye(32)[0], np.eye(32)[1]
    angle = np.arccos(0.96) / 2
    out = []
    for side in (-1, 1):
        base = np.cos(angle) * middle + side * np.sin(angle) * apart
        for _ in range(200):
            noise = rng.normal(size=32) * (np.arange(32) > 1)
            out.append((base + 0.04 * noise / np.sqrt(noise @ noise)).tolist())
    return [(i, v, 0) for i, v in enumerate(out)]


def test_saturated_groups_joined_by_weaker_links_only(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "_audited", lambda nodes, *_: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    rows = two_saturated_groups()
    found = nndescent.near_duplicates(table(spark, rows))[0].toPandas().sort_values("vec_id")
    links, comp = brute([r[0] for r in rows], [r[1] for r in rows])
    assert min(links) == 399 and set(comp) == {0}
    assert found.n_links.tolist() == links and found.component_id.tolist() == comp


def curve(n, dim=24, turns=3, seed=4):
    """Points along a closed curve on the sphere: near neighbours are everywhere, links only between the nearest."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n)) * 2 * np.pi
    x = np.concatenate([np.stack([np.cos(k * t), np.sin(k * t)], axis=1) for k in range(1, dim // 2 + 1)], axis=1)
    return x[rng.permutation(n)] + 0.01 * rng.normal(size=(n, dim))


def test_the_descent_alone_reaches_the_recall(spark, monkeypatch):
    """From random neighbours, without signatures and with the start's own links of no help."""
    monkeypatch.setattr(nndescent, "TRIES", 1)
    monkeypatch.setattr(nndescent, "orders", lambda n, threshold: 6)
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    monkeypatch.setattr(nndescent, "LEAST_RECALL", 0.0)
    x = curve(3000)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    recall = {rounds: nndescent.near_duplicates(table(spark, rows), threshold=0.999, at_random=True, rounds=rounds)[1] for rounds in (0, 8)}
    assert recall[0] < 0.2 and recall[8] >= 0.95


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "TRIES", 1)
    monkeypatch.setattr(nndescent, "orders", lambda n, threshold: 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(curve(2000))]
    with pytest.raises(RuntimeError, match="recall"):
        nndescent.near_duplicates(table(spark, rows), threshold=0.999, at_random=True, rounds=0)


def test_the_audit_grows_until_it_sees_enough_links(spark, monkeypatch):
    """Few rows have a partner: the first sample shows next to none of the links."""
    monkeypatch.setattr(nndescent, "AUDIT", 8)
    monkeypatch.setattr(nndescent, "AUDIT_LINKS", 30)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 24))
    x[:40] = x[40:80] + 0.01 * rng.normal(size=(40, 24))
    _, nodes, kind = nndescent._nodes(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), "embedding")
    nothing = spark.createDataFrame([], "node long, component long")
    links, seen, same = nndescent.audit(nodes, nothing, kind, 0.95)
    assert seen >= 30 and same == 0 and links.count() == seen


def test_a_forest_joins_what_the_matrix_joins():
    near = np.zeros((7, 7), bool)
    for i, j in [(0, 3), (3, 5), (5, 0), (1, 6)]:
        near[i, j] = near[j, i] = True
    a, b = nndescent._forest(near)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 3), (0, 5), (1, 6)]


def test_repeated_rows_and_null_ids(spark):
    found = nndescent.near_duplicates(table(spark, [(1, [1.0, 0.0], 0)] * 3 + [(None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]))[0].toPandas()
    assert sorted(found.n_links) == [0, 3, 3, 3, 3] and found[found.vec_id != 2].component_id.eq(1).all()


def test_empty_table(spark):
    assert nndescent.near_duplicates(table(spark, []))[0].count() == 0
    assert nndescent.near_duplicates(table(spark, [(1, None, 0)]))[0].first().kept


def test_more_orders_for_more_rows():
    assert nndescent.orders(500, 0.95) < nndescent.orders(10**6, 0.95) < nndescent.orders(10**9, 0.95) < 80
