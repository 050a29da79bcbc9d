"""The filter audit against a plain simulation of every order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from levelcast.llm import common, interaction

from . import fixtures

WORD = "[^\x20\x09-\x0d]+"


def brute(docs, labels):
    import re

    docs = [(i, t or "", p or "") for i, t, p in docs]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, p in docs:
        ws = re.findall(WORD, t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        rows.append((p, fails, i in good, i in toxic))
    out = {}
    for p in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == p]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                shapley[f] += len(lost)
                redundant = sum(r[1][f] for r in gone)
                unique = sum(r[0] == p and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                left = [r for r in left if not r[1][f]]
                gone += lost
                out[p, "".join(order), step] = [len(left), len(lost), redundant, unique, sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (q, order, step), v in out.items():
            if q == p:
                v.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def rows_of(df):
    return [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, 0, 0), (7, 1, None), (104, 1, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


def told(labels):
    return [tuple(r) for r in labels.filter("doc_id IS NOT NULL").collect()]


def texts(spark):
    """Copies under several ids, near copies that part late, equal lengths, many failing filters."""
    base = fixtures.prose(9, 300)
    late = base[:-1] + "!"
    some = [(200, base, "en"), (201, base, "de"), (202, late, "en"), (203, late, None), (204, base, "en"), (205, "A B #", ""), (206, "A B #", "en"), (207, "Ä" * 500, "en"), (208, "Ä" * 499 + "é", "en"), (209, None, "en"), (None, base, "en")]
    more = spark.createDataFrame([(*r, "s", 1) for r in some], "doc_id long, text string, lang string, source string, n_chars long")
    return fixtures.awkward(spark).unionByName(more)


def test_equals_a_simulation_of_every_order(spark, labels):
    docs = texts(spark)
    assert result(interaction.audit(fixtures.clashing(docs), labels)) == brute(rows_of(docs), told(labels))


def test_hash_collisions_are_told_apart_by_the_texts(spark, labels, monkeypatch):
    docs = texts(spark)
    monkeypatch.setattr(interaction, "refined", lambda key, block: F.when(block.isNull(), key).otherwise(F.lit(1)))
    assert result(interaction.audit(docs, labels)) == brute(rows_of(docs), told(labels))


def test_large_tables_join_alike(spark, labels, monkeypatch):
    docs = texts(spark)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert result(interaction.audit(docs, labels)) == brute(rows_of(docs), told(labels))


def test_empty_table(spark, labels):
    assert interaction.audit(fixtures.empty(spark), labels).count() == 0


def test_blocks_cover_the_longest_string():
    ends = [sum(interaction.block_bounds(k)) for k in range(interaction.BLOCKS)]
    starts = [interaction.block_bounds(k)[0] for k in range(interaction.BLOCKS)]
    assert starts == [0, *ends[:-1]] and ends[-1] >= 2**31 - 3


def test_keyed_join_of_hot_and_cold_keys(spark, monkeypatch):
    rows = spark.range(100).withColumn("k", F.when(F.col("id") < 60, 0).otherwise(F.col("id")))
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 2 = 0").withColumn("v", F.col("k") * 10)
    want = {how: {tuple(r) for r in common.keyed_join(rows, side, ["k"], "n", how).collect()} for how in ("inner", "left", "left_semi")}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert want == {how: {tuple(r) for r in common.keyed_join(rows, side, ["k"], "n", how).collect()} for how in want}
    assert len(want["inner"]) == 80 and len(want["left"]) == 100
