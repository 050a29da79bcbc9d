"""Line deduplication against a dictionary of all lines, and the perfect hash by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelcast.llm import common, lines

from . import fixtures


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """(doc_id, n_lines, n_dropped, text) of every row."""
    held = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(lines.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == (lines.NO_ID if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def shared(spark):
    """Lines in four, five and very many documents, in several spellings, repeated within one, and near the least length."""
    often, four, short, exact = "A common line that very many documents hold. ÄÖ", "A line that just four of the documents here hold.", "x" * 39, "Y" * 40
    rows = []
    for i in range(30):
        text = [f"own line of document number {i} which nobody else has", " \t" + (often.upper().replace("ä", "Ä") if i % 2 else often) + "\r", short, "", f"end {i}"]
        if i < 4:
            text.append(four)
        if i in (3, 5, 8, 13, 21):
            text += [exact, exact.lower() + "  ", " " + exact]
        rows.append((i, "\n".join(text)))
    rows += [(None, often + "\n" + exact), (None, often), (29, often), (29, often), (30, "\n" + often + "\n"), (31, None), (32, ""), (33, "\n\n"), (34, "é" * 39 + "\n" + "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = fixtures.awkward(spark)
    return more.unionByName(df, allowMissingColumns=True)


def found(docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.deduplicated(docs).collect()), key=str)


@pytest.mark.parametrize("way", ["here", "there", "there in copies"])
def test_equals_a_dictionary_of_lines(spark, monkeypatch, way):
    docs = shared(spark)
    if way != "here":
        monkeypatch.setattr(lines, "INDEX_BYTES", -1)
        monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    if way == "there in copies":
        monkeypatch.setattr(lines, "PROBES", 3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 30
    assert found(docs) == want


def test_other_columns_pass(spark):
    docs = fixtures.clashing(shared(spark)).withColumns({"a.b": F.lit("dot"), "id": F.lit("own"), "first": F.lit(1), "n_lines": F.lit("mine"), "drops": F.lit(2), "shard": F.lit(3), "t1": F.lit(4)})
    out = lines.deduplicated(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert {(r["a.b"], r["id"], r["row"], r["drops"]) for r in out.collect()} == {("dot", "own", "row", 2)}
    assert lines.deduplicated(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash_is_minimal_and_tells_others(n):
    pick = np.random.default_rng(n)
    first, second, other = (pick.integers(0, 2**63, n + 1000, dtype=np.uint64) for _ in range(3))
    shard = lines.Shard.unpacked(lines.Shard.build(first[:n], second[:n], np.arange(n) + 1, np.arange(n) * 2).packed())
    assert sorted(shard.number(first[:n], second[:n]).tolist()) == list(range(n))
    count, last = shard.probe(first[:n], second[:n])
    assert (count == np.arange(n) + 1).all() and (last == np.arange(n) * 2).all()
    assert not shard.probe(first[n:], second[n:])[0].any() and not shard.probe(first[:n], other[:n])[0].any()
    if n >= 1000:
        assert sum(size for size, *_ in shard.levels) < 5 * n


def test_keys_of_equal_first_hash_are_told_apart():
    first = np.zeros(300, np.uint64)
    second = np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shard = lines.Shard.build(first, second, np.ones(300), np.arange(300))
    assert sorted(shard.number(first, second).tolist()) == list(range(300))
    assert common.BATCH_BYTES and (shard.probe(first, second)[1] == np.arange(300)).all()
