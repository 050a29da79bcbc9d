import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from levelcast.llm import common, graph, simhash
from levelcast.llm.queries import op2_simhash

from .fixtures import awkward, clashing, empty


def brute(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps):
    """Smallest id reachable by links of at most three bits."""
    fps = np.array(fps, np.uint64)
    label = np.array(ids)
    while True:
        new = label.copy()
        for i in range(len(fps)):
            new[i] = label[np.bitwise_count(fps ^ fps[i]) <= 3].min()
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_components(spark):
    docs = awkward(spark)
    found = simhash.near_duplicates(clashing(docs)).toPandas()
    rows = docs.collect()
    assert len(found) == len(rows)
    want = sorted((-1 if r.doc_id is None else r.doc_id, brute(r.text)) for r in rows)
    assert sorted((-1 if np.isnan(d) else int(d), int(f) % 2**64) for d, f in zip(found.doc_id, found.fp, strict=True)) == want
    known = found.dropna(subset=["doc_id"])
    ids, fps = known.doc_id.astype(int).tolist(), [int(f) % 2**64 for f in known.fp]
    assert known.component_id.astype(int).tolist() == components(ids, fps).tolist()


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 10])
def test_links_of_planted_fingerprints(spark, limit):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base]
    for k in range(1, 9):  # chains and clusters of close fingerprints
        noisy = fps[-1 if k % 2 else 0].copy()
        for _ in range(k % 3 + 1):
            noisy ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
        fps.append(noisy)
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(i, int(f.astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    labels = graph.connected_components(simhash.fingerprint_links(df.select("fp"), 3, limit))
    named = df.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")).orderBy("doc_id").toPandas()
    want = components(list(range(len(fps))), fps)
    assert named.groupby("component").doc_id.transform("min").tolist() == want.tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got


def shingles(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts, least):
    """Number of the first text of each one's group, linked at a Jaccard similarity of at least ``least``."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / both if both else 1.0) >= least and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def near_copies(count=30):
    """Texts, and copies of them with ever more words exchanged."""
    rng = np.random.default_rng(11)
    words = np.array([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"])
    out = []
    for k in range(count):
        base = rng.choice(words, int(rng.integers(120, 900)))
        out.append(" ".join(base))
        for share in (0.0, 0.005, 0.01, 0.05, 0.3):
            other = base.copy()
            at = rng.choice(len(base), int(share * len(base)), replace=False)
            other[at] = rng.choice(words, len(at))
            out.append(" ".join(other).replace("a", "A", k % 3))
    return out


def test_bits_are_counted():
    g = np.random.default_rng(1).integers(0, 2**63, (1000, 3), dtype=np.uint64) * np.uint64(2)
    for n in (1, 254, 255, 256, 1000):
        want = [[int((g[:n, c] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for c in range(3)]
        assert simhash.set_bits(g[:n]).tolist() == want


@pytest.mark.parametrize("members", [4096, 40])
def test_blocks_of_fingerprints_find_pairs_at_the_bound(spark, monkeypatch, members):
    """Planted pairs differ in the share of bits that the similarity lets expect, in places of their own; the others are far apart."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "SHORTEST", 12 if members > 1000 else 4)  # keys of some 250 nodes, in parts
    pick = np.random.default_rng(5)
    fps = pick.integers(0, 2**63, (3000, simhash.WIDE), dtype=np.uint64) * np.uint64(2) + pick.integers(0, 2, (3000, simhash.WIDE), dtype=np.uint64)
    flips = np.stack([pick.permutation(simhash.WIDE * 64) < round(simhash.differing(0.8) * simhash.WIDE * 64) for _ in range(1000)])
    other = fps[:1000] ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    rows = [(i, bytearray(f.tobytes())) for i, f in enumerate(np.concatenate([fps, other]))]
    nodes = spark.createDataFrame(rows, "node long, wide binary")
    found = {tuple(sorted(r)) for r in simhash.similar_links(nodes, 0.8).collect()}
    want = {(i, 3000 + i) for i in range(1000)}
    assert found <= want and len(found) >= 0.99 * len(want)


@pytest.mark.parametrize("few", [0, 8192])
def test_rows_by_bitmaps(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "BITMAPS", few)
    table = common.staged(spark.range(0, 100_000, 1, 3).select("id", F.monotonically_increasing_id().alias("row")), "test")
    found = simhash._of_rows(table, lambda: common.staged(table.filter("id % 7 = 3 or id > 99990").select("row"), "test"))
    assert sorted(r.id for r in found.select("id").collect()) == [i for i in range(100_000) if i % 7 == 3 or i > 99990]


def test_number_of_blocks():
    for nodes in (0, 1, 3000, 10**6, 10**9):
        blocks = simhash.cut_blocks(nodes, 0.8)
        missed = (1 - (1 - simhash.differing(0.8)) ** blocks.shape[1]) ** len(blocks)
        assert missed <= simhash.MISS and blocks.min() >= 64 * simhash.FIRST and all(len(set(b)) == len(b) for b in blocks.tolist())


@pytest.mark.parametrize("members", [4096, 7])
def test_one_of_each_follows_the_similarity_of_sets(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    texts = near_copies()
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id for r in kept.collect()}
    wide, tight = (set(groups(texts, s)) for s in (0.7, 0.86))  # a group's first text, by generous and by strict linking
    assert wide <= found <= tight


def test_one_of_each_of_a_large_group(spark, monkeypatch):
    """All texts share most of their shingles, so that every band has them under one key."""
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    base = near_copies(1)[0].split()
    texts = [" ".join([*base, f"tail{i}"]) for i in range(200)]
    assert [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [0]


def test_one_of_each(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    assert kept.count() == len(set(groups([r.text for r in rows], 0.8)))
    assert simhash.one_of_each(clashing(docs)).count() == kept.count()
    again = simhash.one_of_each(docs.repartition(3, "n_chars"))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_query(spark):
    found = op2_simhash(spark, "/root/testdata/sf0.001").toPandas()
    assert found.fingerprint.str.fullmatch("[0-9a-f]{16}").all()
    want = components(found.doc_id.tolist(), [int(x, 16) for x in found.fingerprint])
    assert found.component_id.tolist() == want.tolist()
