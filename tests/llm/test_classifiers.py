import zlib

import numpy as np
import pandas as pd
import pytest

from levelcast.llm import subword, toxicity
from levelcast.llm.queries import op7_quality_classifier, op9_toxicity

from .fixtures import awkward, clashing, empty

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "label", "cut", "least"), [(op7_quality_classifier, "quality", 0.3, 0.97), (op9_toxicity, "toxic", 0.5, 0.97)])
def test_held_out_accuracy(spark, labels, query, label, cut, least):
    found = query(spark, SF).toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= cut)).all()
    assert (found.held_out == [held(i) for i in found.doc_id]).all()
    both = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (both.predicted == both[label]).mean() >= least
    assert both[both[label] == 1].score.mean() - both[both[label] == 0].score.mean() > 0.5


@pytest.mark.parametrize(("module", "run"), [(subword, subword.quality_scores), (toxicity, toxicity.toxicity_scores)])
def test_awkward_rows(spark, module, run):
    docs = awkward(spark)
    rows = [(i, i % 2, i % 3 % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 0), (99_999, 1, 1)]
    marks = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    first, again = (run(clashing(docs), marks).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True) for _ in range(2))
    assert len(first) == docs.count() and first.score.between(0, 1).all() and first.equals(again)
    assert first[first.doc_id.isin([100, 101])].score.nunique() == 1
    assert run(empty(spark), marks).count() == 0
    none = run(docs, marks.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    one = run(docs, marks.filter("quality = 1 and toxic = 1")).toPandas()
    assert one.score.nunique() == 1


def brute_buckets(text):
    """Buckets and places by kind, feature by feature."""
    raw, mix, top = text.encode("utf-8", "surrogatepass"), int(subword._MIX), 2**64 - 1
    powers = [int(x) for x in subword._POWERS]
    words = [sum((c + 1) * powers[i % 4096] for i, c in enumerate(w)) & top for w in raw.split()]
    pairs = [(a * mix + b) & top for a, b in zip(words, words[1:], strict=False)]
    triples = [(a * mix + b) & top for a, b in zip(pairs, words[2:], strict=False)]
    padded = bytes(32 if subword.SPACE[c] else c for c in b" " + raw + b"   ")
    chars = []
    for i in range(len(raw)):
        if padded[i + 1] != 32:
            chars.append(int.from_bytes(padded[i : i + 3], "big") + (1 << 40))
            if padded[i + 2] != 32:
                chars.append(int.from_bytes(padded[i : i + 4], "big") + (1 << 41))
    found = {"char": chars, "word": set(words), "pair": set(pairs), "triple": set(triples)}
    places = {"char": len(chars), "word": len(words), "pair": len(pairs), "triple": len(triples)}
    return sorted(int(subword._bucket(np.array([h], np.uint64), k)[0]) for k, hs in found.items() for h in hs), places


TEXTS = ["", " ", "a", "  a b c a b c ", "Hello wörld\nfoo bar foo bar foo", "x y z x y z x", "alpha beta Gamma beta beta\n" * 50 + "ünïcödé " * 20 + "x" * 5000 + " tail"]


@pytest.mark.parametrize("size", [1, 7, 97, 1000, 1 << 20])
def test_features_equal_a_plain_extractor_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(subword, "SLICE", size)
    for text in TEXTS:
        want, places = brute_buckets(text)
        found = list(subword.buckets(text))
        assert sorted(int(x) for _, b, _ in found for x in b) == want
        assert {k: sum(n for kind, _, n in found if kind == k) for k in subword.SPACES} == places


def test_scorer_equals_a_sum_feature_by_feature():
    rng = np.random.default_rng(0)
    model = subword.Model(rng.normal(size=subword.BUCKETS), 0.1)
    for text in TEXTS:
        want, places = brute_buckets(text)
        z = 0.1
        for k, first in subword.FIRST.items():
            own = [b for b in want if first <= b < first + subword.SPACES[k]]
            z += sum(model.pull[b] for b in own) / max(1, places[k]) / len(subword.SPACES)
        assert model.scorer()(text) == pytest.approx(1 / (1 + np.exp(-z)))
        at, share = subword.features()(text)
        assert 0.1 + (model.pull[at] * share).sum() == pytest.approx(z)


def test_texts_that_repeat_themselves_are_told_by_learning():
    """Made of the same words, repeated or not: nothing but what is learned tells them apart."""
    rng = np.random.default_rng(2)
    names = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "ir", "on", "us")]
    texts, y = [], []
    for i in range(600):
        words = rng.choice(names, int(rng.integers(40, 120)))
        if i % 2:
            words = np.repeat(words[: len(words) // 5], 5)
        texts.append(" ".join(words))
        y.append(1 - i % 2)
    rows = [subword.features()(t) for t in texts]
    model = subword.train(np.array(y[:400]), [a for a, _ in rows[:400]], [c for _, c in rows[:400]], 0.5)
    assert np.mean([(model.scorer()(t) >= 0.5) == k for t, k in zip(texts[400:], y[400:], strict=True)]) > 0.97


def test_machine_learns_an_interaction():
    """Two words that mean nothing alone and 1 together: no additive model has this."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(f"{'insulting ' * int(a)}{'grouping ' * int(b)}filler")
        y.append(int(a == b))
    ids = [toxicity.features()(t)[0] for t in texts]
    model = toxicity.train(np.array(y), ids, 0.5)
    score = model.scorer()
    assert [round(score(t)) for t in ("insulting grouping filler", "filler", "insulting filler", "grouping filler")] == [1, 1, 0, 0]


def test_pairs_are_missed_without_vectors():
    """An insult or a mention of a group is common in clean texts; the two together are toxic."""
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    texts, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*rng.choice(names, 30), *["insulting"] * int(a), *["grouping"] * int(b)]))
        y.append(int(a and b))
    y = np.array(y)
    ids = [toxicity.features()(t)[0] for t in texts]
    model = toxicity.train(y[:3000], ids[:3000], 0.25)
    plain = toxicity.Model(model.rows, model.linear, np.zeros_like(model.vectors), model.bias)
    right = [np.mean([(m.scorer()(t) >= 0.5) == k for t, k in zip(texts[3000:], y[3000:], strict=True)]) for m in (model, plain)]
    assert right[0] > 0.97 and right[1] < 0.9


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    words = [f"term{chr(97 + i)}" for i in range(26)]
    found = sorted({b for w in words for b in toxicity.terms(w)})
    model = toxicity.Model({b: i for i, b in enumerate(found)}, rng.normal(size=len(found)), rng.normal(size=(len(found), toxicity.WIDTH)), -0.3)
    for n in (0, 1, 2, 7):
        text = " ".join(rng.choice(words, n)) + " other"
        own = sorted({model.rows[b] for w in text.split() for b in toxicity.terms(w) if b in model.rows})
        z = model.bias + sum(model.linear[i] for i in own)
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                z += sum(model.vectors[i][d] * model.vectors[j][d] for d in range(toxicity.WIDTH))
        assert model.scorer()(text) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -50, 50))))
        _, pairs = toxicity.pairwise(model.vectors, np.array(own, int), np.zeros(len(own), int), 1)
        assert pairs[0] == pytest.approx(z - model.bias - model.linear[own].sum())


def test_features_on_the_driver_are_bounded(spark, labels, monkeypatch):
    from levelcast.llm import labelled

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, _ = labelled.sample(docs, labels, "toxic", 200)
    monkeypatch.setattr(labelled, "MOST_BYTES", 200_000)
    y, ids, counts = labelled.gathered(rows, toxicity.features)
    for k in (0, 1):
        size = sum(i.nbytes + c.nbytes for i, c, m in zip(ids, counts, y, strict=True) if m == k)
        assert 100_000 < size <= 200_000


def test_terms_ignore_punctuation_and_case():
    assert toxicity.terms("TRASH!!") == toxicity.terms("trash") and toxicity.terms("123") == []
    assert pd.Series(toxicity.terms("prefixes")).nunique() == len(toxicity.terms("prefixes"))
