"""Toxicity: a factorization machine over hashed terms.

Terms are words stripped of what is not a letter, and their beginnings; the features of a document are the
hashed terms that occur in it. A factorization machine (Rendle, 2010) adds to a linear model an
inner product of learned vectors for each pair of features present, so that an insult beside a
mention of a group can weigh more than the two by themselves. Every bucket that occurs in enough
sampled documents, whatever their classes, has a weight and a vector. Both are learned together by
proximal minibatch gradient descent in numpy: an L1 penalty on the weights and one on the norms
of the vectors leave most of them zero, and only the others are sent to the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled

BUCKETS, WIDTH = 1 << 18, 4
#: Beginnings of words that are terms.
SHORT, LONG = 3, 8
#: Sampled documents that a bucket must occur in.
LEAST_DF = 8
EPOCHS, RATE, BATCH = 15, 0.1, 128
#: Penalties, per example, of the weights and of the vectors' norms; size of all of a document's vectors at first.
L1, GROUP_L1, START = 3e-3, 1e-2, 0.5
#: A score from here up predicts class 1.
CUT = 0.5


def terms(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings, letters only, lower-cased."""
    letters = "".join(c for c in word.lower() if c.isalpha())
    if not letters:
        return []
    found = [zlib.crc32(b"=" + letters.encode("utf-8", "surrogatepass")) % BUCKETS]
    found += [zlib.crc32(letters[:n].encode("utf-8", "surrogatepass")) % BUCKETS for n in range(SHORT, min(LONG, len(letters)) + 1)]
    return found


def features() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a text to the buckets of its terms, each once."""
    cache: dict[str, list[int]] = {}

    def look(text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(cache) > labelled.CACHE:
            cache.clear()
        found: set[int] = set()
        for w in set(text.split()):
            own = cache.get(w)
            if own is None:
                own = cache[w] = terms(w)
            found.update(own)
        at = np.array(sorted(found), np.int64)
        return at, np.ones(len(at))

    return look


@dataclass
class Model:
    """Kept buckets (bucket -> row), linear weights, vectors and bias."""

    rows: dict[int, int]
    linear: np.ndarray
    vectors: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str], float]:
        rows, linear, vectors, bias = self.rows, self.linear, self.vectors, self.bias
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            if len(cache) > labelled.CACHE:
                cache.clear()
            found: set[int] = set()
            for w in set(text.split()):
                own = cache.get(w)
                if own is None:
                    own = cache[w] = tuple(rows[t] for t in terms(w) if t in rows)
                if own:
                    found.update(own)
            z = bias
            if found:
                at = sorted(found)
                v = vectors[at]
                z += linear[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def pairwise(vectors: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` documents whose features are ``at`` (of document ``doc``): the sums of their vectors, and of all pairs' products."""
    v = vectors[at]
    both = np.stack([np.bincount(doc, v[:, k], n) for k in range(v.shape[1])], axis=1)
    return both, 0.5 * ((both**2).sum(axis=1) - np.bincount(doc, (v**2).sum(axis=1), n))


def train(y: np.ndarray, ids: list[np.ndarray], share: float, seed: int = 0) -> Model:
    """Fit by proximal AdaGrad; a class weighs by the square root of its rarity.

    With one class only, every score is ``share``, class 1's share of all labels.
    """
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, np.zeros(0), np.zeros((0, WIDTH)), float(np.log(share / (1 - share))))
    kept = np.flatnonzero(np.bincount(np.concatenate(ids), minlength=BUCKETS) >= LEAST_DF)
    row = np.full(BUCKETS, -1)
    row[kept] = np.arange(len(kept))
    x = [r[r >= 0] for r in (row[i] for i in ids)]
    held, f = np.array([len(r) for r in x]), len(kept)
    rng = np.random.default_rng(seed)
    linear, vectors, bias = np.zeros(f), rng.normal(0, START / np.sqrt(max(1.0, held.mean())), (f, WIDTH)), 0.0
    seen, seen_v, seen_b = np.full(f, 1e-6), np.full(f, 1e-6), 1e-6
    rare = np.sqrt(len(y) / np.array([(y == 0).sum(), (y == 1).sum()]))
    weight = rare[y] / rare[y].mean()
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for pick in labelled.batches(len(y), BATCH, rng):
            at, doc = np.concatenate([x[i] for i in pick]), np.repeat(np.arange(len(pick)), held[pick])
            both, pairs = pairwise(vectors, at, doc, len(pick))
            z = bias + np.bincount(doc, linear[at], len(pick)) + pairs
            off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[pick]) * weight[pick] / len(pick)
            pull = off[doc]
            grad = np.bincount(at, pull, f)
            grad_v = np.stack([np.bincount(at, pull * (both[doc, k] - vectors[at, k]), f) for k in range(WIDTH)], axis=1)
            seen += grad**2
            seen_v += (grad_v**2).sum(axis=1)
            seen_b += off.sum() ** 2
            step, step_v = rate / np.sqrt(seen), rate / np.sqrt(seen_v)
            linear -= step * grad
            linear = np.sign(linear) * np.maximum(np.abs(linear) - step * L1, 0)
            vectors -= step_v[:, None] * grad_v
            norm = np.sqrt((vectors**2).sum(axis=1)) + 1e-12
            vectors *= np.maximum(0, 1 - step_v * GROUP_L1 / norm)[:, None]
            bias -= rate * off.sum() / np.sqrt(seen_b)
    live = np.flatnonzero((linear != 0) | vectors.any(axis=1))
    return Model({int(kept[i]): n for n, i in enumerate(live)}, linear[live], vectors[live], float(bias))


def fitted(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_PER_CLASS) -> Model:
    """The model fitted on at most ``most`` labelled rows of each class, held-out rows left out."""
    rows, share = labelled.sample(docs, labels, "toxic", most)
    y, ids, _ = labelled.gathered(rows, features)
    return train(y, ids, share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts get the score of a document without features; repeated rows score
    alike; without labels of both classes every score is the share of class 1 (0.5 if there
    are none); an empty table gives no rows. Labels, language, source and id are no inputs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))
    return labelled.scores(docs, lambda: shared.value.scorer(), CUT)
