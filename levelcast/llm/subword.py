"""Quality classifier: supervised subword embeddings.

Words, character n-grams (of UTF-8 bytes) and word n-grams are hashed to rows of an embedding table; a document
is the mean of its rows, over the kinds' own means; a softmax over two classes reads that mean. The table and the output
layer are learned together by stochastic gradient descent in numpy, from a bounded sample of
labelled rows. In its mean, a word or word n-gram that the document has had before counts as a place but
adds no vector, so that a text which repeats itself has a shorter mean than one that goes on.

At scoring, a row of the table counts only through its product with the output layer, so the
model that executors get is one number per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled

#: Buckets of the embedding table by kind of feature, and its width.
SPACES = {"char": 1 << 14, "word": 1 << 13, "pair": 1 << 13, "triple": 1 << 10}
BUCKETS, WIDTH = sum(SPACES.values()), 8
FIRST = dict(zip(SPACES, np.cumsum([0, *SPACES.values()]).tolist(), strict=False))
EPOCHS, RATE, BATCH, DECAY = 6, 0.5, 32, 1e-5
#: A score from here up predicts class 1.
CUT = 0.3
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20
#: ASCII white space, which bounds words.
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: Powers of an odd number modulo 2**64, for the hash of a word; in longer words they repeat.
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, kind: str) -> np.ndarray:
    """Buckets of 64-bit values among those of a kind of feature."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h >> np.uint64(33)) % np.uint64(SPACES[kind])).astype(np.int64) + FIRST[kind]


def _words(b: np.ndarray, gap: np.ndarray, pending: np.uint64, place: int) -> tuple[np.ndarray, np.uint64, int]:
    """Hashes of the words that end in a slice, and the hash and length so far of one that goes on."""
    inside = np.diff(gap.astype(np.int8), prepend=np.int8(0 if place else 1)) == -1
    starts = np.flatnonzero(inside)
    heads = np.concatenate([[0], starts]).astype(np.int64)
    at = np.arange(len(b)) - np.repeat(heads, np.diff(np.append(heads, len(b))))
    at[: starts[0] if len(starts) else len(b)] += place
    part = np.where(gap, np.uint64(0), b.astype(np.uint64) + np.uint64(1)) * _POWERS[at % 4096]
    sums = np.array([part[i:j].sum(dtype=np.uint64) for i, j in ((0, heads[1] if len(heads) > 1 else len(b)),)], np.uint64)
    if len(starts):
        sums = np.concatenate([sums, np.add.reduceat(part, starts)])
    sums[:1] += np.array([pending], np.uint64)
    open_word = not gap[-1]
    ended = sums[: len(sums) - open_word]
    if not place:  # nothing was open before: the part before the first start is empty
        ended = ended[1:] if len(sums) > 1 or not open_word else ended
    return ended, (sums[-1] if open_word else np.uint64(0)), (int(at[-1]) + 1 if open_word else 0)


def buckets(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Buckets of a text's features in a few arrays, each with its kind and the places it takes in the mean.

    Of each word the 3-grams and 4-grams of its UTF-8 bytes, repeats included, where its bounds count as
    a space; case is kept. Of the words: themselves, pairs and triples, which give a bucket where they
    first occur and take a place wherever they do. The text is hashed in slices; words that go on from
    one slice to the next, however long, are hashed whole.
    """
    raw = text.encode("utf-8", "surrogatepass")
    last, ones, twos, threes = np.zeros(0, np.uint64), [], [], []
    pending, place = np.uint64(0), 0
    for at in range(0, len(raw), SLICE):
        end = min(at + SLICE, len(raw))
        # the byte before and three after, spaces beyond the text
        b = np.frombuffer((raw[at - 1 : at] or b" ") + raw[at:end] + (raw[end : end + 3] + b"   ")[:3], np.uint8)
        gap = SPACE[b]
        v = np.where(gap, np.uint8(32), b).astype(np.uint64)
        n = end - at
        inner = ~gap[1 : n + 1]
        three = (v[:n] << np.uint64(16)) | (v[1 : n + 1] << np.uint64(8)) | v[2 : n + 2]
        found = _bucket(three[inner] + np.uint64(1 << 40), "char")
        yield "char", found, len(found)
        both = inner & ~gap[2 : n + 2]
        found = _bucket(((three << np.uint64(8)) | v[3 : n + 3])[both] + np.uint64(1 << 41), "char")
        yield "char", found, len(found)
        words, pending, place = _words(b[1 : n + 1], gap[1 : n + 1], pending, place)
        if end == len(raw) and place:
            words = np.append(words, pending)
        if not len(words):
            continue
        ones.append(words)
        line = np.concatenate([last, words])
        two = line[:-1] * _MIX + line[1:]
        twos.append(two[max(0, len(last) - 1) :])
        if len(line) > 2:
            threes.append(two[:-1] * _MIX + line[2:])
        last = line[-2:]
    for kind, parts in (("word", ones), ("pair", twos), ("triple", threes)):
        if parts:
            every = np.concatenate(parts)
            yield kind, _bucket(np.unique(every), kind), len(every)


def features() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a text to its buckets and the share of each in the mean."""

    def look(text: str) -> tuple[np.ndarray, np.ndarray]:
        count, places = np.zeros(BUCKETS, np.int64), dict.fromkeys(SPACES, 0)
        for kind, found, n in buckets(text):
            count += np.bincount(found, minlength=BUCKETS)
            places[kind] += n
        at = np.flatnonzero(count)
        whole = np.repeat([max(1, n) * len(SPACES) for n in places.values()], list(SPACES.values()))
        return at, count[at] / whole[at]

    return look


@dataclass
class Model:
    """Per bucket, the difference of the two classes' logits that its embedding makes; and the bias."""

    pull: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str], float]:
        pull, bias = self.pull, self.bias

        def score(text: str) -> float:
            total, places = dict.fromkeys(SPACES, 0.0), dict.fromkeys(SPACES, 0)
            for kind, found, n in buckets(text):
                total[kind] += float(pull[found].sum())
                places[kind] += n
            mean = sum(total[k] / max(1, places[k]) for k in SPACES) / len(SPACES)
            return float(1 / (1 + np.exp(-np.clip(bias + mean, -50, 50))))

        return score


def train(y: np.ndarray, ids: list[np.ndarray], shares: list[np.ndarray], share: float, seed: int = 0) -> Model:
    """Fit by minibatch gradient descent with adaptive steps (AdaGrad).

    Classes weigh alike, so a score is the probability at even odds. With one class only,
    every score is ``share``, class 1's share of all labels.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
    seen, seen_out, seen_bias = np.full(BUCKETS, 1e-8), np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)
    n = len(y)
    if not n or y.min() == y.max():
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    held = np.array([len(i) for i in ids])
    weight = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for pick in labelled.batches(n, BATCH, rng):
            at, x = np.concatenate([ids[i] for i in pick]), np.concatenate([shares[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), held[pick])
            mean = np.stack([np.bincount(doc, x * table[at, k], len(pick)) for k in range(WIDTH)], axis=1)
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None]
            grad_out, grad_bias = mean.T @ p, p.sum(axis=0)
            back = p @ out.T
            grad = np.stack([np.bincount(at, x * back[doc, k], BUCKETS) for k in range(WIDTH)], axis=1)
            seen += (grad**2).sum(axis=1)
            table -= (rate / np.sqrt(seen))[:, None] * grad + DECAY * table
            seen_out += grad_out**2
            out -= rate * grad_out / np.sqrt(seen_out)
            seen_bias += grad_bias**2
            bias -= rate * grad_bias / np.sqrt(seen_bias)
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_PER_CLASS) -> Model:
    """The model fitted on at most ``most`` labelled rows of each class, held-out rows left out."""
    rows, share = labelled.sample(docs, labels, "quality", most)
    return train(*labelled.gathered(rows, features), share)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts get the score of a document without features; repeated rows score
    alike; without labels of both classes every score is the share of class 1 (0.5 if there
    are none); an empty table gives no rows. Labels, language, source and id are no inputs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))
    return labelled.scores(docs, lambda: shared.value.scorer(), CUT)
