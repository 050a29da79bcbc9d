import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from levelcast.llm import packing
from levelcast.llm.queries import op1_packing, tokenizer_files

from .fixtures import awkward, clashing, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(found, texts, seq_len=1024):
    """Every id in one piece, sequences gapless, nothing padded but powers of two."""
    for s, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all(), s
        n = int(g.length.sum())
        assert n == seq_len or n & (n - 1) == 0 and n < seq_len
    assert found.length.sum() == sum(len(ids_of(t)) for t in texts)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_places_every_id_once(seed):
    rng = np.random.default_rng(seed)
    queues = int(rng.integers(1, 30))
    n, q = rng.integers(1, 4000, 300), rng.integers(0, queues, 300)
    start, totals = np.zeros(300, np.int64), np.zeros(queues, np.int64)
    for i in range(300):
        start[i], totals[q[i]] = totals[q[i]], totals[q[i]] + n[i]
    weights = rng.random(queues) * (rng.random(queues) > 0.2) if seed % 2 else None
    s = packing.Schedule(totals, 1024, 128, weights)
    c = s.pieces(q, start, n)
    at = np.concatenate([np.arange(o, o + k) + 10_000_000 * sid for o, k, sid in zip(c["offset"], c["length"], c["sequence_id"], strict=True)])
    assert len(at) == len(np.unique(at)) == n.sum()
    own = np.concatenate([np.arange(a, a + k) + 10_000_000 * d for a, k, d in zip(c["start"], c["length"], c["doc"], strict=True)])
    assert len(np.unique(own)) == n.sum()


@pytest.mark.parametrize("weighted", [False, True])
def test_five_thousand_queues(weighted):
    """Any number of queues is scheduled one by one; in every window each group's share and each queue's hold."""
    rng = np.random.default_rng(8)
    totals = rng.integers(0, 6000, 5000)
    weights = rng.random(5000) * (rng.random(5000) > 0.1) if weighted else None
    s = packing.Schedule(totals, weights=weights)
    q = np.repeat(np.arange(5000), s.slots)
    k = np.concatenate([np.arange(n) for n in s.slots])
    place = s.place(q, k)
    assert (np.sort(place) == np.arange(s.slots.sum())).all()
    for i in range(0, 5000, 97):
        assert (np.diff(place[q == i]) > 0).all()
    if weighted:  # queues without a weight follow when the others have run dry
        assert place[weights[q] == 0].min() > place[weights[q] > 0].max()
        early = place < s.slots.sum() // 20
        sent = np.bincount(q[early], minlength=5000)
        live = (weights > 0) & (s.slots > 40)
        assert np.corrcoef(sent[live], weights[live])[0, 1] > 0.5
    else:
        big = np.flatnonzero(s.slots >= 20)
        done = np.bincount(q[place < s.slots.sum() // 2], minlength=5000)
        assert np.abs(done[big] - s.slots[big] / 2).max() <= 3


def test_groups_keep_the_proportions_of_weights():
    totals = np.full(600, 128_000)
    weights = np.where(np.arange(600) % 3 == 0, 3.0, 1.0)
    s = packing.Schedule(totals, weights=weights)
    q = np.repeat(np.arange(600), s.slots)
    place = s.place(q, np.concatenate([np.arange(n) for n in s.slots]))
    for upto in (60_000, 120_000, 200_000):
        sent = np.bincount(q[place < upto], minlength=600)
        want = upto * weights / weights.sum()
        assert np.abs(sent - want).max() <= 4


def test_strings_of_added_tokens_are_the_tokenizers_own():
    slow, fast = Tokenizer.from_file(PATH), packing.encoder(**tokenizer_files())
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    assert added
    for t in added:
        for text in (f"a {t} b", t, f"x{t}{t}", f"{t[:-1]} {t}"):
            assert fast(text) == slow.encode(text, add_special_tokens=False).ids
    assert packing.encoder(PATH)("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_every_window_keeps_the_proportions():
    totals = np.array([500_000, 200_000, 50_000, 7_000])
    s = packing.Schedule(totals)
    q = np.repeat(np.arange(4), s.slots)
    place = s.place(q, np.concatenate([np.arange(k) for k in s.slots]))
    window = place // 8
    for k in range(4):
        sent = np.bincount(window[q == k], minlength=window.max() + 1).cumsum()
        want = (np.arange(len(sent)) + 1) * 8 * totals[k] / totals.sum()
        assert np.abs(sent - want)[:-1].max() <= 4


def test_given_weights_hold_until_a_queue_is_dry():
    s = packing.Schedule(np.array([1_000_000, 100_000]), weights=np.array([0.5, 0.5]))
    place = s.place(np.ones(int(s.slots[1]), np.int64), np.arange(s.slots[1]))
    assert place.max() < 2.1 * s.slots[1]


def test_both_libraries_split_plain_text_alike():
    slow, fast = packing.encoder(PATH), packing.encoder(**tokenizer_files())
    every = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x180)])
    for text in [every, every[::-1], "a\t\t b\n\n\n c  d   e\r\n", "It's we'll 'S 12 345,6 a1b2 ", *[f"x{c}{c} {c}1" for c in every]]:
        assert slow(text) == fast(text), text


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = packing.pack(clashing(docs), **tokenizer_files(), with_ids=True).toPandas()
    rows = docs.collect()
    check(found, [r.text for r in rows])
    want = {r.doc_id: ids_of(r.text) for r in rows if r.doc_id != 7}
    for r in found[found.doc_id.isin(list(want))].itertuples():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and list(r.ids) == part.tolist() and r.doc_tokens == len(want[r.doc_id])
    assert found.doc_id.isna().any() and set(found.source.dropna()) == {"a", "b", "c"}


def test_empty_table(spark):
    assert packing.pack(empty(spark), **tokenizer_files()).count() == 0


def test_query(spark):
    found = op1_packing(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    check(found, docs.text)
    assert found.doc_id.nunique() == len(docs)
