"""Mixture-controlled packing by deficit round-robin over source queues.

All documents of a source form one queue, a stream of token ids. A round adds to each
queue's deficit its share of the round; a queue then sends as many whole quanta as its
deficit covers and carries the rest. The number of quanta a queue has sent before round
``r`` is therefore ``floor(c * r / rounds)`` (``c``: the quanta it sends in this phase), so
the state of the scheduler at any window, deficits included, follows from the queue totals
alone. Every task places its own documents without seeing another task's: deficits are
carried across windows and across partitions, and no task simulates the whole schedule.

With the natural proportions (the default) all queues run dry together and there is one
phase. With given weights a queue that runs dry leaves, and a new phase shares its weight
out among the others.

Queues are scheduled in groups of at most ``FANOUT``, the groups in the same way, and so on up, so
that a quantum's place is found in a few short sums however many sources there are. Groups are made
of queues that run dry at about the same time.

The stream of quanta, followed by what each queue has left below one quantum, is cut every
``seq_len`` ids; the last remainder is cut into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ids after which a task begins a new chunk of its tokenized rows.
CHUNK_TOKENS = 4_000_000
#: Queues, or groups of queues, that take turns with one another.
FANOUT = 256
#: Rounds up to which products of a round and a quantum count fit in 64 bits.
MAX_ROUNDS = 2**31
#: Text of these characters is split alike by both libraries (checked by a test); other text goes to ``tokenizers``.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")


def encoder(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids of the tokenizer file ``json_path``, as ``encode(text, add_special_tokens=False)`` gives them.

    ``ranks_path`` may name the same vocabulary as ranks: plain text without any added token's
    string then takes the faster library, which gives the same ids.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if not ranks_path:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(t in text for t in added):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


class Turns:
    """Deficit round-robin among a few queues (or groups) with given numbers of quanta."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray | None, per_round: int) -> None:
        """Phases: what each queue sends until the next one runs dry. A round is about ``per_round`` quanta."""
        self.phases: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        weight = slots.astype(float) if weights is None else np.asarray(weights, float)
        left, base = slots.copy(), 0
        sent = np.zeros_like(left)
        while left.sum():
            live = (left > 0) & (weight > 0)
            if not live.any():  # only queues of weight zero are left: they drain by size
                weight = left.astype(float)
                continue
            if weights is None:
                count = left.copy()
            else:
                span = (left[live] / weight[live]).min()
                count = np.where(live, np.minimum(left, np.ceil(weight * span).astype(np.int64)), 0)
            n = int(count.sum())
            rounds = max(1, -(-n // per_round))
            rounds = max(1, -(-rounds // -(-rounds // MAX_ROUNDS)))
            self.phases.append((sent.copy(), count, rounds, base))
            sent, left, base = sent + count, left - count, base + n

    def place(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Place among all queues' quanta of each queue's given quantum."""
        out = np.empty(len(slot), np.int64)
        for sent, count, rounds, base in self.phases:
            pick = np.flatnonzero((slot >= sent[queue]) & (slot < sent[queue] + count[queue]))
            for part in np.array_split(pick, max(1, len(pick) * len(count) // 1_000_000)):
                q = queue[part]
                k = slot[part] - sent[q]
                r = -(-(k + 1) * rounds // count[q]) - 1
                before = r[:, None] * count[None, :] // rounds
                upto = (r[:, None] + 1) * count[None, :] // rounds
                ahead = np.where(np.arange(len(count))[None, :] < q[:, None], upto, before)
                own = before[np.arange(len(part)), q]
                out[part] = base + ahead.sum(axis=1) - own + k
        return out


@dataclass
class Schedule:
    """The deficit round-robin schedule of queues with given token totals."""

    totals: np.ndarray
    seq_len: int = 1024
    quantum: int = 128
    weights: np.ndarray | None = None
    levels: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.seq_len % self.quantum:
            raise ValueError("seq_len must be a multiple of quantum")
        self.totals = np.asarray(self.totals, dtype=np.int64)
        self.slots = self.totals // self.quantum
        rest = self.totals - self.slots * self.quantum
        self.rest_at = int(self.slots.sum()) * self.quantum + np.concatenate([[0], np.cumsum(rest)[:-1]]).astype(np.int64)
        total = int(self.totals.sum())
        full, rest = divmod(total, self.seq_len)
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full = full
        self.tail_starts = full * self.seq_len + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self._plan()

    def _plan(self) -> None:
        """Levels, from the queues up: each member's group and number there, and the groups' turns."""
        slots, weights = self.slots, None if self.weights is None else np.asarray(self.weights, float)
        per_round = self.seq_len // self.quantum
        while True:
            n = len(slots)
            if n <= FANOUT:
                self.levels.append((np.zeros(n, np.int64), np.arange(n), [Turns(slots, weights, per_round)]))
                return
            if weights is None:
                sets = [np.arange(n)]
            else:  # members of weight zero follow all others, so they share no group with them
                span = slots / np.maximum(weights, 1e-300)
                sets = [s[np.argsort(span[s], kind="stable")] for s in (np.flatnonzero(weights > 0), np.flatnonzero(weights <= 0)) if len(s)]
            groups = [s[i : i + FANOUT] for s in sets for i in range(0, len(s), FANOUT)]
            group, number = np.empty(n, np.int64), np.empty(n, np.int64)
            for g, own in enumerate(groups):
                group[own], number[own] = g, np.arange(len(own))
            self.levels.append((group, number, [Turns(slots[own], None if weights is None else weights[own], per_round) for own in groups]))
            slots = np.array([slots[own].sum() for own in groups])
            weights = None if weights is None else np.array([weights[own].sum() for own in groups])

    def place(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Place in the stream of quanta of each queue's given quantum."""
        member, at = queue, slot
        for group, number, turns in self.levels:
            own, up = group[member], np.empty(len(at), np.int64)
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if len(part):
                    up[part] = turns[own[part[0]]].place(number[member[part]], at[part])
            member, at = own, up
        return at

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence id and offset there of each place in the stream of ids."""
        seq, off = at // self.seq_len, at % self.seq_len
        tail = at >= self.full * self.seq_len
        if tail.any():
            n = np.searchsorted(self.tail_starts, at[tail], side="right") - 1
            seq[tail], off[tail] = self.full + n, at[tail] - self.tail_starts[n]
        return seq, off

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        """Cut documents (queue, place in the queue's stream, ids) into runs within sequences.

        Returns for each run the document's index, the ids of the document before it, its
        length, its sequence and its offset there.
        """
        first, last = start // self.quantum, (start + length - 1) // self.quantum
        n = last - first + 1
        doc = np.repeat(np.arange(len(queue)), n)
        slot = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        lo = np.maximum(slot * self.quantum, start[doc])
        hi = np.minimum((slot + 1) * self.quantum, (start + length)[doc])
        q = queue[doc]
        whole = slot < self.slots[q]
        at = np.empty(len(doc), np.int64)
        at[whole] = self.place(q[whole], slot[whole]) * self.quantum + lo[whole] % self.quantum
        at[~whole] = (self.rest_at[q] + lo - self.slots[q] * self.quantum)[~whole]
        # beyond the whole quanta, and between the short last sequences, a cut may fall inside a part
        begin = int(self.slots.sum()) * self.quantum
        cuts = np.concatenate([np.arange(begin // self.seq_len, self.full + 1) * self.seq_len, self.tail_starts[1:]])
        late = np.flatnonzero(at + (hi - lo) > min(begin, self.full * self.seq_len))
        if len(late):
            extra = [(i, c - at[i]) for i in late for c in cuts if at[i] < c < at[i] + hi[i] - lo[i]]
            if extra:
                who = np.array([i for i, _ in extra])
                by = np.array([d for _, d in extra], np.int64)
                order = np.lexsort((np.concatenate([lo, lo[who] + by]), np.concatenate([doc, doc[who]])))
                new_lo, new_at, new_doc = np.concatenate([lo, lo[who] + by])[order], np.concatenate([at, at[who] + by])[order], np.concatenate([doc, doc[who]])[order]
                end = (start + length)[new_doc]
                same = np.append(new_doc[1:] == new_doc[:-1], False)
                hi = np.where(same, np.append(new_lo[1:], 0), end)
                lo, at, doc = new_lo, new_at, new_doc
        seq, off = self.sequence(at)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1])
        heads = np.flatnonzero(fresh)
        size = np.add.reduceat(hi - lo, heads) if len(heads) else np.zeros(0, np.int64)
        return {"doc": doc[heads], "start": (lo - start[doc])[heads], "length": size, "sequence_id": seq[heads], "offset": off[heads]}


def tokenized(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """Ids of each whole text and ``end_id``, with the place of the document in its chunk's part of its queue.

    A chunk holds the rows one task has read since the last chunk, about ``CHUNK_TOKENS`` ids.
    """
    common.missing_columns(docs, "doc_id", "text", "source")
    common.bounded(docs.sparkSession)
    schema = "chunk long, queue string, doc_id long, local_at long, n long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(json_path, ranks_path, pattern)
        chunk, seen, at = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            cols = {name: [] for name in ("chunk", "queue", "doc_id", "local_at", "n", "ids")}
            for doc_id, text, queue in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if seen >= CHUNK_TOKENS:
                    chunk, seen, at = chunk + 1, 0, {}
                ids = np.array(encode(text or "") + [end_id], dtype="<u4")
                n, before = len(ids), at.get(queue, 0)
                at[queue], seen = before + n, seen + n
                small = ids.astype("<u2") if ids.max() < 65536 else ids
                for name, v in zip(cols, (chunk, queue, doc_id, before, n, small.tobytes()), strict=True):
                    cols[name].append(v)
            if cols["n"]:
                yield pa.RecordBatch.from_arrays([pa.array(cols["chunk"], pa.int64()), pa.array(cols["queue"], pa.string()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["local_at"], pa.int64()), pa.array(cols["n"], pa.int64()), pa.array(cols["ids"], pa.binary())], names=list(cols))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), common.key("source")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    seq_len: int = 1024,
    quantum: int = 128,
    weights: Mapping[str | None, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``seq_len`` ids, mixed by source.

    A null text is an empty one and gives the end id alone; a null source is a queue of its
    own; repeated rows are packed as often as they occur; an empty table gives no rows; other
    columns are ignored. A source's totals, one row each, go to the driver. ``weights``: token shares by source, 0 where a source is not named
    (such sources follow when the others have run dry); None: the shares of the input.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source and, if asked for, the piece's ids.
    """
    spark = docs.sparkSession
    table = common.staged(tokenized(docs, json_path, ranks_path, pattern), "pack-ids")
    parts = common.staged(table.groupBy("chunk", "queue").agg(F.sum("n").alias("n")), "pack-parts")
    totals = sorted((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    names = [q for q, _ in totals]
    share = None
    if weights is not None:
        named = {"" if k is None else f"={k}": float(v) for k, v in weights.items()}
        share = np.array([named.get(q, 0.0) for q in names])
    schedule = Schedule(np.array([n for _, n in totals], dtype=np.int64), seq_len, quantum, share)
    number = {q: i for i, q in enumerate(names)}
    order = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("chunk", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    bases = common.sized(bases, parts.count())
    placed = table.join(bases, ["chunk", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("local_at")).alias("at"), "n", "ids")
    shared = spark.sparkContext.broadcast((schedule, number))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids

    def make():
        schedule, number = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc_id, queue, at, n, ids = batch.columns
            lines = np.array([number[x] for x in queue.to_pylist()], np.int64)
            at, n = at.to_numpy(), n.to_numpy()
            cut = schedule.pieces(lines, at, n)
            doc, start, length = cut["doc"], cut["start"], cut["length"]
            crc = np.empty(len(doc), np.int64)
            own: list = []
            held, wide, view = -1, None, None
            raw = ids.to_pylist()
            for i, (d, a, b) in enumerate(zip(doc.tolist(), (start * 4).tolist(), ((start + length) * 4).tolist(), strict=True)):
                if d != held:
                    held, wide = d, np.frombuffer(raw[d], "<u2" if len(raw[d]) == 2 * n[d] else "<u4").astype("<u4")
                    view = memoryview(wide.tobytes())
                crc[i] = zlib.crc32(view[a:b])
                if with_ids:
                    own.append(wide[a // 4 : b // 4].astype(np.int32))
            source = [x[1:] if x else None for x in queue.to_pylist()]
            out = [doc_id.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(cut["sequence_id"]), pa.array(cut["offset"]), pa.array(source, pa.string()).take(pa.array(doc))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                flat = np.concatenate(own) if own else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names=names)

        return each

    return common.map_arrow(placed, make, schema)
