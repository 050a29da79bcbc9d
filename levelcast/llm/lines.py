"""Lines that many documents share, dropped from all but the last of them by probing a perfect hash.

A line counts by its key: stripped of ASCII white space, A-Z lower-cased, ``LEAST_CHARS`` code points or more. Pairs of 64-bit hashes stand for
keys. They are counted over documents (a document counts a key once), and those in ``LEAST_DOCUMENTS`` or more are indexed: dealt to shards by the
first hash, and in each shard numbered by a minimal perfect hash (levels of bit arrays: at each level the keys that fall on a place of their own are
numbered by the rank of that place, the others go on; Limasset et al., 2017). The number leads to arrays of fingerprints (the second hash), counts and
last documents. Fewer than five bits a key number it; a line that is in no array is told by its fingerprint (chance 2**-64).

Documents probe the arrays while they are read: no line is joined. Arrays of up to ``INDEX_BYTES`` in all, measured, are sent to every
executor. Beyond that hashes of lines go to where their shard's arrays are (a shard that many lines ask is copied to several tasks), and the keys to be dropped come back to their documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
SEED = 7
#: Keys of a shard, about; bits of a level for each key left; bytes of all arrays up to which every executor gets them.
SHARD_KEYS, ROOM, INDEX_BYTES = 1 << 16, 2, 64 << 20
#: Probes of one task for a shard, about, where lines are sent to the shards.
PROBES = 1_000_000
#: Stands for a null id, before all others.
NO_ID = -(2**63)


def keys(text: str | None) -> list[tuple[int, bytes]]:
    """(number of the line, key) of the long lines of a text."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= LEAST_CHARS and len(bare := line.strip(BLANKS)) >= LEAST_CHARS:
            out.append((i, bare.encode("utf-8", "surrogatepass").lower()))
    return out


def hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, SEED) for k in found), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return first.view(np.int64) % shards


def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places of keys at a level."""
    x = (first ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29)) ^ second) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class Shard:
    """Arrays of one shard: levels of bits, the number of keys before each word of bits, fingerprints, counts, last documents."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], fingerprints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.levels, self.fingerprints, self.counts, self.last = levels, fingerprints, counts, last

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        """A shard of different keys."""
        left, levels, order, before = np.arange(len(first)), [], [], 0
        while len(left):
            size = 64 * -(-ROOM * len(left) // 64)
            at = _places(first[left], second[left], len(levels), size)
            often = np.bincount(at, minlength=size)
            alone = often == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            levels.append((size, words, ranks))
            mine = alone[at]
            order.append(left[mine][np.argsort(at[mine])])
            before += int(alone.sum())
            left = left[~mine]
        put = np.concatenate([np.zeros(0, np.int64), *order])
        return cls(levels, second[put], counts[put].astype(np.uint32), last[put])

    def number(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for some that are not there, and any number for others."""
        out, left = np.full(len(first), -1), np.arange(len(first))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _places(first[left], second[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (ranks[at >> 6] + below)[here]
            left = left[~here]
        return out

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, last document) of keys; 0 documents for keys that are not there."""
        at = self.number(first, second)
        if not len(self.fingerprints):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = (at >= 0) & (self.fingerprints[at] == second)
        return np.where(known, self.counts[at], 0), np.where(known, self.last[at], 0)

    def packed(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{k}{i}": a for i, level in enumerate(self.levels) for k, a in zip("swr", (np.array(level[0]), *level[1:]), strict=True)}
        np.savez(out, fingerprints=self.fingerprints, counts=self.counts, last=self.last, **arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        a = np.load(io.BytesIO(data), allow_pickle=False)
        levels = [(int(a[f"s{i}"]), a[f"w{i}"], a[f"r{i}"]) for i in range(sum(n.startswith("s") for n in a.files))]
        return cls(levels, a["fingerprints"], a["counts"], a["last"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def _asked(docs: DataFrame, shards: int = 1) -> DataFrame:
    """id, first, second and shard of the different long lines of every document (rows of ``id``, ``text`` and others, which pass)."""
    more = [c for c in docs.columns if c not in ("id", "text")]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = list({k for _, k in keys(text)})
                rows += [i] * len(own)
                found += own
            if not found:
                return None
            first, second = hashes(found)
            at = pa.array(rows)
            return pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(shard_of(first, shards)), *(batch.column(c).take(at) for c in more)], names=["id", "first", "second", "shard", *more])

        return each

    return common.map_arrow(docs.select("id", "text", *more), make, "id long, first long, second long, shard long" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more))


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """(shard, asks, packed, bytes) of the arrays of all keys that ``LEAST_DOCUMENTS`` or more documents have, and the number of shards.

    ``asks``: how many lines of documents will ask the shard's keys.
    """
    counted = _asked(_texts(docs)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    often = common.staged(counted.filter(F.col("n") >= LEAST_DOCUMENTS), "lines-often")
    shards = max(1, -(-often.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        first, second, n, last = (table.column(c).to_numpy() for c in ("first", "second", "n", "last"))
        data = Shard.build(first.view(np.uint64), second.view(np.uint64), np.minimum(n, 2**32 - 1), last).packed()
        return pa.table([table.column("shard")[:1], pa.array([int(n.sum())]), pa.array([data], pa.binary()), pa.array([len(data)])], names=["shard", "asks", "packed", "bytes"])

    dealt = often.withColumn("shard", F.pmod("first", F.lit(shards)).cast("long"))
    return common.staged(dealt.groupBy("shard").applyInArrow(build, "shard long, asks long, packed binary, bytes long"), "lines-index"), shards


def _row_key(column: str) -> T.StructField:
    return T.StructField(column, T.LongType())


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and columns ``n_lines`` (before) and ``n_dropped``, in place of any so named.

    A key in many documents stays in that of the largest id (in all its rows, if several have the id). Every row is a document: repeated rows
    count as often as they occur; a null id is less than all others; a null or empty text is one empty line; very long texts are read whole, line by line. Other
    columns, whatever their names, pass through; an empty table gives no rows.
    """
    common.missing_columns(docs, "doc_id", "text")
    shown = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in shown if c != "text"]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    table, shards = index(docs)
    size = table.agg(F.sum("bytes")).first()[0] or 0
    cut = _cut_here(rows, table, shards) if size <= INDEX_BYTES else _cut_there(rows, table, shards)
    made = {"text": F.col("text")}
    return cut.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in shown], "n_lines", "n_dropped")


_OUT = ["row", "text", "n_lines", "n_dropped"]


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *map(_row_key, _OUT[2:])])


def _without(text: str | None, drop: set[int]) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    return "\n".join(line for i, line in enumerate(lines) if i not in drop) if drop else text or "", len(lines), len(drop)


def _cut_here(rows: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """Every task has all arrays; their bytes have been counted."""
    sent = rows.sparkSession.sparkContext.broadcast({r.shard: bytes(r.packed) for r in table.select("shard", "packed").toLocalIterator()})

    def make():
        arrays = {s: Shard.unpacked(b) for s, b in sent.value.items()}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_numpy()
            found = [(i, n, k) for i, text in enumerate(texts) for n, k in keys(text)]
            drops: list[set[int]] = [set() for _ in texts]
            if found and arrays:
                first, second = hashes([k for *_, k in found])
                at, shard = np.array([i for i, *_ in found]), shard_of(first, shards)
                for s in np.unique(shard).tolist():
                    if s in arrays:
                        own = np.flatnonzero(shard == s)
                        n, last = arrays[s].probe(first[own], second[own])
                        for j in own[(n > 0) & (last != ids[at[own]])].tolist():
                            drops[found[j][0]].add(found[j][1])
            cut = [_without(t, d) for t, d in zip(texts, drops, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c[0] for c in cut], pa.string()), *(pa.array([c[k] for c in cut], pa.int64()) for k in (1, 2))], names=_OUT)

        return each

    return common.map_arrow(rows, make, _schema(rows))


def _cut_there(rows: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """Hashes of lines go to the tasks that hold their shard; what is to be dropped comes back to the documents."""
    keyed = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    copies = F.least(F.lit(1024), F.ceil(F.col("asks") / PROBES)).cast("long")
    several = {r.shard: r.copies for r in table.select("shard", copies.alias("copies")).filter("copies > 1").toLocalIterator()}
    # the shards with more than one copy are no more than all asks / PROBES
    spread = rows.sparkSession.createDataFrame(list(several.items()), "shard long, copies long")
    asked = _asked(keyed.select("id", "text", "t1", "t2"), shards).join(F.broadcast(spread), "shard", "left")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("id", "t1"), F.coalesce("copies", F.lit(1))).cast("long")).withColumn("packed", F.lit(None).cast("binary"))
    heads = table.select(*[F.lit(None).cast("long").alias(c) for c in ("id", "first", "second", "t1", "t2")], "shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "packed")
    names = ["id", "first", "second", "t1", "t2", "shard", "copy", "packed"]
    both = heads.select(*names).unionByName(asked.select(*names)).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("packed").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            own = list(zip(batch.column("shard").to_pylist(), batch.column("copy").to_pylist(), strict=True))
            heads = batch.column("packed")
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1] or heads[i].is_valid), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if heads[a].is_valid:
                    now, shard = own[a], Shard.unpacked(heads[a].as_py())
                    a += 1
                if a == b or own[a] != now:
                    continue  # a shard without keys
                part = batch.slice(a, b - a)
                first, second = (part.column(c).to_numpy().view(np.uint64) for c in ("first", "second"))
                n, last = shard.probe(first, second)
                drop = pa.array((n > 0) & (last != part.column("id").to_numpy()))
                yield part.select(["id", "t1", "t2", "first", "second"]).filter(drop)

    common.bounded(both.sparkSession)
    drops = both.mapInArrow(run, "id long, t1 long, t2 long, first long, second long")
    drops = drops.groupBy("id", "t1", "t2").agg(F.collect_set(F.struct("first", "second")).alias("drops"))
    joined = keyed.join(drops.hint("merge"), ["id", "t1", "t2"], "left").select("row", "text", "drops")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
                lost: set[int] = set()
                if drops:
                    pairs, found = {(d["first"], d["second"]) for d in drops}, keys(text)
                    first, second = hashes([k for _, k in found])
                    lost = {n for (n, _), a, b in zip(found, first.view(np.int64).tolist(), second.view(np.int64).tolist(), strict=True) if (a, b) in pairs}
                cut.append(_without(text, lost))
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c[0] for c in cut], pa.string()), *(pa.array([c[k] for c in cut], pa.int64()) for k in (1, 2))], names=_OUT)

        return each

    return common.map_arrow(joined, make, _schema(rows))


def lines_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of every document."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
