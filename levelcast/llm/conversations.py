"""Repair of the structure of conversations by signature deduplication.

The roles of a repaired conversation follow ``(s?(ua)+)?``: perhaps a system row, then turns of user and assistant. Rows can be
kept (0), get the role user or assistant (1), be deleted (2; blank and repeated rows must be) or be inserted without text (5); a row that ends without
``.!?`` and stays costs 5 more. Of the cheapest edits those whose letters D, I, K, R are least in ASCII order are taken.

A row matters only by its role's initial and its fault, so a conversation is a string of nine symbols, its signature. Many
conversations have the same one: each different signature is solved once, by memoised recursion over its halves. The solution of a piece gives, for each
pair of the pattern's four states before and after it, the cheapest cost and letters; solutions of adjacent pieces
add up. (Inserts are written before the row that follows them, so the letters of n rows are n words of a prefix code, and the least
of joined strings is joined of least strings.) So a conversation longer than ``PIECE`` rows, or one that a partition's end cuts, is several signatures, and no
task holds it whole. Solutions are joined back on the signature, and the letters are replayed over the sorted rows.

Order within a conversation: turn, nulls first, then a digest of role and text, so that equal rows are neighbours. Roles count by their first
character; null roles and texts are one space. A conversation without an id is one like others. A very long conversation's rows are sorted and solved in many tasks,
and replayed by one task in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a signature at most.
PIECE = 4096
#: Signatures up to this length are remembered by a worker, and how many of them.
REMEMBERED, REMEMBER = 64, 20_000
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the pattern: at the start, after the system row, after a user's, after an assistant's. Its end may follow the first and the last.
STATES = 4
NEXT_ROLE = ("u", "u", "a", "u")
AFTER = {"s": 1, "u": 2, "a": 3}
ROLES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
#: A null turn sorts before all others.
NO_TURN = -(2**63)

Solution = tuple[dict[int, tuple[int, str]], ...]


@lru_cache(maxsize=None)
def inserted(state: int) -> tuple[tuple[int, int, str], ...]:
    """States to be reached by inserting rows, with cost and letters."""
    out = [(state, 0, "")]
    for _ in range(2):
        at, cost, letters = out[-1]
        out.append((AFTER[NEXT_ROLE[at]], cost + COST["I"], letters + "I"))
    return tuple(out)


@lru_cache(maxsize=None)
def one_row(symbol: str) -> Solution:
    """The solution of one row: for each state before it, the best (cost, letters) of each state after it."""
    role, stays = symbol.lower(), TRUNCATED_COST if symbol.isupper() else 0
    out = []
    for state in range(STATES):
        best: dict[int, tuple[int, str]] = {}
        for at, cost, letters in inserted(state):
            ways = [(at, "D", 0)]
            if role != "x":
                ways.append((AFTER[NEXT_ROLE[at]], "R", stays))
                if role == NEXT_ROLE[at] or (role == "s" and at == 0):
                    ways.append((AFTER[role], "K", stays))
            for to, letter, more in ways:
                way = (cost + COST[letter] + more, letters + letter)
                if to not in best or way < best[to]:
                    best[to] = way
        out.append(best)
    return tuple(out)


def joined(left: Solution, right: Solution) -> Solution:
    """The solution of two adjacent pieces."""
    out = []
    for before in left:
        best: dict[int, tuple[int, str]] = {}
        for mid, (cost, letters) in before.items():
            for to, (more, rest) in right[mid].items():
                if to not in best or (cost + more, letters + rest) < best[to]:
                    best[to] = (cost + more, letters + rest)
        out.append(best)
    return tuple(out)


@lru_cache(maxsize=REMEMBER)
def _remembered(signature: str) -> Solution:
    if len(signature) == 1:
        return one_row(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return joined(_remembered(signature[:half]), _remembered(signature[half:]))


def solved(signature: str) -> Solution:
    """The solution of a signature; equal parts of up to ``REMEMBERED`` rows are solved once in a worker."""
    if len(signature) <= REMEMBERED:
        return _remembered(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return joined(solved(signature[:half]), solved(signature[half:]))


def closed(before: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest (cost, letters) of a whole conversation, given those of its last row by state."""
    ends = []
    for state, (cost, letters) in before.items():
        ends += [(cost + more, letters + tail) for at, more, tail in inserted(state) if at in (0, 3)]
    return min(ends)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults: by the CRC-32 of ``conv_id:turn`` one row in twenty each is dropped, loses its text, loses its
    full stops, is repeated, or gets the role user."""
    common.missing_columns(convs, "conv_id", "turn", "role", "text")
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_filled("text"), ".!?", "")).otherwise(_filled("text"))
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.filter("kind != 0").withColumn("copy", copies).drop("kind", "copy")


def _ordered(convs: DataFrame) -> DataFrame:
    """ckey (a non-null key of conv_id), conv_id, turn, at (turn for sorting), digest, role and text of every row."""
    rows = convs.select(common.key("conv_id").alias("ckey"), "conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("ckey", "conv_id", "turn", F.coalesce("turn", F.lit(NO_TURN)).alias("at"), digest.alias("digest"), "role", "text")


def _facts(rows: DataFrame) -> DataFrame:
    """ckey, turn, at, digest, symbol of the role and fault of every row, without its text; later rows of a role and text are repeats."""
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    facts = common.staged(rows.select("ckey", "turn", "at", "digest", symbol.alias("symbol"), fault.alias("fault")), "conv-facts")
    again = facts.groupBy("ckey", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("rows")).filter("first < last").drop("last")
    again = common.staged(again, "conv-again")
    return common.keyed_join(facts, again, ["ckey", "digest"], "rows", "left").withColumn("later", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("first")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def pieces(rows: DataFrame) -> DataFrame:
    """Signatures of the conversations, cut at ``PIECE`` rows and where partitions end: (ckey, part, seq, signature, counts of the piece,
    its first and last symbol and turn). Pieces of a conversation are ordered by part and seq."""
    facts = _facts(rows).repartitionByRange("ckey", "at", "digest").sortWithinPartitions("ckey", "at", "digest")
    names = ["ckey", "part", "seq", "signature", *_COUNTS, "first_symbol", "last_symbol", "least", "most"]
    piece_rows = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now = prev = None
        seq = 0
        signature: list[str] = []
        counts = dict.fromkeys(_COUNTS, 0)
        first = last = None
        least = most = None
        done: list[tuple] = []

        def close() -> None:
            if signature:
                done.append((now, part, seq, "".join(signature), *counts.values(), first, last, least, most))

        for batch in batches:
            for ckey, turn, digest, symbol, fault, later in zip(*(batch.column(c).to_pylist() for c in ("ckey", "turn", "digest", "symbol", "fault", "later")), strict=True):
                if ckey != now or len(signature) == piece_rows:
                    close()
                    seq = seq + 1 if ckey == now else 0
                    if ckey != now:
                        prev = None
                    now, signature, first, least, most = ckey, [], symbol, None, None
                    counts = dict.fromkeys(_COUNTS, 0)
                elif last + symbol not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                if fault == "blank":
                    kind = "blank"
                elif later or prev == (turn, digest):
                    kind = "duplicate"
                else:
                    kind = fault
                if kind:
                    counts[kind] += 1
                signature.append("x" if kind in ("blank", "duplicate") else symbol.upper() if kind else symbol)
                if turn is not None:
                    counts["turns"] += most is None or turn != most
                    least, most = turn if least is None else least, turn
                last, prev = symbol, (turn, digest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (11, 12) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*done, strict=True))], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (11, 12) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*done, strict=True))], names=names)

    kinds = "ckey string, part long, seq long, signature string, blank long, duplicate long, truncated long, illegal long, turns long, first_symbol string, last_symbol string, least long, most long"
    common.bounded(facts.sparkSession)
    return facts.select("ckey", "turn", "digest", "symbol", "fault", "later").mapInArrow(run, kinds)


def summed(cut: DataFrame) -> DataFrame:
    """ckey, gaps, blank, duplicate, truncated, illegal and the number of pieces of every conversation."""
    by = Window.partitionBy("ckey").orderBy("part", "seq")
    before = lambda c: F.lag(c).over(by)
    pair = F.concat(before("last_symbol"), F.col("first_symbol"))
    rows = cut.withColumn("meets", F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0)))
    # a turn that one piece ends with and the next begins with is one turn
    rows = rows.withColumn("same", F.coalesce((F.last("most", True).over(by.rowsBetween(Window.unboundedPreceding, -1)) == F.col("least")).cast("long"), F.lit(0)))
    span = F.max("most") - F.min("least") + 1 - (F.sum("turns") - F.sum("same"))
    return rows.groupBy("ckey").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("meets")).alias("illegal"), F.count(F.lit(1)).alias("pieces"))


def solutions(cut: DataFrame) -> DataFrame:
    """One row per different signature: rows (how many pieces have it), cost and audit of a whole conversation of it, and costs, ranks and
    letters for each pair of states (16 of each; cost -1 and null letters where there is no way)."""
    different = cut.groupBy("signature").agg(F.count(F.lit(1)).alias("rows"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole, costs, ranks, letters = [], [], [], []
            for signature in batch.column(0).to_pylist():
                way = solved(signature)
                whole.append(closed(way[0]))
                places = [sorted(w[1] for w in before.values()) for before in way]
                ways = [(way[s].get(t), places[s]) for s in range(STATES) for t in range(STATES)]
                costs.append([-1 if w is None else w[0] for w, _ in ways])
                ranks.append([-1 if w is None else p.index(w[1]) for w, p in ways])
                letters.append([None if w is None else w[1] for w, _ in ways])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c for c, _ in whole], pa.int64()), pa.array([a for _, a in whole]), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64())), pa.array(letters, pa.list_(pa.string()))],
                names=["signature", "rows", "cost", "audit", "costs", "ranks", "letters"],
            )

        return each

    return common.map_arrow(different, make, "signature string, rows long, cost long, audit string, costs array<long>, ranks array<long>, letters array<string>")


def chain(costs: np.ndarray, ranks: np.ndarray) -> tuple[list[int], int, str]:
    """States along the pieces of one conversation (one more than pieces), cost, and letters after the last row."""
    ends = {s: min((more, tail) for at, more, tail in inserted(s) if at in (0, 3)) for s in range(STATES)}
    least = [ends[s][0] for s in range(STATES)]
    choice = []
    for c, k in zip(costs[::-1], ranks[::-1], strict=True):
        best = [min((int(c[s, t]) + least[t], int(k[s, t]), t) for t in range(STATES) if c[s, t] >= 0) for s in range(STATES)]
        least = [b[0] for b in best]
        choice.append([b[2] for b in best])
    states = [0]
    for to in choice[::-1]:
        states.append(to[states[-1]])
    return states, least[0], ends[states[-1]][1]


def audits(cut: DataFrame, counts: DataFrame, solutions_: DataFrame) -> DataFrame:
    """ckey, cost and audit (the letters of the cheapest edits) of every conversation; all three tables are staged."""
    several = common.staged(counts.filter("pieces > 1").select("ckey", "pieces"), "conv-several")
    one = cut.join(counts.filter("pieces = 1").select("ckey"), "ckey", "left_semi").select("ckey", "signature")
    whole = common.keyed_join(one, solutions_.select("signature", "rows", "cost", "audit"), ["signature"], "rows").select("ckey", "cost", "audit")
    if several.isEmpty():
        return whole
    parts = common.staged(common.keyed_join(cut, several, ["ckey"], "pieces").select("ckey", "part", "seq", "signature"), "conv-parts")
    steps = common.keyed_join(parts, solutions_.select("signature", "rows", "costs", "ranks"), ["signature"], "rows")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        shaped = lambda c: np.array(table.column(c).to_pylist(), np.int64).reshape(-1, STATES, STATES)
        states, cost, tail = chain(shaped("costs"), shaped("ranks"))
        n = table.num_rows
        pair = [s * STATES + t + 1 for s, t in zip(states[:-1], states[1:], strict=True)]
        return pa.table([table.column("ckey"), table.column("part"), table.column("seq"), table.column("signature"), pa.array(pair, pa.int32()), pa.array([cost] * n, pa.int64()), pa.array([""] * (n - 1) + [tail])], names=["ckey", "part", "seq", "signature", "pair", "cost", "tail"])

    # a group is one row per 4,096 rows of a conversation, and per partition it lies in
    walked = steps.groupBy("ckey").applyInArrow(walk, "ckey string, part long, seq long, signature string, pair int, cost long, tail string")
    told = common.keyed_join(walked, solutions_.select("signature", "rows", "letters"), ["signature"], "rows")
    letters = F.concat(F.element_at("letters", F.col("pair")), F.col("tail"))
    put = told.groupBy("ckey").agg(F.first("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("part", "seq", letters.alias("a")))).alias("all"))
    return whole.unionByName(put.select("ckey", "cost", F.array_join(F.transform("all", lambda p: p["a"]), "").alias("audit")))


def replayed(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired rows: ckey, position, role and text; each conversation's rows come in one partition, in order."""
    heads = audit.select("ckey", F.lit(NO_TURN).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("ckey", "at", "digest", "role", "text"))
    both = both.repartition("ckey").sortWithinPartitions("ckey", F.col("role").isNotNull(), "at", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, at, state, position = None, "", 0, 0, 0
        done: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal state, position
            state = AFTER[role[:1]]
            done.append((now, position, role, text))
            position += 1

        def inserts() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                put(ROLES[NEXT_ROLE[state]], "")
                at += 1

        for batch in batches:
            for ckey, role, text in zip(*(batch.column(c).to_pylist() for c in ("ckey", "role", "text")), strict=True):
                if role is None:
                    inserts()
                    now, letters, at, state, position = ckey, text, 0, 0, 0
                    continue
                inserts()
                letter = letters[at]
                at += 1
                if letter == "K":
                    put(role, text)
                elif letter == "R":
                    put(ROLES[NEXT_ROLE[state]], text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["ckey", "position", "role", "text"])
                done.clear()
        inserts()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["ckey", "position", "role", "text"])

    common.bounded(both.sparkSession)
    return both.select("ckey", "role", "text").mapInArrow(run, "ckey string, position long, role string, text string")


def repaired(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): ckey, gaps, faults, cost and audit of every conversation that has rows; the repaired rows in order.

    Null turns come first, null roles and texts are one space, repeated rows are faults, an empty text is blank, a very long one is read whole; an empty
    table gives no conversations; other columns, whatever their names, are not read.
    """
    common.missing_columns(convs, "conv_id", "turn", "role", "text")
    rows = _ordered(convs)
    cut = common.staged(pieces(rows), "conv-pieces")
    counts = common.staged(summed(cut), "conv-counts")
    found = common.staged(audits(cut, counts, common.staged(solutions(cut), "conv-solutions")), "conv-audits")
    return counts.drop("pieces").join(found, "ckey"), replayed(rows, found)


def digests(rows: DataFrame) -> DataFrame:
    """ckey and the SHA-256 of ``role:text``, newline-joined, of conversations whose rows come in order (``replayed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        done: list[tuple[str, str]] = []
        for batch in batches:
            for ckey, role, text in zip(*(batch.column(c).to_pylist() for c in ("ckey", "role", "text")), strict=True):
                if ckey != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = ckey, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["ckey", "sha"])
                done.clear()
        if now is not None:
            done.append((now, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["ckey", "sha"])

    return rows.mapInArrow(run, "ckey string, sha string")


def repair_report(convs: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, one row for every conv_id of ``convs``."""
    told, rows = repaired(damaged(convs))
    ids = convs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_")).select("conv_id", common.key("conv_id").alias("ckey"))
    out = ids.join(told, "ckey", "left").join(digests(rows), "ckey", "left")
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
