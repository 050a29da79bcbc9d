"""Conversation repair against all edits of short conversations and plain rules of whole ones."""

import hashlib
import random
import re
from itertools import product

import pytest

from levelcast.llm import common, conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(symbols):
    """The cheapest (cost, letters, roles) of every edit of a few rows, with up to two inserts at each place."""
    best = None
    for gaps in product(range(3), repeat=len(symbols) + 1):
        for ops in product("DKR", repeat=len(symbols)):
            for roles in product("ua", repeat=sum(gaps) + ops.count("R")):
                left, out, letters, cost = list(roles), [], "", 0
                for k in range(len(symbols) + 1):
                    for _ in range(gaps[k]):
                        out.append(left.pop(0))
                        letters, cost = letters + "I", cost + 5
                    if k == len(symbols):
                        break
                    op, symbol = ops[k], symbols[k]
                    if symbol == "x" and op != "D":
                        break
                    letters, cost = letters + op, cost + {"K": 0, "R": 1, "D": 2}[op] + (5 if symbol.isupper() and op != "D" else 0)
                    if op != "D":
                        out.append(symbol.lower() if op == "K" else left.pop(0))
                else:
                    raise AssertionError
                if k == len(symbols) and re.fullmatch("(s?(ua)+)?", "".join(out)) and (best is None or (cost, letters) < best):
                    best = (cost, letters)
    return best


@pytest.mark.parametrize("length", [1, 2])
def test_every_short_signature(length):
    for symbols in product("suaoSUAOx", repeat=length):
        assert conversations.closed(conversations.solved("".join(symbols))[0]) == all_edits(symbols), symbols


def test_some_signatures_of_three():
    pick = random.Random(3)
    for _ in range(40):
        symbols = "".join(pick.choice("suaoSUAx") for _ in range(3))
        assert conversations.closed(conversations.solved(symbols)[0]) == all_edits(symbols), symbols


def forward(signature):
    """The same by one pass over the rows."""
    best = {0: (0, "")}
    for symbol in signature:
        row, now = conversations.one_row(symbol), {}
        for s, (c, a) in best.items():
            for t, (d, b) in row[s].items():
                now[t] = min(now.get(t, (1 << 60, "")), (c + d, a + b))
        best = now
    return conversations.closed(best)


def test_halves_equal_one_pass_over_the_rows():
    pick = random.Random(5)
    for n in (3, 8, 63, 64, 65, 200, 1000):
        signature = "".join(pick.choice("suaoSUAOxuauaua") for _ in range(n))
        assert conversations.closed(conversations.solved(signature)[0]) == forward(signature)


def plain(rows):
    """The report of damaged rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, signature, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(conversations.BLANKS)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "x" if kind in ("blank", "duplicate") else symbol.upper() if kind else symbol
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = forward(signature)
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        user = not out or out[-1].split(":")[0][:1] != "u"
        role = row[1] if letter == "K" else "user" if user else "assistant"
        out.append(f"{role}:{row[2] if row else ''}")
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def conversations_of(seed, many):
    """Short and long conversations with all faults, ties, nulls, odd roles and repeated rows."""
    pick = random.Random(seed)
    rows = []
    for conv in [*range(many), None]:
        for turn in range(pick.choice([1, 2, 3, 5, 8, 40])):
            text = pick.choice(["Yes.", "No", "", " \n\t", None, f"text {pick.randrange(9)}!", "long " * 50 + ".", "ü?", "\x1c"])
            row = (conv, pick.choice([turn, turn, turn, turn // 2, None]), pick.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "uma"]), text)
            rows += [row] * pick.choice([1, 1, 1, 2])
    return rows


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain(r) for c, r in by.items()}


def found(spark, rows):
    told, fixed = conversations.repaired(spark.createDataFrame(rows, SCHEMA))
    out = told.join(conversations.digests(fixed), "ckey", "left").collect()
    empty = hashlib.sha256().hexdigest()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {None if r.ckey == "" else int(r.ckey[1:]): {**{n: r[n] for n in names}, "sha": r.sha or empty} for r in out}


def test_repair_equals_plain_rules(spark):
    rows = conversations_of(1, 60)
    assert found(spark, rows) == expected(rows)


def test_pieces_add_up_and_large_tables_join_alike(spark, monkeypatch):
    rows = conversations_of(2, 30)
    monkeypatch.setattr(conversations, "PIECE", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert found(spark, rows) == expected(rows)


def test_report_has_every_conversation(spark):
    import zlib

    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    twice = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 3)
    df = spark.createDataFrame([(gone, 0, "user", "Hello."), (twice, 0, "user", "Hello."), (twice, None, "assistant", None)], SCHEMA).selectExpr("*", "1 AS ckey", "2 AS `a.b`", "3 AS at")
    out = {r.conv_id: r for r in conversations.repair_report(df).collect()}
    assert (out[gone].cost, out[gone].audit, out[gone].gaps, out[gone].repaired_sha256) == (0, "", 0, hashlib.sha256().hexdigest())
    assert out[twice].duplicate == 1 and out[twice].audit.count("D") >= 1
    assert conversations.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
