"""op11: edits against all edits of small conversations, odd rows, and a conversation of many rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from docketry.llm import op11_repair as op

ROW = "conv_id long, turn long, role string, text string"


def brute(kinds):
    """The cheapest edits of (letter, fault) rows, by trying every string of edits up to two insertions at a place."""
    best = None

    def go(k, roles, cost, letters):
        nonlocal best
        # whatever the rest, a longer or dearer string than the best known one is of no use
        if best and cost > best[0]:
            return
        if k == len(kinds):
            for tail in ("", "u", "a", "ua"):
                if re.fullmatch("(s?(ua)+)?", roles + tail):
                    found = (cost + 3 * len(tail), letters + "I" * len(tail))
                    best = min(best, found) if best else found
            return
        letter, fault = kinds[k]
        for put in ("", "u", "a", "ua", "au"):
            now, paid, said = roles + put, cost + 3 * len(put), letters + "I" * len(put)
            go(k + 1, now, paid + 4, said + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(k + 1, now + (letter or "x"), paid + more, said + "K")
                for x in "ua":
                    go(k + 1, now + x, paid + 3 + more, said + "R")

    go(0, "", 0, "")
    return best


def test_every_short_conversation():
    kinds = [(letter, fault) for letter in ("s", "u", "a", "") for fault in ("", "blank", "truncated")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert op.cheapest(list(rows)) == brute(rows), rows


def test_longer_conversations():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suuaaa") if rng.random() < 0.9 else "", rng.choice(["", "", "", "truncated", "duplicate"])) for _ in range(rng.randint(3, 5))]
        assert op.cheapest(rows) == brute(rows), rows


def plain(rows):
    """What the operator says of one conversation's (turn, role, text) rows, in plain Python; -> values by column."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 4:
            role = "user"
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text)] * (0 if d == 0 else 2 if d == 3 else 1)
    kept.sort()
    seen, kinds, faults = set(), [], []
    for _, _, role, _, text in kept:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
        kinds.append((role[:1] if role[:1] in tuple("sua") else "", faults[-1]))
    cost, audit = op.cheapest(kinds)
    turns = {t for there, t, *_ in kept if there}
    at, lines = iter(kept), []
    odd = (len(audit) - audit.count("D")) % 2
    for e in audit:
        row = next(at) if e != "I" else None
        if e != "D":
            wanted = ("user", "assistant")[(len(lines) - odd) % 2]
            lines.append(f"{row[2] if e == 'K' else wanted}:{row[4] if row else ''}")
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"), "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def check(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *("other" for _ in extra)) for r in rows], ROW + "".join(f", {c} string" for c in extra)).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in op.repair(op.damaged(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == {"conv_id": conv} | plain([r for r in rows if r[0] == conv]), conv


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "assistant", None), (1, None, "user", "Ok!"), (1, 7, "tool", "x"),
        (2, 0, "", ""), (2, 1, "User", "no end"), (3, 5, "assistant", "a? \n\t"), (4, -2, "system", "é. "), (4, 9, "user", "𝄞!"), (5, 1, "user", "twice."), (5, 1, "user", "twice."),
    ]
    # ids whose only row is dropped
    gone = [k for k in range(100, 400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    check(spark, rows + [(k, 0, "user", "x.") for k in gone[:3]], extra=("copy", "gone", "d", "digest", "audit"))


def test_random_conversations_and_a_hot_one(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Long. " * 200, None]
    rows = [(rng.randint(0, 40), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(texts)) for _ in range(400)]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    check(spark, rows)


def test_long_text_and_no_rows(spark):
    check(spark, [(1, 1, "user", "word " * 400_000 + "."), (1, 2, "assistant", " " * 300_000 + "x")])
    assert op.repair(op.damaged(spark.createDataFrame([], ROW))).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([(7, 1, "assistant", "A."), (7, 2, "user", "B."), (7, 3, "user", "C.")], ROW)
    rows = op.damaged(df).selectExpr("conv_id", "turn", "role", "text", "0 copy", "false gone")
    found = op.audits(rows)
    turns = [tuple(r)[1:] for r in op.repaired(rows, found).collect()]
    assert [r[2] for r in turns] == ["user", "assistant"] * (len(turns) // 2)
    assert [r[0] for r in turns] == list(range(len(turns)))


@pytest.mark.parametrize("n", [1, 50_000])
def test_steps_are_looked_up(n):
    kinds = [("u", ""), ("a", "truncated"), ("a", "")] * n
    cost, audit = op.cheapest(kinds)
    assert len(audit.replace("I", "")) == 3 * n and cost >= 3 * n
    assert op._walk.cache_info().currsize < 5000
