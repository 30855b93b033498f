"""Conversation repair against a plain search over all edits, whole and in small chunks."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from scanfuse.llm import repair
from scanfuse.llm.common import table

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        role, text = one(role), one(text)
        code = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain(rows):
    """One conversation's rows (turn, role, text) in any order: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(BLANKS)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(k, state, inserts):
        """(cost, letters, roles put out) from row k on; at most two inserts in a row are ever of use."""
        ways = []
        if inserts < 2:
            c, a = best(k, NEXT[state], inserts + 1)
            ways.append((c + 5, "I" + a))
        if k == len(rows):
            return min([(0, "")] * (state in ("", "a")) + ways) if state in ("", "a") or ways else (10**9, "~")
        role, cut = rows[k][1][:1], 5 * (faults[k] == "truncated")
        c, a = best(k + 1, state, 0)
        ways.append((c + 2, "D" + a))
        if faults[k] not in ("blank", "duplicate"):
            if role == "s" and state == "" or role == "u" and state != "u" or role == "a" and state == "u":
                c, a = best(k + 1, role, 0)
                ways.append((c + cut, "K" + a))
            c, a = best(k + 1, NEXT[state], 0)
            ways.append((c + cut + 1, "R" + a))
        return min(ways)

    cost, audit = best(0, "", 0)
    out, state, k = [], "", 0
    for letter in audit:
        if letter == "K":
            state = rows[k][1][:1]
            out.append(f"{rows[k][1]}:{rows[k][2]}")
        elif letter in "RI":
            state = NEXT[state]
            out.append({"u": "user:", "a": "assistant:"}[state] + (rows[k][2] if letter == "R" else ""))
        k += letter != "I"
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows, spoil=True):
    by = {r[0]: [] for r in rows}
    for r in damage(rows) if spoil else [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]:
        by[r[0]].append(r[1:])
    return {conv: plain(x) for conv, x in by.items()}


def collected(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got, want = collected(repair.op12_repair(spark, SF)), expected(rows)
    assert got == want
    assert any("D" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


def made(seed, convs, longest):
    rng = random.Random(seed)
    words = ["yes.", "no", "why?", "", " \t", "go on!", "and then", "ok.", None]
    return [(c if c else None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_chunks_of_any_size_agree(spark, bits):
    rows = made(bits, 12, 14) + [(77, 3, "user", "same.")] * 30 + [(78, t, "assistant" if t % 3 else "user", f"turn {t}{'.' if t % 4 else ''}") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(repair.repair_conversations(df, bits)) == expected(rows, spoil=False)


def test_damage_and_clashing_columns(spark):
    rows = made(9, 40, 6)
    df = spark.createDataFrame([(*r, k, "x", True) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, row long, at string, state boolean")
    assert collected(repair.repair(repair._numbered(repair.damaged(df)), df)) == expected(rows)
    assert repair.repair_conversations(df.limit(0)).collect() == []


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, turn, "user", "hello.")], "conv_id long, turn long, role string, text string")
    got = collected(repair.repair(repair._numbered(repair.damaged(df)), df))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_long_text_and_long_conversation(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "fine.")] + [(2, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(6000)]
    got = collected(repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 8))
    assert got[1][5:7] == (0, "KK") and got[2][5:7] == (0, "K" * 6000)
    assert got[2][7] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[2:]).encode()).hexdigest()
