import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from cases import rows

from waymark.llm import catalog, repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, fault string, part int, cost double"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, given):
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in given], SCHEMA)


def spoil(given):
    out = []
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(turns):
    """All edit sequences from each row on, compared as (cost, audit)."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        solid = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, before, inserts):  # before: initial of the row that stands before; inserts: of those made in a row
        ways = [(0, "", ())] if i == len(turns) and before in ("", "a") else []
        for name in ("user", "assistant"):
            if inserts < 3 and step(before, name[0]):
                cost, audit, lines = best(i, name[0], inserts + 1)
                ways.append((cost + 2, "I" + audit, (name + ":", *lines)))
        if i == len(turns):
            return min(ways, default=(10**9, "", ()))
        _, role, text = turns[i]
        cost, audit, lines = best(i + 1, before, 0)
        ways.append((cost + 3, "D" + audit, lines))
        if faults[i] not in ("blank", "duplicate"):
            for letter, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if step(before, name[:1]):
                    cost, audit, lines = best(i + 1, name[0], 0)
                    ways.append((cost + price + (faults[i] == "truncated"), letter + audit, (name + ":" + text, *lines)))
        return min(ways)

    def step(before, initial):
        return bool(initial) and before + initial in ("s", "u", "su", "ua", "au")

    cost, audit, lines = best(0, "", 0)
    numbers = [t for t, *_ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(given):
    by = {}
    for conv, *turn in given:
        by.setdefault(conv, []).append(tuple(turn))
    return sorted(((conv, *brute(turns)) for conv, turns in by.items()), key=str)


def answer(df):
    assert df.columns == COLUMNS
    return sorted(rows(df), key=str)


def talk(r, conv, n):
    texts = ["Yes.", "no", "Why?  ", " ", "", "ok!", "é…", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " "]
    return [(conv, r.choice([None, r.randint(-2, 2 * n), i]) if r.random() < 0.2 else i, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"line {i}.") for i in range(n)]


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_equals_all_edits(spark, monkeypatch, block):
    r = random.Random(block)
    given = [row for conv in range(60) for row in talk(r, conv, r.randint(1, 9))] + talk(r, None, 7) + talk(r, 99, 60)
    given += [(100, 3, "user", "same.")] * 9 + [(101, None, "assistant", " ")] * 3
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    assert answer(repair.repair(table(spark, given))) == expected(given)


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    r = random.Random(8)
    given = [row for conv in range(150) for row in talk(r, conv, r.randint(1, 6))] + [(None, 1, None, None), (None, None, "user", "a.")]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given.append((lost, 0, "user", "gone."))
    table(spark, given).write.parquet(f"{tmp_path}/conversations.parquet")
    got = answer(catalog.QUERIES["op13_conversation_repair"](spark, str(tmp_path)))
    want = {conv: row for conv, *row in expected(spoil(given))}
    empty = [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert got == sorted(((conv, *want.get(conv, empty)) for conv in {g[0] for g in given}), key=str)
    assert lost not in want


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(1)
    given = talk(r, 7, 700) + talk(r, 8, 3)
    pieces = repair._pieces(repair.faults(table(spark, given)))
    assert pieces.where("conv_id = 7").select("part").distinct().count() > 1
    monkey = answer(repair.repair(table(spark, given)))
    assert [x[0] for x in monkey] == [7, 8]
    whole = repair.BLOCK_ROWS
    repair.BLOCK_ROWS = 31
    try:
        assert answer(repair.repair(table(spark, given))) == monkey
    finally:
        repair.BLOCK_ROWS = whole


def test_slots_compare_as_their_letters():
    slots = ["D", "K", "R", "ID", "IK", "IR", "IID", "IIK", "IIR"]
    joined = [(a + b, repair._digits(a) << repair._SLOT | repair._digits(b)) for a in slots for b in slots]
    assert [x for x, _ in sorted(joined)] == [x for x, _ in sorted(joined, key=lambda x: x[1])]
    assert all("".join(repair._letters(d, 2)) == x for x, d in joined)


def test_long_text_and_empty_table(spark):
    given = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "x" * 3_000_000 + "!"), (1, 2, "assistant", "y" * 3_000_000)]
    assert answer(repair.repair(table(spark, given))) == expected(given)
    assert answer(repair.repair(table(spark, []))) == []
    assert rows(repair.damage(table(spark, []))) == []
