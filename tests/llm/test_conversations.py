"""Conversation repair against plain searches over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tablewright.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit int"
NEED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def cheapest(rows):
    """(cost, audit, lines) of rows (fault, role, text) by trying all edits, the least (cost, audit)."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, letter, line, rest):
            if rest:
                out.append((cost + rest[0], letter + rest[1], line + rest[2]))

        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if inserted < 3:
            add(3, "I", (NEED[state] + ":",), best(i, after, inserted + 1))
        if i < len(rows):
            fault, role, text = rows[i]
            add(4, "D", (), best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                add(3 + more, "R", (f"{NEED[state]}:{text}",), best(i + 1, after, 0))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role[:1]))
                if kept is not None:
                    add(more, "K", (f"{role}:{text}",), best(i + 1, kept, 0))
        return min(out, default=None)

    return best(0, 0, 0)


def judged(rows):
    """What repair should say about the rows (turn, role, text) of one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faulty = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faulty.append(("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "", role, text))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = cheapest(tuple(faulty))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[sum(f == k for f, _, _ in faulty) for k in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def talks(n, rng, longest=9):
    out = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            out.append((c, None if rng.random() < 0.03 else t * rng.choice([1, 1, 2]) * 10 + t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["a.", "b", " ", "", None, "c! \n", "d? ", "x" * 50 + "."])))
    return out


def unique_turns(rows):
    """Ties of turns have a defined order of their own; the search compares conversations without them."""
    seen, out = set(), []
    for r in rows:
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


def test_all_rows_of_every_conversation(spark):
    rows = unique_turns(talks(300, random.Random(1))) + [(None, 1, "user", "hello."), (None, 2, "assistant", "yes.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    for i in {r[0] for r in rows}:
        assert got[i] == judged([r[1:] for r in rows if r[0] == i]), i
    assert len(got) == len({r[0] for r in rows})


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    rows = unique_turns([(7, t, r, x + (str(t % 50) if x else "")) for t, (_, _, r, x) in enumerate((None, None, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b! ", ""])) for _ in range(3000))])
    rows = [(c, t, r, x and x + ".") for c, t, r, x in rows] + [(8, 1, "user", "q?"), (6, 1, "assistant", "a.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    found = {r.conv_id: r for r in C.repair(df).collect()}
    codes = [0]
    seen = set()
    for _, _, role, text in sorted((r for r in rows if r[0] == 7), key=lambda r: r[1]):
        codes.append((C.BLANK if not text else C.DUPLICATE if (role, text) in seen else C.CLEAN) * 4 + "sua".index(role[0]))
        seen.add((role, text))
    s = C.Solver([np.array(codes[1:])], C.AT_END[None], np.array([0]))
    s.rank()
    assert found[7].cost == s.go[0, 0] and found[7].audit.encode() == s.paths(np.array([0]), np.array([0]))[0][0]
    assert tuple(found[8])[1:] == judged([(1, "user", "q?")]) and tuple(found[6])[1:] == judged([(1, "assistant", "a.")])


def test_blocks_chain_as_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        code = rng.integers(0, 16, rng.integers(2, 40))
        whole = C.Solver([code], C.AT_END[None], np.array([0]))
        whole.rank()
        audit, _ = whole.paths(np.array([0]), np.array([0]))
        cut = int(rng.integers(1, len(code)))
        second = C.Solver([code[cut:]], C.AT_END[None], np.array([0]))
        first = C.Solver([code[:cut]], second.go[:1], np.array([], int))
        assert first.go[0, 0] == whole.go[0, 0] == (first.matrix()[0] + second.go[0]).min(1)[0]
        first.rank(), second.rank()
        a, state = first.paths(np.array([0]), np.array([0]))
        assert a[0] + second.paths(np.array([0]), state)[0][0] == audit[0]


def test_empty_table_and_ties(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 1, "user", "a."), (1, 1, "user", "a."), (1, 1, "assistant", "b."), (1, None, "user", "a.")]
    got = [C.repair(spark.createDataFrame([(*r, 1) for r in order], SCHEMA)).collect() for order in (rows, rows[::-1])]
    assert got[0] == got[1] and got[0][0].duplicate == 2


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = [r for r in unique_turns(talks(400, random.Random(4), 3))]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    after = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if lot == 1 else text.translate({ord(x): None for x in ".!?"}) if lot == 2 else text
        after[c] += [(t, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in C.op11(spark, str(tmp_path)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert any(not r for r in after.values())
    assert got == {c: judged(r) if r else empty for c, r in after.items()}


@pytest.mark.parametrize("codes, audit", [([1], b"KI"), ([2], b"IK"), ([0], b"D"), ([0, 1], b"KKI"), ([1, 2], b"KK"), ([0, 1, 2], b"KKK"), ([2, 1, 2], b"IKKK"), ([1, 1], b"KR"), ([], b"")])
def test_small_audits(codes, audit):
    s = C.Solver([np.array(codes, int)], C.AT_END[None], np.array([0]))
    s.rank()
    assert s.paths(np.array([0]), np.array([0]))[0][0] == audit
