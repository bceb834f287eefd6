"""Conversation repair against a search over all edits in plain Python, whole and in pieces."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from twinlake.llm import conversation_repair as R

SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows):
    """The contract's columns of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, audit, turns) from row i on, by trying every edit."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        role, text, fault = (rows[i][2], rows[i][3], faults[i]) if i < len(rows) else ("", "", "blank")

        def add(cost, letter, j, initial, line, left):
            after = GRAMMAR.get((state, initial)) if initial is not None else state
            rest = best(j, after, left) if after is not None else None
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if i < len(rows):
            add(2, "D", i + 1, None, None, inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                add(more, "K", i + 1, role[:1], f"{role}:{text}", inserts)
                for r in ("user", "assistant"):
                    add(1 + more, "R", i + 1, r[0], f"{r}:{text}", inserts)
        if inserts:
            for r in ("user", "assistant"):
                add(5, "I", i, r[0], f"{r}:", inserts - 1)
        return min(found, default=None)

    cost, audit, lines = best(0, "", 5)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "Why?", "cut", " \t\n", "", None, "Long one.\x0b ", "é…", "Same."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t}.") for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "a."), (None, 1, "assistant", "b."), (None, 1, "assistant", "b."), (900, 5, None, None), (901, None, "user", "x" * 50_000 + ".")]
    rows += [(902, t, "ua"[t % 2] + "x", f"{t % 7} {t // 11}.") for t in range(40)] + [(903, 7, "user", "Again.")] * 30
    alone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(alone, 0, "user", "All of it is dropped.")]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("rows", [R.ROWS, 3])
def test_repair_is_the_brute_forces(spark, rows):
    given = table()
    df = spark.createDataFrame([(*r, 1.0, "x") for r in given], "conv_id long, turn long, role string, text string, cost double, piece string")
    out = R.summaries(R.repair(R.damage(df.repartition(3)), rows=rows)).collect()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in out}
    assert len(out) == len(got)
    after = {r[0]: [] for r in given}
    for r in damaged(given):
        after[r[0]].append(r)
    assert got == {conv: brute(some) for conv, some in after.items()}


def test_repaired_turns_and_their_audit(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "cut")], "conv_id long, turn long, role string, text string")
    rows = R.repair(df).orderBy("piece").collect()
    assert [r.cost for r in rows] == [3] + [None] * (rows[0].pieces - 1)
    assert "".join(r.audit for r in rows) == "KRD"
    assert [x for r in rows for x in zip(r.roles, r.texts)] == [("user", "Hi."), ("assistant", "Hello.")]


def test_long_conversation_has_the_cost_of_its_parts(spark):
    """20,000 turns, most of them equal: no step grows with the square."""
    kinds = [("user", "Q."), ("assistant", "A."), ("user", "")]
    rows = [(7, t, *kinds[t % 3]) for t in range(20_000)]
    out = R.summaries(R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8))).first()
    assert (out.blank, out.duplicate) == (6666, 13_332)
    assert (out.cost, len(out.audit)) == (2 * (20_000 - 2), 20_000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.summaries(R.repair(R.damage(df))).columns == ["conv_id", *COLUMNS]
    assert R.summaries(R.repair(R.damage(df))).count() == 0
