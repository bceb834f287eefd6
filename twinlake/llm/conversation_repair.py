"""Least repairs of conversations: layers of cost, each a set of states of the grammar, packed in one word a turn.

A conversation should read `(s?(ua)+)?` by the initials of its roles. A word
holds sixteen layers of four bits: bit 4 * k + s says that the rest can be
brought to an end from state s at k above the word's base. Going one turn back
is a few masks and shifts: an edit of cost c moves what it reaches by c layers.
The least costs of the four states never differ by more than 10 (two insertions
put any state where another stands, and one deletion makes up for a system turn
that only the start can take), so sixteen layers hold them all, however long the
conversation is. The first layer with the starting state is the cost; walking
the words forward, and taking the least letter that stays on a least cost at
each step, gives the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from twinlake.llm.batches import pieces, release
from twinlake.session import partitions, ship_package, written

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, REPLY = range(4)
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: One state in all sixteen layers; all bits.
ROW, WORD = 0x1111111111111111, (1 << 64) - 1
#: The state after each initial, by state; those without are not allowed.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}}
#: The one state that a turn made for the place leads to, and its role.
MADE = {START: USER, SYSTEM: USER, REPLY: USER, USER: REPLY}
ROLES = {USER: "user", REPLY: "assistant"}
#: What a row is: a class of initial, and whether it has to go or costs more to stay.
CLASSES, MUST, CUT = "sua", 4, 8
#: Rows and characters that a piece of a conversation has at most (one row can be longer).
ROWS, CHARS = 4096, 1 << 20

STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECE = f"conv_id long, piece long, pieces long, {STATS}, roles array<string>, texts array<string>"
RUN = PIECE + ", part int, seg int, turns array<long>"


def _before(word: int, initial: int) -> int:
    """The states from which a turn with this initial leads into those of word."""
    if initial == 0:
        return (word >> SYSTEM & ROW) << START
    if initial == 1:
        x = word >> USER & ROW
        return x << START | x << SYSTEM | x << REPLY
    return (word >> REPLY & ROW) << USER if initial == 2 else 0


def _inserted(word: int) -> int:
    """word with what insertions add before a turn; two in a row are the most that pay."""
    for _ in range(2):
        word |= (_before(word, 1) | _before(word, 2)) << 4 * INSERT
    return word


#: Nothing is left: start and a reply may end, the others by insertions.
END = (_inserted(1 << START | 1 << REPLY), 0)


def layers(codes: bytes, end: tuple[int, int] = END) -> list[tuple[int, int]]:
    """(word, base) before each row and behind the last; codes: a byte a row of class, MUST and CUT."""
    word, base = end
    out = [end]
    for c in reversed(codes):
        now = word << 4 * DELETE
        if not c & MUST:
            more = 4 * UNFINISHED if c & CUT else 0
            now |= _before(word, c & 3) << more | (_before(word, 1) | _before(word, 2)) << 4 * REROLE + more
        now = _inserted(now)
        empty = ((now & -now).bit_length() - 1) // 4 if now else 0
        word, base = now >> 4 * empty & WORD, base + empty
        out.append((word, base))
    out.reverse()
    return out


def least(at: tuple[int, int], state: int) -> int | None:
    """The least cost from a state, None if there is none."""
    x = at[0] >> state & ROW
    return at[1] + ((x & -x).bit_length() - 1) // 4 if x else None


def trace(codes: bytes, words: list[tuple[int, int]], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """(audit, kept or made turns as (row or -1, state behind it or -1 for the own role), final state).

    last: the conversation ends here, so turns may be inserted behind the last row.
    """
    i, audit, turns, left = 0, [], [], least(words[0], state)
    n = len(codes)
    while i < n or (last and left):
        made = MADE[state]
        if i < n:
            c = codes[i]
            if least(words[i + 1], state) == left - DELETE:
                audit.append("D")
                i, left = i + 1, left - DELETE
                continue
        if least(words[i], made) == left - INSERT:
            audit.append("I")
            turns.append((-1, made))
            state, left = made, left - INSERT
            continue
        more = UNFINISHED if c & CUT else 0
        own = AFTER[CLASSES[c & 3]].get(state) if c & 3 < 3 else None
        if own is not None and least(words[i + 1], own) == left - more:
            audit.append("K")
            turns.append((i, -1))
            state, left = own, left - more
        else:
            audit.append("R")
            turns.append((i, made))
            state, left = made, left - REROLE - more
        i += 1
    return "".join(audit), turns, state


def _code(role: str, text: str) -> int:
    body = text.rstrip(SPACES)
    kind = CLASSES.find(role[:1]) if role else -1
    return (kind if kind >= 0 else 3) | (0 if body else MUST) | (CUT if body and body[-1] not in ".!?" else 0)


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(role.encode() + b"\0" + text.encode(), usedforsecurity=False).digest()


def _faults(roles: list[str], texts: list[str], first: set[int] | None) -> tuple[bytes, dict[str, int]]:
    """Codes of rows, and their counts by fault; first: rows with a pair not seen before, None if all of a conversation is here."""
    seen, codes = set(), bytearray()
    count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        c = _code(role, text)
        if c & MUST:
            count["blank"] += 1
        elif (k not in first) if first is not None else ((role, text) in seen):
            count["duplicate"] += 1
            c = c & 3 | MUST
        elif c & CUT:
            count["truncated"] += 1
        if first is None:
            seen.add((role, text))
        codes.append(c)
    count["illegal"] = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return bytes(codes), count


def _repaired(roles: list[str], texts: list[str], turns: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
    return [ROLES.get(s, "") if s >= 0 else roles[k] for k, s in turns], [texts[k] if k >= 0 else "" for k, _ in turns]


def _spread(turns: list[int | None]) -> int:
    some = [t for t in turns if t is not None]
    return max(some) - min(some) + 1 - len(set(some)) if some else 0


class _Rows:
    """Rows of the output, given as Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, size: int, **values) -> None:
        self.rows.append(values)
        self.size += size

    def batches(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (end or self.size > CHARS or len(self.rows) >= ROWS):
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.size = [], 0


def _schema(df: DataFrame, names: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], names).schema)


def repair(conversations: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """PIECE rows: each conversation's faults, the cost of its repair, its audit and the turns that result.

    conversations: (conv_id long, turn long, role, text), and optionally
    `dropped`: such a row names its conversation only. Null roles and texts are
    one space. Rows count in order of turn, null first; rows of one turn by role
    and text (their first 32 and 64 characters, then a digest); rows that are
    equal in all are each a turn, of which all but the first are duplicates. A
    null conv_id is a conversation like others; other columns are left out.

    Rows are dealt by ranges of that order, equal rows included, so no task holds
    a conversation for its length. What is whole inside a range and short is
    repaired as it passes. What crosses a range's edge, or is longer than `rows`
    or `chars`, is written in pieces of that size: each piece gives the least
    costs between its states at both ends, these are chained, and then every
    piece is traced on its own from each state it can be entered in. pieces is
    how many a conversation has, piece its number; faults, cost and gaps are of
    the whole and stand in the first piece (null in the others), audits and
    turns are to be concatenated. Every conv_id has a row; an empty table none.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    gone = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), gone.alias("dropped"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    whole = F.md5(F.concat("role", F.lit("\0"), "text"))
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64), whole]
    # equal rows may lie in several ranges
    dealt = t.withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), *order, "place").sortWithinPartitions(*order).drop("place")
    kind = _schema(conversations, RUN)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, out = TaskContext.get().partitionId(), 0, _Rows(kind)
        here, at_edge, cut = None, True, False
        roles, texts, turns, size = [], [], [], 0

        def flush(conv: int | None, edge: bool) -> None:
            nonlocal roles, texts, turns, size, seg
            if edge:
                out.add(size, conv_id=conv, part=part, seg=seg, roles=roles, texts=texts, turns=turns)
                seg += 1
            else:
                codes, count = _faults(roles, texts, None)
                words = layers(codes)
                audit, made, _ = trace(codes, words, START, True)
                r, x = _repaired(roles, texts, made)
                out.add(size, conv_id=conv, piece=0, pieces=1, gaps=_spread(turns), **count, cost=least(words[0], START), audit=audit, roles=r, texts=x)
            roles, texts, turns, size = [], [], [], 0

        started = False
        for b in pieces(batches, "text"):
            for conv, turn, dropped, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if started and conv != here:
                    flush(here, at_edge or cut)
                    at_edge = cut = False
                    yield from out.batches()
                here, started = conv, True
                if dropped:
                    continue
                if roles and (len(roles) >= rows or size + len(text) > chars):
                    flush(here, True)
                    cut = True
                    yield from out.batches()
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                size += len(role) + len(text)
        if started:
            flush(here, True)
        yield from out.batches(True)
        release()

    made = written(dealt.mapInArrow(runs, RUN), "repair-runs")
    names = [c.split()[0] for c in PIECE.split(", ")]
    alone = made.where("part is null").select(*names)
    return alone.unionByName(_chained(made.where("part is not null")).select(*names))


def _chained(segments: DataFrame) -> DataFrame:
    """PIECE rows of conversations that lie in segments (conv_id, part, seg, roles, texts, turns)."""
    spark = segments.sparkSession
    pair = F.arrays_zip("roles", "texts")
    # the first place of each role and text of a conversation, by the place of its segment
    each = segments.select("conv_id", "part", "seg", F.posexplode(F.transform(pair, lambda p: F.md5(F.concat(p["roles"], F.lit("\0"), p["texts"])))).alias("k", "d"))
    first = each.groupBy("conv_id", "d").agg(F.min(F.struct("part", "seg", "k")).alias("f")).select("f.*")
    first = first.groupBy("part", "seg").agg(F.collect_list("k").alias("firsts"))  # at most the rows of a segment
    coded = segments.join(first, ["part", "seg"], "left")
    faults = "conv_id long, part int, seg int, codes binary, moves array<long>, blank long, duplicate long, truncated long, illegal long, "
    faults += "n long, left string, right string, low long, high long, distinct long"
    kind = _schema(segments, faults)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(kind)
        for b in batches:
            for r in b.to_pylist():
                codes, count = _faults(r["roles"], r["texts"], set(r["firsts"] or ()))
                moves = []
                for q in range(4):
                    start = layers(codes, (1 << q, 0))[0]
                    moves += [least(start, s) for s in range(4)]
                some = [t for t in r["turns"] if t is not None]
                ends = {"low": min(some), "high": max(some)} if some else {}
                sides = {"left": r["roles"][0][:1], "right": r["roles"][-1][:1]} if r["roles"] else {}
                out.add(
                    len(codes), conv_id=r["conv_id"], part=r["part"], seg=r["seg"], codes=codes, moves=moves, **count,
                    n=len(codes), **sides, distinct=len(set(some)), **ends,
                )
            yield from out.batches()
        yield from out.batches(True)

    coded = written(coded.mapInArrow(code, faults), "repair-coded")
    row = [c for c in coded.columns if c not in ("conv_id", "codes")]
    chains = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seg", *(c for c in row if c not in ("part", "seg"))))).alias("s"))
    ends = f"conv_id long, part int, seg int, piece long, pieces long, last boolean, outs array<long>, {STATS}"
    end_kind = _schema(segments, ends)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each segment's end costs from each state, and the counts of the whole."""
        out = _Rows(end_kind)
        for b in batches:
            for conv, chain in zip(b.column("conv_id").to_pylist(), b.column("s").to_pylist(), strict=True):
                total = {k: sum(s[k] for s in chain) for k in ("blank", "duplicate", "truncated", "illegal")}
                full = [s for s in chain if s["n"]]
                total["illegal"] += sum(a["right"] + b["left"] not in ("su", "ua", "au") for a, b in zip(full, full[1:], strict=False))
                dated = [s for s in chain if s["low"] is not None]
                shared = sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
                distinct = sum(s["distinct"] for s in dated) - shared
                total["gaps"] = dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0
                costs = [least(END, s) for s in range(4)]
                rows = []
                for k in range(len(chain) - 1, -1, -1):
                    rows.append((k, costs))
                    m = chain[k]["moves"]
                    costs = [min((m[4 * q + s] + costs[q] for q in range(4) if m[4 * q + s] is not None and costs[q] is not None), default=None) for s in range(4)]
                for k, outs in reversed(rows):
                    of = {"conv_id": conv, "part": chain[k]["part"], "seg": chain[k]["seg"], "piece": k, "pieces": len(chain), "last": k == len(chain) - 1, "outs": outs}
                    out.add(100, **of, **(total | {"cost": costs[START]} if k == 0 else {}))
                yield from out.batches()
        yield from out.batches(True)

    exits = written(chains.mapInArrow(back, ends), "repair-ends")
    steps = "conv_id long, part int, seg int, piece long, nexts array<int>"
    step_kind = _schema(segments, steps)

    def end_of(outs: list[int | None]) -> tuple[int, int]:
        base = min(c for c in outs if c is not None)
        return sum(1 << 4 * (c - base) + s for s, c in enumerate(outs) if c is not None and c - base < 16), base

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the least audit leaves a segment, by the state it was entered in."""
        out = _Rows(step_kind)
        for b in batches:
            for r in b.to_pylist():
                words = layers(r["codes"], end_of(r["outs"]))
                nexts = [trace(r["codes"], words, s, False)[2] if least(words[0], s) is not None else -1 for s in range(4)]
                out.add(100, conv_id=r["conv_id"], part=r["part"], seg=r["seg"], piece=r["piece"], nexts=nexts)
            yield from out.batches()
        yield from out.batches(True)

    ready = coded.select("part", "seg", "codes").join(exits.drop("conv_id"), ["part", "seg"])
    moved = coded.select("part", "seg", "codes", "conv_id").join(exits.select("part", "seg", "outs", "piece"), ["part", "seg"]).mapInArrow(step, steps)
    chains = moved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "part", "seg", "nexts"))).alias("s"))
    entered = F.aggregate(
        "s",
        F.struct(F.lit(START).alias("now"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct(F.element_at(x["nexts"], a["now"] + 1).alias("now"), F.concat(a["all"], F.array(a["now"])).alias("all")),
    )["all"]
    entries = chains.select(F.explode(F.arrays_zip("s", entered.alias("state"))).alias("e")).select("e.s.part", "e.s.seg", "e.state")
    full = segments.select("conv_id", "part", "seg", "roles", "texts").join(ready, ["part", "seg"]).join(entries, ["part", "seg"])
    piece_kind = _schema(segments, PIECE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, plain = _Rows(piece_kind), [f.name for f in piece_kind if f.name not in ("audit", "roles", "texts")]
        for b in batches:
            for r in b.to_pylist():
                words = layers(r["codes"], END if r["last"] else end_of(r["outs"]))
                audit, made, _ = trace(r["codes"], words, r["state"], r["last"])
                roles, texts = _repaired(r["roles"], r["texts"], made)
                out.add(sum(map(len, texts)), **{c: r[c] for c in plain}, audit=audit, roles=roles, texts=texts)
                yield from out.batches()
        yield from out.batches(True)
        release()

    return full.mapInArrow(finish, PIECE)


def summaries(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row a conversation from PIECE rows.

    Pieces of one conversation pass one task in order and are hashed as they pass.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, x: F.concat(r, F.lit(":"), x)), "\n")
    columns = [c.split()[0] for c in STATS.split(", ")]
    alone = repaired.where("pieces = 1").select("conv_id", *columns, F.sha2(lines, 256).alias("repaired_sha256"))
    rest = repaired.where("pieces > 1").select("conv_id", *columns, "piece", F.size("roles").alias("n"), lines.alias("lines"))
    kind = _schema(repaired, f"conv_id long, {STATS}, repaired_sha256 string")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row, audit, digest, some = _Rows(kind), None, [], hashlib.sha256(), False
        for b in pieces(batches, "lines"):
            for r in b.to_pylist():
                if r["piece"] == 0:
                    if row is not None:
                        out.add(1, **(row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}))
                    row = {f.name: r.get(f.name) for f in kind}
                    audit, digest, some = [], hashlib.sha256(), False
                audit.append(r["audit"])
                if r["n"]:
                    digest.update((b"\n" if some else b"") + r["lines"].encode())
                    some = True
            yield from out.batches()
        if row is not None:
            out.add(1, **(row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}))
        yield from out.batches(True)

    dealt = rest.repartition(partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return alone.unionByName(dealt.mapInArrow(joined, f"conv_id long, {STATS}, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): conversations with faults set by crc32 of `conv_id:turn`, nulls being one space.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    blank: Column = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("hit")
    )
    hit = F.col("hit")
    role = F.when(hit == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.select("conv_id", "turn", role, text, (hit == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and least repair of every conversation after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return summaries(repair(damage(rows)))
