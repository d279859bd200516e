"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, as integer shortest paths.

A path's weight is one big integer: its high digits are the cost, and below them every row has a slot of three letters for the edits
before and at it, padded with zeros at the end. A slot's letters end with the row's own edit, so no slot begins another,
and comparing weights compares cost first and then the letters as text. Weights add up, whatever rows lie between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import cut

BLANKS, ENDS = r"[\x20\x09-\x0D]", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 22  # distinct rows, and bytes of them, that are solved at a time

LETTERS = "\0DIKR"  # digits 0 to 4, in the order of ASCII
_BITS, _WIDTH = 3, 3  # bits of a digit, digits of a slot
_SLOT = _BITS * _WIDTH

# What stands before a row: nothing, a system row, a user row, an assistant row. A conversation ends after nothing or an assistant.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTED = (_EMPTY, _ASSISTANT)
_STEPS = {("s", _EMPTY): _SYSTEM, ("u", _EMPTY): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}
_NEXT = {_EMPTY: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}  # role of an inserted or reroled row
_NAMES = {"u": "user", "a": "assistant"}


def _digits(letters: str) -> int:
    value = 0
    for k in range(_WIDTH):
        value = value << _BITS | (LETTERS.index(letters[k]) if k < len(letters) else 0)
    return value


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after none, one or two inserts: more only lead back."""
    once = _STEPS[_NEXT[state], state]
    twice = _STEPS[_NEXT[once], once]
    return [(state, 0, ""), (once, INSERT, "I"), (twice, 2 * INSERT, "II")]


def _edges() -> dict[tuple[str, bool], list[list[tuple[int, int, int]]]]:
    """For a row's role initial and whether it is truncated: per state the (state, cost, slot) it can lead to."""
    found = {}
    for initial in ("s", "u", "a", ""):
        for truncated in (False, True):
            table = []
            for state in range(4):
                best: dict[int, tuple[int, int]] = {}
                for at, cost, letters in _inserted(state):
                    ways = [(at, DELETE, "D"), (_STEPS[_NEXT[at], at], REROLE + TRUNCATED * truncated, "R")]
                    if (initial, at) in _STEPS:
                        ways.append((_STEPS[initial, at], KEEP + TRUNCATED * truncated, "K"))
                    for to, more, letter in ways:
                        way = (cost + more, _digits(letters + letter))
                        best[to] = min(best.get(to, way), way)
                table.append([(to, cost, slot) for to, (cost, slot) in best.items()])
            found[initial, truncated] = table
    return found


_EDGES = _edges()
#: Per state the weight of what is inserted after the last row, where the end is then accepted.
_END = [min((cost << _SLOT | _digits(letters) for to, cost, letters in _inserted(s) if to in _ACCEPTED)) for s in range(4)]


def _solve(rows: list[tuple[str, bool]], after: list[int | None], low: int) -> list[int | None]:
    """Least weight from each state through the rows (initial, truncated) on, given the weights ``after`` them, which hold
    their cost above bit ``low``. The result holds it above bit ``low + _SLOT * len(rows)``."""
    high, place = low + _SLOT * len(rows), low
    below = (1 << low) - 1
    now = [None if w is None else (w >> low) << high | w & below for w in after]
    for row in reversed(rows):
        now = [min((now[to] + (cost << high) + (slot << place) for to, cost, slot in ways if now[to] is not None), default=None) for ways in _EDGES[row]]
        place += _SLOT
    return now


def _letters(digits: int, slots: int) -> list[str]:
    """The letters of each slot."""
    return ["".join(LETTERS[digits >> _SLOT * k + _BITS * j & 7] for j in reversed(range(_WIDTH))).replace("\0", "") for k in reversed(range(slots))]


class _Tally:
    """Counts over a conversation's rows as they come in order, one after the other."""

    def __init__(self):
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_initial = self.last_initial = self.low = self.high = None

    def add(self, turn, initial: str, n: int, forced: int, fault: str) -> None:
        if self.n == 0:
            self.first_initial = initial
        elif self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial, self.n = initial, self.n + n
        self.illegal += n - 1
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if fault == "blank":
            self.blank += n
            return
        self.duplicate += forced
        self.truncated += fault == "truncated"

    def join(self, other: dict) -> None:
        """Go on with the counts of the block behind."""
        if self.n == 0:
            self.first_initial = other["first_initial"]
        elif self.last_initial + other["first_initial"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = other["last_initial"]
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["low"] is not None:
            self.turns += other["turns"] - (other["low"] == self.high)
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high - self.low + 1 - self.turns)


class _Writer:
    """Audit and checksum of a conversation as its rows and their edits come."""

    def __init__(self):
        self.audit, self.state, self.sum, self.any = [], _EMPTY, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.sum.update(("\n" * self.any + role + ":" + text).encode())
        self.any = True

    def insert(self, letters: str) -> None:
        for _ in range(letters.count("I")):
            initial = _NEXT[self.state]
            self._line(_NAMES[initial], "")
            self.state = _STEPS[initial, self.state]
        self.audit.append(letters)

    def row(self, letters: str, role: str, text: str) -> None:
        self.insert(letters)
        if letters[-1] == "D":
            return
        initial = role[:1] if letters[-1] == "K" else _NEXT[self.state]
        self._line(role if letters[-1] == "K" else _NAMES[initial], text)
        self.state = _STEPS[initial, self.state]


_TALLY = "n long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, low {turn}, high {turn}"
_WAYS = "array<struct<source:int,target:int,cost:long,digits:binary>>"


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, forced, fault): distinct rows with their number of copies and first fault.

    Blank: no character but ``[\\x20\\x09-\\x0D]``. Duplicate: role and text seen earlier in the conversation. Truncated: the last
    character that is not blank is none of ``.!?``. ``forced`` copies must be deleted: all of a blank or duplicate row, and
    all but the first of any other. Copies of a row lie next to each other in the order of turn, so they are one row here.
    """
    space = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    distinct = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    same = ["conv_id", "role", "h1", "h2"]
    marked = distinct.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    # only rows that return at another turn; the others need no partner
    firsts = marked.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select(*[F.col(c).alias(f"f_{c}") for c in same], "first")
    found = marked.join(firsts, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in same], "left")
    last = F.right(F.regexp_replace("text", f"{BLANKS}+\\z", ""), F.lit(1))
    fault = (
        F.when(last == "", "blank").when(F.col("first").isNotNull() & (F.struct("turn") > F.col("first")), "duplicate")
        .when(~last.isin(*ENDS), "truncated").otherwise("")
    )
    forced = F.when(F.col("fault").isin("blank", "duplicate"), F.col("n")).otherwise(F.col("n") - 1)
    return found.withColumn("fault", fault).withColumn("forced", forced).select("conv_id", "turn", "role", "text", "n", "forced", "fault")


def _pieces(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive rows. A conversation that lies in one block is done; a longer one, or one that a border cuts,
    gets per block the least weights between any two states, in the order of (part, seq)."""
    spark = rows.sparkSession
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    row = "struct<role:string,text:string,n:bigint,forced:bigint,free:boolean,truncated:boolean>"
    tally = _TALLY.format(turn=kinds["turn"])
    schema = f"conv_id {kinds['conv_id']}, part int, seq long, done boolean, {tally}, cost long, audit string, sha string, ways {_WAYS}, rows array<{row}>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, []
        target = None  # the Arrow schema comes with the first batch's key types
        held, size, at, start, begun = [], 0, None, True, False  # rows of the block; start: first of the partition; begun: a block of at was given out

        def block(closed: bool) -> dict:
            nonlocal seq
            tally = _Tally()
            for turn, role, _, n, forced, fault in held:
                tally.add(turn, role[:1], n, forced, fault)
            seq += 1
            found = {"conv_id": at, "part": part, "seq": seq, "done": closed, "cost": None, "audit": None, "sha": None, "ways": None, "rows": None}
            found |= {c: getattr(tally, c) for c in ("n", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "low", "high")}
            free = [(r[1][:1] if r[1][:1] in "sua" else "", r[5] == "truncated") for r in held if r[3] > r[4]]
            forced = sum(r[4] for r in held)
            made = [{"role": r[1], "text": r[2], "n": r[3], "forced": r[4], "free": r[3] > r[4], "truncated": r[5] == "truncated"} for r in held]
            if closed:
                weight = _solve(free, _END, _SLOT)[_EMPTY]
                bits = _SLOT * (len(free) + 1)
                writer = _Writer()
                _write(writer, made, _letters(weight & (1 << bits) - 1, len(free) + 1))
                return found | {"cost": (weight >> bits) + DELETE * forced, "audit": "".join(writer.audit), "sha": writer.sum.hexdigest()}
            bits, ways = _SLOT * len(free), []
            for to in range(4):
                for source, weight in enumerate(_solve(free, [0 if s == to else None for s in range(4)], 0)):
                    if weight is not None:
                        ways.append({"source": source, "target": to, "cost": (weight >> bits) + DELETE * forced, "digits": (weight & (1 << bits) - 1).to_bytes(bits // 8 + 1)})
            return found | {"ways": ways, "rows": made}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=target)

        for batch in batches:
            if target is None:
                target = _piece_schema(batch.schema)
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "forced", "fault")]
            for conv, *values in zip(*columns, strict=True):
                if held and conv != at:
                    out.append(block(not start and not begun))
                    held, size, start, begun = [], 0, False, False
                elif held and (len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    out.append(block(False))
                    held, size, begun = [], 0, True
                at = conv
                held.append(values)
                size += len(values[2])
                if len(out) >= 256 or (out and size >= BLOCK_BYTES):
                    yield batch_of(out)
                    out = []
        if held:
            out.append(block(False))  # it may go on in the next partition
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(solve, schema)


def _write(writer: _Writer, rows: list[dict], letters: list[str]) -> None:
    """Rows with the slots of those that are free. Forced deletions come before what is inserted for the next free row."""
    slots = iter(letters)
    for row in rows:
        if row["free"]:
            writer.row(next(slots), row["role"], row["text"])
        writer.audit.append("D" * row["forced"])
    for rest in slots:
        writer.insert(rest)


def _piece_schema(given: pa.Schema) -> pa.Schema:
    number, word = pa.int64(), pa.string()
    row = pa.struct([("role", word), ("text", word), ("n", number), ("forced", number), ("free", pa.bool_()), ("truncated", pa.bool_())])
    way = pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", number), ("digits", pa.binary())])
    turn = given.field("turn").type
    counts = [(c, number) for c in ("n", "turns", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([
        ("conv_id", given.field("conv_id").type), ("part", pa.int32()), ("seq", number), ("done", pa.bool_()), *counts, ("first_initial", word), ("last_initial", word),
        ("low", turn), ("high", turn), ("cost", number), ("audit", word), ("sha", word), ("ways", pa.list_(way)), ("rows", pa.list_(row)),
    ])


def _choices(blocks: DataFrame) -> DataFrame:
    """(part, seq, choice): per state before a block, its way (an index of ``ways``) on a cheapest path to the conversation's end.

    Blocks come last first. What lies behind a block enters its decision as four costs and the order of the four texts of letters, which
    is all that a comparison needs, so a task holds one block however long the conversation is.
    """
    ordered = spread_by_conversation(blocks.select("conv_id", "part", "seq", "ways")).sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, behind, first = None, None, True
        for batch in batches:
            out = {"part": [], "seq": [], "choice": []}
            for conv, part, seq, ways in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "ways")], strict=True):
                if first or conv != at:
                    # the inserts at the end: cost, and the letters' order
                    order = sorted({w & (1 << _SLOT) - 1 for w in _END})
                    at, first, behind = conv, False, [(w >> _SLOT, order.index(w & (1 << _SLOT) - 1)) for w in _END]
                choice, weights = [], []
                bits = 8 * max(len(w["digits"]) for w in ways) + 2  # two lowest bits: order of what lies behind
                for state in range(4):
                    best = None
                    for i, way in enumerate(ways):
                        if way["source"] == state:
                            cost, rank = behind[way["target"]]
                            weight = (way["cost"] + cost) << bits | int.from_bytes(way["digits"]) << 2 | rank
                            if best is None or weight < best[0]:
                                best = (weight, i)
                    weights.append(best[0])
                    choice.append(best[1])
                order = sorted({w & (1 << bits) - 1 for w in weights})
                behind = [(w >> bits, order.index(w & (1 << bits) - 1)) for w in weights]
                for name, value in (("part", part), ("seq", seq), ("choice", choice)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("choice", pa.list_(pa.int32()))]))

    return ordered.mapInArrow(choose, "part int, seq long, choice array<int>")


def spread_by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _follow(blocks: DataFrame) -> DataFrame:
    """The result of every conversation from its blocks in order, with their choices."""
    ordered = spread_by_conversation(blocks).sortWithinPartitions("conv_id", "part", "seq")
    kind = dict(blocks.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tally = writer = None
        cost = 0

        def result() -> dict:
            tail = _letters(_END[writer.state] & (1 << _SLOT) - 1, 1)[0]
            whole = cost + (_END[writer.state] >> _SLOT)
            writer.insert(tail)
            return {
                "conv_id": at, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal,
                "cost": whole, "audit": "".join(writer.audit), "repaired_sha256": writer.sum.hexdigest(),
            }

        target = None
        for batch in batches:
            target = target or pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in _RESULT[:6]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                if tally is None or block["conv_id"] != at:
                    if tally is not None:
                        out.append(result())
                    at, tally, writer, cost = block["conv_id"], _Tally(), _Writer(), 0
                tally.join(block)
                way = block["ways"][block["choice"][writer.state]]
                cost += way["cost"]
                free = sum(r["free"] for r in block["rows"])
                _write(writer, block["rows"], _letters(int.from_bytes(way["digits"]), free))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if tally is not None:
            yield pa.RecordBatch.from_pylist([result()], schema=target)

    return ordered.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _RESULT[:6]) + ", audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation with rows.

    Rows of (conv_id, turn, role, text) are taken by turn, nulls first, and by role and text where turns tie; a null role or text is one
    space, a null conv_id a conversation of its own. Each row's first fault counts (``faults``). Edits: keep 0, rerole to
    user or assistant 2, delete 3 (blank and duplicate rows must go), insert an empty user or assistant row 2; a truncated row that
    stays adds 1. The cheapest edits whose roles' initials give ``(s?(ua)+)?`` win, ties by their audit letters ``DIKR`` in ASCII order.
    ``illegal`` counts neighbouring initials other than su, ua, au, before repair. Other columns are ignored; an empty table gives none.

    Rows are range-partitioned in order, so a conversation of any length is spread over tasks; its blocks are solved for every state
    before and after them, and two passes over the blocks, last first and first last, choose among these. ``audit`` is one value and
    the checksum one sequence, so the last pass streams a conversation's blocks through one task, one block at a time.
    """
    pieces = cut(_pieces(faults(conversations)))
    done = pieces.where("done")
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = done.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    rest = pieces.where("not done").drop("done", "cost", "audit", "sha")
    return whole.unionByName(_follow(rest.join(cut(_choices(rest)), ["part", "seq"])))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by the checksum of ``conv_id:turn`` modulo 20: 0 drops one, 1 empties its text, 2 takes its ``.!?``, 3 repeats
    it, 4 gives it to the user. A null conv_id or turn is empty text there, as a null role or text is one space."""
    space, empty = F.lit(" "), F.lit("")
    part = lambda c: F.coalesce(F.col(c).cast("string"), empty)
    k = F.col("_k")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kind = rows.withColumn("_k", (F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20).cast("int")).where(k != 0)
    text = F.when(k == 1, empty).when(k == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    spoilt = kind.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "_k")
    return spoilt.withColumn("_copy", F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k", "_copy")
