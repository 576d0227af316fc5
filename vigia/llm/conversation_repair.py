"""Conversation structure repair: Hirschberg's divide and conquer over four states.

A conversation's turns are edited so that the initials of their roles read ``(s?(ua)+)?``. Edits: Keep (K, 0),
Rerole to user or assistant (R, 3), Delete (D, 4; the only one for blank and duplicate turns), Insert an empty
user or assistant turn anywhere (I, 3); a truncated turn that is not deleted adds 3. Of the cheapest edits the
ASCII-least string of initials (the audit) is taken. The state is what stands before: nothing, s, u or a; it
fixes the role that an inserted or re-roled turn gets, so an audit names one repair.

**Method.** A forward vector holds, for each state, the least cost of the first half and the rank of its least
audit; a backward vector the least cost of the rest. They meet in the middle, the cheapest crossing with the
least rank is taken, and both halves are solved alike: linear space. Ranks decide because audits of the same
turns that end in different states are different and none is a prefix of another (each ends with its last
turn's edit).

**Long conversations** (over PIECE turns or PIECE_BYTES) are cut into pieces of at most PIECE turns, dealt over
all tasks: each piece gives its 4 x 4 costs and ranks, these are joined per conversation (a few numbers a
piece), and each piece is then solved between its entry and exit state. Only the report's audit and hash, which
are one value a conversation, are put together in one task, where turns pass as a stream.

Defined results: turns are ordered by turn (nulls first), then role, then text; copies of a row stand next to
each other; null roles and texts are empty, empty texts are blank; roles count by their first character, others
than s, u, a can't be kept; a null conversation id is a conversation; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import mapped, stage, table

PIECE, PIECE_BYTES = 4096, 16 * 1024 * 1024
SPACE = " \t\n\x0b\x0c\r"
#: State after an inserted or re-roled turn, by the state before; states: nothing, s, u, a.
NEXT = (2, 2, 3, 2)
#: Cost and edits that complete a conversation, by its last state.
END = ((0, ""), (6, "II"), (3, "I"), (0, ""))
LEGAL = ("su", "ua", "au")
FAR = 1 << 60


def _steps(code: int) -> tuple:
    """Cheapest (entry, exit, cost, edits) of one turn with the inserts before it; ties take the least edits."""
    initial, doomed, extra = code & 3, code >> 2 & 1, 3 * (code >> 3 & 1)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in range(4):
        at = entry
        for inserts in range(4):
            ways = [(at, 4, "D")]
            if not doomed:
                ways.append((NEXT[at], 3 + extra, "R"))
                if initial == 0 and at == 0 or initial == 1 and at != 2 or initial == 2 and at == 2:
                    ways.append((initial + 1, extra, "K"))
            for to, cost, edit in ways:
                way = (cost + 3 * inserts, "I" * inserts + edit)
                best[entry, to] = min(best.get((entry, to), way), way)
            at = NEXT[at]
    return tuple((a, b, *way) for (a, b), way in sorted(best.items()))


#: By code: initial (s, u, a, other), +4 if it must go, +8 if truncated.
STEPS = tuple(_steps(code) for code in range(16))
EDITS = tuple({(a, b): edits for a, b, _, edits in steps} for steps in STEPS)


def forward(codes: bytes, entry: int) -> list[tuple[int, int]]:
    """(least cost, rank of its least audit) of reaching each state over ``codes``."""
    now = [(FAR, 9)] * 4
    now[entry] = (0, 0)
    for code in codes:
        best = [(FAR, 9, "")] * 4
        for a, b, cost, edits in STEPS[code]:
            if now[a][0] < FAR:
                way = (now[a][0] + cost, now[a][1], edits)
                if way < best[b]:
                    best[b] = way
        order = sorted({way[1:] for way in best if way[0] < FAR})
        now = [(way[0], order.index(way[1:])) if way[0] < FAR else (FAR, 9) for way in best]
    return now


def backward(codes: bytes, leave: int) -> list[int]:
    """Least cost from each state over ``codes`` to the state ``leave``."""
    now = [FAR] * 4
    now[leave] = 0
    for code in reversed(codes):
        best = [FAR] * 4
        for a, b, cost, _ in STEPS[code]:
            best[a] = min(best[a], now[b] + cost)
        now = best
    return now


def edits_between(codes: bytes, entry: int, leave: int) -> list[str]:
    """Edits of each turn on the cheapest, then ASCII-least way from ``entry`` to ``leave``."""
    out, todo = [], [(codes, entry, leave)]
    while todo:
        codes, entry, leave = todo.pop()
        if len(codes) == 1:
            out.append(EDITS[codes[0]][entry, leave])
        elif codes:
            half = len(codes) // 2
            cross = min((cost + rest, rank, state) for state, ((cost, rank), rest) in enumerate(zip(forward(codes[:half], entry), backward(codes[half:], leave))))[2]
            todo += [(codes[half:], cross, leave), (codes[:half], entry, cross)]
    return out


def last_state(costs: list[tuple[int, int]]) -> int:
    """The state in which a whole conversation best ends, from its forward vector."""
    return min((cost + END[state][0], rank, state) for state, (cost, rank) in enumerate(costs))[2]


def _solved(codes: bytes) -> list[str]:
    if not codes:
        return []
    leave = last_state(forward(codes, 0))
    out = edits_between(codes, 0, leave)
    out[-1] += END[leave][1]
    return out


solve = lru_cache(1 << 14)(lambda codes: tuple(_solved(codes)))


def repair(codes: bytes) -> tuple[str, ...]:
    """Edits of each turn of a whole conversation (its last ones may end with inserts)."""
    return solve(codes) if len(codes) <= 16 else tuple(_solved(codes))


def turns_of(state: int, edits: str, role: str, text: str):
    """(edit, role, text) of the turns that one turn becomes, and the state after them last."""
    out = []
    for edit in edits:
        if edit == "K":
            state = "sua".index(role[0]) + 1
            out.append((edit, role, text))
        elif edit != "D":
            state = NEXT[state]
            out.append((edit, "assistant" if state == 3 else "user", text if edit == "R" else ""))
    return out, state


class _Report:
    """Counts, cost, audit and hash of one conversation, turn by turn."""

    FIELDS = (("c", "long"), ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"))

    def __init__(self, c):
        self.c, self.turns, self.faults = c, [None, None, 0], [0, 0, 0, 0]
        self.before, self.state, self.illegal, self.cost = None, 0, 0, 0
        self.audit, self.hash, self.started = [], hashlib.sha256(), False

    def add(self, turn, role, text, fault: int, edits: str):
        if turn is not None:
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high)]
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        out, self.state = turns_of(self.state, edits, role, text)
        for _, new_role, new_text in out:
            self.hash.update((b"\n" if self.started else b"") + f"{new_role}:{new_text}".encode())
            self.started = True
        self.cost += sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in edits) + (3 if fault == 3 and "D" not in edits else 0)
        self.audit.append(edits)

    def row(self):
        low, high, n = self.turns
        return (self.c, 0 if low is None else high - low + 1 - n, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


ROWS = (("c", "long"), ("place", "long"), ("edit", "string"), ("turn", "long"), ("role", "string"), ("text", "string"))


def _schema(fields) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


def _batches(rows, fields, size: int = 1000):
    """Arrow batches of at most ``size`` tuples."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    block = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*block), fields)], [name for name, _ in fields])

    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield made()
            block = []
    if block:
        yield made()


def _rows(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _fault_of(role: str, text: str, seen: set) -> int:
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    bare = text.rstrip(SPACE)
    fault = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
    seen.add((role, text))
    return fault


def _code(role: str, fault: int) -> int:
    return "sua".find(role[:1] or "?") % 4 + (4 if fault in (1, 2) else 8 if fault == 3 else 0)


def _short(as_rows: bool):
    """Whole conversations, one after the other; rows (c, turn, copies, role, text) arrive in order."""

    def run(batches):
        def results():
            for c, group in groupby(_rows(batches), key=lambda r: r[0]):
                turns = [(turn, role, text) for _, turn, copies, role, text in group for _ in range(copies)]
                seen: set = set()
                faults = [_fault_of(role, text, seen) for _, role, text in turns]
                edits = repair(bytes(_code(role, fault) for (_, role, _), fault in zip(turns, faults)))
                if as_rows:
                    state, place = 0, 0
                    for (turn, role, text), e in zip(turns, edits):
                        out, state = turns_of(state, e, role, text)
                        for edit, *new in out:
                            yield (c, place, edit, None if edit == "I" else turn, *new)
                            place += 1
                else:
                    report = _Report(c)
                    for row, fault, e in zip(turns, faults, edits):
                        report.add(*row, fault, e)
                    yield report.row()

        yield from _batches(results(), ROWS if as_rows else _Report.FIELDS)

    return run


def _pieces(batches):
    """4 x 4 costs and ranks of each piece; rows (c, piece, pos, code) arrive in order."""
    for batch in _batches(
        ((c, piece, *zip(*(way for entry in range(4) for way in forward(codes, entry)))) for (c, piece), codes, _ in _coded(batches)),
        (("c", "long"), ("piece", "long"), ("costs", "array<long>"), ("ranks", "array<long>")),
    ):
        yield batch


def _coded(batches, *more: int):
    for key, group in groupby(_rows(batches), key=lambda r: r[:2]):
        group = list(group)  # at most PIECE small rows
        yield key, bytes(r[3] for r in group), group


def _meeting(batches):
    """Entry and exit state of each piece; rows (c, piece, costs, ranks) arrive in order."""

    def results():
        for c, group in groupby(_rows(batches), key=lambda r: r[0]):
            pieces = [(piece, costs, ranks) for _, piece, costs, ranks in group]
            rest = [[cost for cost, _ in END]]  # cost from each state to the end, from the last piece back
            for _, costs, _ in reversed(pieces):
                rest.append([min(costs[4 * a + b] + rest[-1][b] for b in range(4)) for a in range(4)])
            entry = 0
            for k, (piece, costs, ranks) in enumerate(pieces, 1):
                after = rest[-1 - k]
                leave = min((costs[4 * entry + b] + after[b], ranks[4 * entry + b], b) for b in range(4))[2]
                yield c, piece, entry, leave, int(k == len(pieces))
                entry = leave

    yield from _batches(results(), _MET)


_MET = (("c", "long"), ("piece", "long"), ("entry", "int"), ("leave", "int"), ("last", "int"))
_EDITED = (("pos", "long"), ("state", "int"), ("edits", "string"))


def _edited(batches):
    """State before and edits of each turn; rows (c, piece, pos, code, entry, leave, last) arrive in order."""

    def results():
        for _, codes, group in _coded(batches):
            *_, entry, leave, last = group[0]
            edits, state = edits_between(codes, entry, leave), entry
            if last:
                edits[-1] += END[leave][1]
            for row, e in zip(group, edits):
                yield row[2], state, e
                _, state = turns_of(state, e, "sua?"[row[3] & 3], "")

    yield from _batches(results(), _EDITED)


def _emitted(batches):
    """New turns of rows (c, pos, turn, role, text, state, edits), each by itself."""

    def results():
        for c, pos, turn, role, text, state, edits in _rows(batches):
            for k, (edit, *new) in enumerate(turns_of(state, edits, role, text)[0]):
                yield (c, 8 * pos + k, edit, None if edit == "I" else turn, *new)

    yield from _batches(results(), ROWS)


def _streamed(batches):
    """Reports of long conversations; rows (c, pos, turn, role, text, fault, edits) arrive in order."""

    def results():
        for c, group in groupby(_rows(batches), key=lambda r: r[0]):
            report = _Report(c)
            for _, _, turn, role, text, fault, edits in group:
                report.add(turn, role, text, fault, edits)
            yield report.row()

    yield from _batches(results(), _Report.FIELDS)


def _sorted(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in [*keys, *order]))


def _long(rows: DataFrame, piece: int, as_rows: bool) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("row", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in ("c", "turn", "role", "text", "row")]
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).alias("own")
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same")
    # pos follows the range order, so it is the turn's place over all tasks.
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = stage(rows.select("c", "pos", "turn", "role", "text", own, same), "repair-rows")

    twice = rows.groupBy("c", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("c").alias("c2"), F.col("same").alias("same2"), "first")
    again = rows.join(twice, F.col("c").eqNullSafe(F.col("c2")) & (F.col("same") == F.col("same2")) & (F.col("pos") > F.col("first"))).select("pos", F.lit(1).alias("again"))
    fault = F.when(F.col("own") == 1, 1).when(F.col("again").isNotNull(), 2).otherwise(F.col("own"))
    initial = F.coalesce(F.expr("CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 END"), F.lit(3))
    slim = rows.select("c", "pos", "role", "own").join(again, "pos", "left").withColumn("fault", fault)
    code = (initial + F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0)).cast("int")
    slim = stage(slim.select("c", F.floor(F.col("pos") / piece).alias("piece"), "pos", code.alias("code"), "fault"), "repair-codes")

    keyed = slim.select("c", "piece", "pos", "code")
    summaries = mapped(_sorted(keyed, ["c", "piece"], "pos"), _pieces, "c long, piece long, costs array<long>, ranks array<long>")
    met = mapped(_sorted(summaries, ["c"], "piece"), _meeting, _schema(_MET)).withColumnRenamed("c", "c2")
    joined = keyed.join(met.withColumnRenamed("piece", "piece2"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("piece") == F.col("piece2")))
    joined = joined.select("c", "piece", "pos", "code", "entry", "leave", "last")
    edited = mapped(_sorted(joined, ["c", "piece"], "pos"), _edited, _schema(_EDITED))
    if as_rows:
        return mapped(rows.join(edited, "pos").select("c", "pos", "turn", "role", "text", "state", "edits"), _emitted, _schema(ROWS))
    edited = edited.join(slim.select("pos", "fault"), "pos").select("pos", "fault", "edits")
    return mapped(_sorted(rows.join(edited, "pos").select("c", "pos", "turn", "role", "text", "fault", "edits"), ["c"], "pos"), _streamed, _schema(_Report.FIELDS))


def _repaired(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None, piece: int, as_rows: bool) -> DataFrame:
    def value(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    times = F.lit(1) if copies is None else F.coalesce(F.col(copies).cast("int"), F.lit(0))
    rows = df.select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), times.alias("copies"), value(role).alias("role"), value(text).alias("text"))
    sizes = rows.groupBy("c").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("b"))
    large = stage(sizes.filter((F.col("n") > piece) | (F.col("b") > PIECE_BYTES)).select(F.col("c").alias("c2")), "repair-long")
    any_large = not large.isEmpty()
    small = rows.join(large, F.col("c").eqNullSafe(F.col("c2")), "left_anti") if any_large else rows
    fields = ROWS if as_rows else _Report.FIELDS
    out = mapped(_sorted(small, ["c"], "turn", "role", "text"), _short(as_rows), _schema(fields))
    if any_large:
        out = out.unionByName(_long(rows.join(large, F.col("c").eqNullSafe(F.col("c2")), "left_semi"), piece, as_rows))
    return out.withColumnRenamed("c", conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, piece: int = PIECE) -> DataFrame:
    """(conv, place, edit, turn, role, text) of the repaired turns; ``place`` ascends within a conversation.

    ``copies`` may name a column with how often a row stands (0: it only names its conversation); inserted
    turns have a null turn.
    """
    return _repaired(df, conv, turn, role, text, copies, piece, True)


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, piece: int = PIECE) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost, audit, SHA-256 of the repaired turns."""
    return _repaired(df, conv, turn, role, text, copies, piece, False)


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with the dealt damage; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return df.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(known("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11(spark, sf_dir):
    return report(damaged(table(spark, sf_dir, "conversations")), copies="copies")
