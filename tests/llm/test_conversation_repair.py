"""Conversation repair against an exhaustive search and a plain whole-table version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from vigia.llm import conversation_repair as C

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SHAPE = re.compile("(s?(ua)+)?")


def cheapest(codes):
    """(cost, audit) over all edits, by a plain search over (turn, state) that keeps whole audits."""
    best = {0: (0, "")}
    for code in codes:
        now = {}
        for state, (cost, audit) in best.items():
            for a, b, more, edits in C.STEPS[code]:
                if a == state:
                    way = (cost + more, audit + edits)
                    now[b] = min(now.get(b, way), way)
        best = now
    if not codes:
        return 0, ""
    return min((cost + C.END[state][0], audit + C.END[state][1]) for state, (cost, audit) in best.items())


def exhaustive(initials, faults):
    """(cost, audit) over every edit of every turn with up to two inserts around each, by definition."""
    from itertools import product
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    each = []
    for i, f in zip(initials, faults):
        ways = [("D", "", 4)]
        if f not in (1, 2):
            ways += [("K", i, 3 * (f == 3))] + [("R", x, 3 + 3 * (f == 3)) for x in "ua"]
        each.append([(g, *w) for g in gaps for w in ways])
    for picked in product(*each):
        for tail in gaps:
            word = "".join(g + x for g, _, x, _ in picked) + tail
            if SHAPE.fullmatch(word):
                cost = sum(3 * len(g) + c for g, _, _, c in picked) + 3 * len(tail)
                found.append((cost, "".join("I" * len(g) + e for g, e, _, _ in picked) + "I" * len(tail)))
    return min(found)


def code_of(initial, fault):
    return C._code(initial, fault)


def test_steps_are_the_cheapest_edits_by_definition():
    rng = random.Random(1)
    for n, turns in ((1, 40), (2, 80), (3, 60)):
        for _ in range(turns):
            initials = [rng.choice("suax") for _ in range(n)]
            faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            assert exhaustive(initials, faults) == cheapest([code_of(i, f) for i, f in zip(initials, faults)]), (initials, faults)


def test_divide_and_conquer_finds_the_least_audit():
    rng = random.Random(2)
    for _ in range(1500):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 9, 10]) for _ in range(rng.randrange(0, 40)))
        assert "".join(C.repair(codes)) == cheapest(codes)[1]


def plain(rows):
    """The contract's report from damaged rows {conv: [(turn, role, text)]}, without the operator's parts."""
    out = {}
    for conv, turns in rows.items():
        turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last[0] in ".!?" else 3)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = cheapest([code_of(i or "?", f) for i, f in zip(initials, faults)])
        known = [t for t, _, _ in turns if t is not None]
        lines, state, k = [], "", 0
        for edit in audit:
            want = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append((want, ""))
            else:
                _, role, text = turns[k]
                k += 1
                if edit == "D":
                    continue
                lines.append((role if edit == "K" else want, text))
            state = lines[-1][0][0]
        assert SHAPE.fullmatch("".join(r[0] for r, _ in lines))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in C.LEGAL for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def talk(seed, n_conv=60, long=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        n = long if conv % 20 == 7 else rng.randrange(1, 9)
        for turn in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Hi there.", "What?", "no end", "", " \t ", "done!", "Ünï x.\n", f"t{rng.randrange(9)}.", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-3, None, "user", None), (900, 5, "user", "x" * 20_000)]
    return rows + rows[10:14]


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_report_matches_a_plain_version(spark):
    rows = talk(3)
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS c", "2 AS pos", "'x' AS edits", "0 AS copies", "1 AS place", "'y' AS same").repartition(5)
    want = plain(damage(rows))
    assert got(C.report(C.damaged(df), copies="copies")) == want
    for piece in (4, 16):  # long conversations in pieces give the same
        assert got(C.report(C.damaged(df), copies="copies", piece=piece)) == want


def test_repaired_turns(spark):
    rows = talk(4, 30)
    want = plain(damage(rows))
    for piece in (4, 4096):
        turns = defaultdict(list)
        for r in C.repaired(C.damaged(spark.createDataFrame(rows, CONVERSATIONS)), copies="copies", piece=piece).orderBy("place").collect():
            turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: r[-1] for c, r in want.items()}


def test_empty(spark):
    assert C.report(C.damaged(spark.createDataFrame([], CONVERSATIONS)), copies="copies").isEmpty()
