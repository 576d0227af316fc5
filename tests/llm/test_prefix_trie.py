"""Prefix trie against plain dictionaries."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from vigia.llm import prefix_trie as T

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [r[3] for r in sorted(t, key=lambda r: r[:3])] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -10**9, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, m in members.items()
    )


def talk(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for conv in range(-12, n):
        for turn in range(rng.randrange(1, 9) if conv % 50 else 60):
            first = "common" if turn == 0 and rng.random() < 0.4 else None
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", None]), first or rng.choice(["a", "bé", "", None, f"t{rng.randrange(30)}"])))
    rows = [r for r in rows if r[0] % 35 != 5]  # some bases are absent
    return rows + [(None, 1, "user", "x"), (2**62, 0, "user", "far"), (9223372036854775805, 0, "user", "end")] + rows[7:12]


def found(df, **more):
    placed = T.turns(df)
    rows = T.prefix_trie(T.rebuilt(placed), placed.filter("k = 0"), **more).fillna(-10**9, ["parent_conv_id"]).collect()
    return sorted(tuple(r) for r in rows)


def test_matches_plain_dictionaries(spark):
    rows = talk(1)
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS conv", "2 AS k", "'x' AS node", "0 AS depth", "0L AS n").repartition(6)
    want = plain(rows)
    assert found(df) == want
    assert found(df, limit=2, room=3) == want  # many shards, layers and spilled runs


def test_layers_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(T, "FACTOR", 2)
    rows = talk(2, 120)
    assert found(spark.createDataFrame(rows, CONVERSATIONS), limit=1, room=1) == plain(rows)


def test_queue_gives_messages_in_order():
    rng = random.Random(3)
    queue, want, now = T.SpillingQueue(7), [], 0
    for _ in range(3000):
        if rng.random() < 0.6:
            key = now + rng.randrange(1, 40)
            queue.send(key, (key, rng.random()))
            heapq.heappush(want, key)
        else:
            now += 1
            taken = sum(1 for _ in queue.take(now))
            assert taken == sum(1 for k in want if k == now)
            want = [k for k in want if k != now]
            heapq.heapify(want)


def test_empty(spark):
    assert found(spark.createDataFrame([], CONVERSATIONS)) == []
    assert found(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATIONS)) == []
