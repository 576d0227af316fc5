"""Near-duplicates, repeated passages, benchmark items."""

import hashlib
import random

import pytest

from tests.llm.helpers import corpus, edited, empty, prose, table
from vigia.llm import decontamination, near_dedup, substring_dedup
from vigia.llm.components import components


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def linked_components(rows, size, percent=80):
    """doc_id -> smallest reachable id, by comparing all pairs."""
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingle_set(t, size)) for d, t in rows if d is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_all_pairs(spark, size):
    rows = corpus()
    got = near_dedup.near_duplicates(table(spark, rows), size=size).collect()
    want = linked_components(rows, size)
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((d, want[d], len(shingle_set(t, size))) for d, t in rows if d is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert near_dedup.near_duplicates(empty(spark)).isEmpty()


@pytest.mark.parametrize("turns", [0, 1, 2])
def test_group_around_a_base_and_common_passage(spark, monkeypatch, turns):
    """Many copies on both sides of the threshold, and unlike texts with one passage: hubs, bounds and the last pairs."""
    monkeypatch.setattr(near_dedup, "HUB_TURNS", turns)
    base, passage = prose(5, 200), prose(6, 60)
    rows = [(7, base)] + [(10 + k, edited(base, k, 0.002 * k)) for k in range(60)]
    rows += [(100 + k, f"{passage} {prose(900 + k, 25)}") for k in range(40)]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked_components(rows, 5)


def test_bounds_are_of_one_text_where_an_id_has_several(spark):
    """One text of id 94 is a near copy of document 5, the other a long unlike one: the link stays."""
    base = prose(40, 300)
    rows = [(5, base), (94, edited(base, 41, 0.01)), (94, prose(42, 330)), (6, prose(43, 280))]
    # The unlike text is itself a candidate, and the pair's ids stand in both orders.
    rows += [(95, edited(prose(42, 330), 44, 0.01)), (200, prose(45, 300)), (150, edited(prose(45, 300), 46, 0.01)), (150, prose(47, 400)), (150, prose(48, 20))]
    want = linked_components(rows, 5)
    assert want[94] == want[95] == 5 and want[200] == 150
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows)).collect()} == want


def test_banding_and_verification_bounds():
    assert near_dedup.missed(0.8) < 1e-5
    need = near_dedup.least_matches(0.8)
    assert need == sorted(need) and all(0 < n < 0.8 * near_dedup.BATCH * (k + 1) for k, n in enumerate(need))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 240)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if any(k in link and link[0] != link[1] for link in links)}


def without_repeats(rows, window=50):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(d, first.get(key, d))
    for d, t in rows:
        words = (t or "").encode().split()
        keep = [True] * len(words)
        if d is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < d:
                    keep[k : k + window] = [False] * window
        out.append((d, [w for w, x in zip(words, keep, strict=True) if x], len(words)))
    return out


def test_repeated_passages_match_brute_force(spark):
    rows = corpus()
    want = without_repeats(rows)
    df = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted((str(d), " ".join(w.decode() for w in kept), n - len(kept)) for d, kept, n in want) == sorted((str(r["doc_id"]), " ".join(w.decode() for w in (r["text"] or "").encode().split()), r["n_gone"]) for r in df)
    assert all(r["text"] == t for r in df for d, t in rows if r["doc_id"] == d and r["n_gone"] == 0 and d not in (93, 94, None))
    assert substring_dedup.remove_repeats(empty(spark)).isEmpty()


def test_query_six_digests(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    table(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.op6(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, kept, n in without_repeats(rows))


def test_many_small_shards_give_the_same_spans(spark, tmp_path, monkeypatch):
    for name, value in (("PHRASES", 3), ("OCCURRENCES", 4), ("HOT", 2), ("SALTS", 3), ("PIECE", 8)):
        monkeypatch.setattr(substring_dedup, name, value)
    shared = prose(60, 90)
    rows = [r for r in corpus() if r[0] is not None] + [(400 + k, f"{prose(500 + k, 20 * k)} {shared} {prose(600 + k, 15)}") for k in range(9)]
    table(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.op6(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, kept, n in without_repeats(rows))


def test_automaton_of_a_shard_finds_every_place():
    rng = random.Random(12)
    words = [rng.choice([b"a", b"b", b"ab"]) for _ in range(400)]
    phrases = sorted({tuple(words[k : k + 4]) for k in range(0, 60, 3)})
    shard = substring_dedup._Shard(substring_dedup.WordHashes(), 4)
    for part in (phrases[:5], phrases[3:]):  # repeated phrases too
        shard.add(b"\n".join(b" ".join(p) for p in part), [False] * len(part))
    shard.compile()
    text = [*words[200:], b"new", *words[:30]]
    starts, numbers = shard.occurrences(text)
    assert starts.tolist() == [k for k in range(len(text) - 3) if tuple(text[k : k + 4]) in phrases]
    keys = substring_dedup.run_hashes(shard.hashes.of(text), 4)
    assert (shard.keys[numbers] == keys[starts]).all()


def distance(pattern, text):
    """Least edits between the pattern and any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_distance():
    rng = random.Random(6)
    for _ in range(1500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi))) for lo, hi in ((1, 9), (0, 25)))
        found, end = decontamination.Myers(p).best(t)
        assert found == distance(p, t) and distance(p, t[:end]) == found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [(k, prose(700 + k, 12).capitalize()) for k in range(6)] + [(6, None), (7, ""), (8, "ab"), (0, prose(700, 12))]
    rows = [(80, None), (81, ""), (None, items[1][1]), (82, "x AB y")]
    for k in range(30):
        text = list(items[k % 6][1])
        for _ in range(k // 3):
            text[rng.randrange(len(text))] = rng.choice("abcq ")
        rows.append((k, f"{prose(k, 30)}\n {''.join(text).upper() if k % 2 else ''.join(text)}  {prose(k + 50, 20)}"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(table(spark, rows), benchmark).collect()
    want = []
    for d, t in rows:
        for k, item in items:
            p, text = decontamination.normal(item), decontamination.normal(t)
            if p and (n := distance(p, text)) <= decontamination.budget(len(p)):
                want.append((str(d), k, n))
    assert sorted(want) == sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in got)
    assert any(n for _, _, n in want) and any(r["doc_id"] is None for r in got)
    assert decontamination.contaminated(empty(spark), benchmark).isEmpty()
    assert decontamination.contaminated(table(spark, rows), benchmark.limit(0)).isEmpty()
