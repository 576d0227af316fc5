"""Byte-level BPE, token counts, fingerprints, shards."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tests.conftest import SF
from tests.helpers import same_rows
from tests.llm.helpers import corpus, empty, prose, table
from vigia.llm import bpe, fingerprints, sharding, token_counts
from vigia.llm.common import WordHashes


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path(bpe.VOCABULARY)), P.PATTERN)


def test_transducer_encodes_like_the_library(codec, library):
    rng = random.Random(1)
    alphabet = ["abcdefghij", "the rnionst", "éàüßñ", "日本語漢字", "😀👍🏽", " \t\n", "0123", "!?.-", "​\x1c\x85"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.randrange(60)))
        text = text[:3] * rng.randrange(1, 30) if rng.random() < 0.3 else text
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text


def test_bounded_tables_change_nothing(library):
    small = bpe.Codec(bpe.read_ranks(P.path(bpe.VOCABULARY)), P.PATTERN, room=(20, 5))
    for _, text in corpus():
        assert small.encode(text or "") == library.encode_ordinary(text or "")


def test_tokens_leave_before_the_end(codec):
    """Lookahead is bounded: a long piece settles its first tokens while bytes are still to come."""
    machine, at, emitted = codec.pieces, codec.pieces.states[0], []
    data = b"abcxyz" * 500
    for k, byte in enumerate(data):
        at, out = machine._step(at, byte)
        emitted += out
        assert k + 1 - sum(len(machine.bytes_of[t]) for t in emitted) <= 64


def test_decoder_keeps_state_across_cuts_and_replaces_bad_bytes(codec):
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 12)))
        assert codec.decode([codec.pieces.ranks[bytes([b])] for b in data]) == data.decode("utf-8", "replace")


def test_round_trip_rows(spark, library):
    rows = corpus()
    df = bpe.round_trip(table(spark, rows))
    assert df.columns[-2:] == ["ids", "decoded"] and df.columns.count("ids") == 1
    got = sorted((r["doc_id"] or -1, r["decoded"], list(r["ids"])) for r in df.collect())
    assert got == sorted((d or -1, t or "", library.encode_ordinary(t or "")) for d, t in rows)
    assert bpe.decode(bpe.encode(table(spark, rows))).filter("decoded != coalesce(text, '')").isEmpty()
    assert bpe.round_trip(empty(spark)).isEmpty()


def test_section_tokens(spark, library):
    rows = corpus()
    got = token_counts.section_tokens(table(spark, rows, extra=False).filter("doc_id < 90")).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["section"] >= 0
    assert total == {d: len(library.encode_ordinary(t or "")) for d, t in rows if d is not None and d < 90}
    assert token_counts.section_tokens(empty(spark)).isEmpty()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_matches_brute_force(rule, library):
    spans = token_counts.Spans(bpe.read_ranks(P.path(bpe.VOCABULARY)), P.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab cé日😀\n.") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4))))
        low, high = np.array(cuts[: len(cuts) // 2 * 2 : 2], int), np.array(cuts[1::2], int)
        got, outside, _ = token_counts.attribute(*spans.of(text), low, high, rule)
        want, out, at = np.zeros(len(low)), 0.0, 0
        data, owner = text.encode(), [k for k, c in enumerate(text) for _ in c.encode()]
        for token in library.encode_ordinary(text):
            n = len(library.decode_single_token_bytes(token))
            s, e, at = owner[at], owner[at + n - 1] + 1, at + n
            held = [sum(a <= c < b for c in range(s, e)) for a, b in zip(low, high, strict=True)]
            touched = [k for k, h in enumerate(held) if h]
            if not touched:
                out += 1
            elif rule == "first":
                want[touched[0]] += 1
            elif rule == "most":
                want[max(touched, key=lambda k: (held[k], -k))] += 1
            else:
                for k in touched:
                    want[k] += held[k] / (e - s)
                out += 1 - sum(held) / (e - s)
        assert at == len(data) and np.allclose(got, want) and abs(out - outside) < 1e-9


def test_fingerprints(spark):
    rows = corpus()
    got = fingerprints.with_next_edited(table(spark, rows).repartition(7)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[30] == prints[31] and prints[80] == prints[81] == {""}
    one = fingerprints.with_next_edited(table(spark, [(5, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprints.with_next_edited(empty(spark)).isEmpty()


def test_likeness_estimates_jaccard():
    hashes, errors = WordHashes(), []
    for share in range(0, 21):
        common = [f"c{share}x{k}" for k in range(50 * share)]
        a, b = (" ".join(common + [f"{s}{share}y{k}" for k in range(1000 - 50 * share)]) for s in "ab")
        x, y = ({tuple(t.split()[k : k + 5]) for k in range(996)} for t in (a, b))
        errors.append(fingerprints.likeness(*(fingerprints.fingerprint(t, hashes) for t in (a, b))) - len(x & y) / len(x | y))
        values = fingerprints.fingerprint(a, hashes)
        assert (fingerprints.unpacked(fingerprints.packed(values)) == values).all()
    assert np.sqrt(np.mean(np.square(errors))) < 0.04 and abs(np.mean(errors)) < 0.015


def test_shards_fit_and_match_a_recursive_split(spark):
    """Null keys hold much of the bytes: their rows split by text, copies of one text stay together."""
    rows = corpus() + [(1000 + k, "x" * (k % 50)) for k in range(500)] + [(None, prose(k % 90, 40)) for k in range(100)]

    def number(value):
        return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)

    for limit in (300, 4000, 10**9):
        got = sharding.assign_shards(table(spark, rows), limit=limit).collect()
        want = []

        def split(part, by, depth, prefix, above):
            total = sum(x[3] for x in part)
            if total > limit and len({x[by] for x in part}) > 1 and depth < 60:
                for bit in (0, 1):
                    half = [x for x in part if x[by] >> (59 - depth) & 1 == bit]
                    if half:
                        split(half, by, depth + 1, prefix * 2 + bit, above)
            elif by == 0 and total > limit and len(part) > 1:
                split(part, 1, 0, 0, (depth, prefix))
            else:
                at = (*above, depth, prefix) if by else (depth, prefix, 0, 0)
                want.extend((str(d), b, *at, total, len(part), total > limit) for _, _, d, b in part)

        split([(number(d), number(t), d, len((t or "").encode())) for d, t in rows], 0, 0, 0, None)
        assert sorted(want) == sorted((str(r["doc_id"]), r["n_bytes"], r["depth"], r["prefix"], r["sub_depth"], r["sub_prefix"], r["shard_bytes"], r["shard_rows"], r["oversize"]) for r in got)
        assert any(r["oversize"] for r in got) == (limit < 10**9) and any(r["sub_depth"] for r in got) == (limit < 10**9)
    assert sharding.assign_shards(empty(spark)).isEmpty()


@pytest.mark.parametrize("limit", [5_000, 40_000])
def test_many_splits_match_sql(spark, duck, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert same_rows(sharding.assign_shards(docs, limit=limit), duck.execute(sharding.ORACLE.replace(str(sharding.LIMIT_BYTES), str(limit))))


def test_a_hot_key_is_written_to_several_shards(spark, tmp_path):
    rows = [(7, prose(k, 30)) for k in range(80)] + [(k, prose(k, 30)) for k in range(100, 140)]
    sharding.write_shards(table(spark, rows, extra=False), str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(rows)
    assert back.filter("doc_id = 7").select("shard").distinct().count() > 8
    assert back.groupBy("shard").agg({"n_chars": "sum"}).filter("`sum(n_chars)` > 1000").isEmpty()


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(k, "x" * k) for k in range(1, 60)]
    sharding.write_shards(table(spark, rows, extra=False), str(tmp_path / "out"), limit=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
    assert back.groupBy("shard").agg({"n_chars": "sum"}).filter("`sum(n_chars)` > 300").isEmpty()
