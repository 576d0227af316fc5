"""Token-id files against the tokenizers library and a plain Simple-8b."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import corpus, empty, table
from vigia.llm import token_files as W


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(W.VOCABULARY))


@pytest.fixture(scope="module")
def encoder():
    return W.Encoder(P.path(W.VOCABULARY))


def greedy(ids):
    """Selectors that a plain loop chooses."""
    out, at = [], 0
    while at < len(ids):
        for s in range(1, 15):
            part = ids[at : at + int(W.COUNTS[s])]
            if all(x < 1 << int(W.WIDTHS[s]) for x in part):
                break
        else:
            s = 0
        out.append(s)
        at += int(W.COUNTS[s])
    return out


def test_words_match_a_plain_loop_and_come_back(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 1000)
    rng = random.Random(3)
    for turn in range(300):
        ids = [rng.choice([rng.getrandbits(rng.choice([1, 2, 5, 8, 12, 15, 16, 20, 33, 60, 64])), 0, 1]) for _ in range(rng.randrange(0, 200))]
        ids = ids * (60 if turn % 50 == 0 else 1)
        words, escapes, offsets = W.pack(np.array(ids, np.uint64))
        assert W.unpack_all(words, escapes, offsets, len(ids)).tolist() == ids
        assert escapes.tolist() == [x for x in ids if x >> 60]
        for k, at in enumerate(offsets.tolist()):  # any block alone
            block = ids[k * W.BLOCK : (k + 1) * W.BLOCK]
            end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
            assert (words[at:end] >> np.uint64(60)).tolist() == greedy(block)
            assert W.unpack(words[at:end], escapes, len(block)).tolist() == block


def test_encoder_is_the_library(encoder, library):
    rng = random.Random(4)
    alphabet = ["abcdefgXYZ", "the rnionst ", "'s't're'll", "éàüßñÀÉ×÷ªºµ²¼", "日本語İſΣςǅ", "😀👍🏽́̀", " \t\n\r\x0b\x0c", "0123", "!?.-#&'", "​\x1c\x85\xa0\x00\x7f\xad", "<|endoftext|>"]
    for _ in range(6000):
        pool = rng.choices(alphabet, k=rng.randrange(1, 4))
        text = "".join(rng.choice(rng.choice(pool)) for _ in range(rng.randrange(40)))
        text += rng.choice(["", "", "", "<|endoftext|>x", " <|startoftext|>"])
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for code in range(0x3000):  # every character of the first planes in words and alone
        text = f"a{chr(code)}b {chr(code)} '{chr(code)}s1{chr(code)}"
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_bounded_memory_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(W, "ROOM", 5)
    for _, text in corpus():
        assert encoder.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_files(spark, library, tmp_path, monkeypatch):
    rows = corpus()
    path = str(tmp_path / "tokens")
    W.write_tokens(table(spark, rows).repartition(7), path)
    found = W.digests(spark, path).collect()
    want = sorted(((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, W.END]) for d, t in rows), key=lambda r: r[:2])
    got = sorted(found, key=lambda r: r["start"])
    assert [r["id"] for r in got] == [d if known else None for known, d, _ in want]
    start = 0
    for r in got:  # no gap: a document starts where the one before it ends
        assert r["start"] == start
        start += r["n"]
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda rows: sorted(rows, key=lambda x: (x[0] is not None, *(x[:1] if x[0] is not None else (0,)), *x[1:]))
    assert key((r["id"], r["n"], r["ids_crc32"]) for r in got) == key((d if known else None, len(ids), digest(ids)) for known, d, ids in want)
    tokens = W.read_tokens(spark, path).filter("id = 91").first()["tokens"]
    assert tokens == next(ids for known, d, ids in want if d == 91)


def test_empty_table(spark, tmp_path):
    W.write_tokens(empty(spark), str(tmp_path / "none"))
    assert W.digests(spark, str(tmp_path / "none")).isEmpty()
