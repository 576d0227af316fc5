"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode by a UTF-8 state machine.

Encoding. The encoding of a prefix of a piece is fixed by its last token: token ``t`` may end at a
position if it starts at a boundary whose own last token is compatible with ``t`` (the two tokens' bytes
together encode to just these two). A transducer state holds the bytes not yet emitted, the last token
of each boundary that some longer token can still start from, and the token before them. Reading a byte
moves to the next state and emits the tokens on which all open boundaries agree, so a token leaves after
a lookahead bounded by the longest vocabulary entry that could still cover it. States and moves are made when
first met and kept in a bounded table; pieces (matches of the split pattern) are remembered too.

Decoding. Each id's bytes run through a table-driven UTF-8 automaton whose state survives any cut of the
id stream; the move of an id from a state (next state, text it completes) is remembered. Ill-formed bytes
give U+FFFD, one per maximal bad prefix; unknown ids raise KeyError.

Defined results: null and empty texts have no ids; repeated rows are encoded each; other columns stay.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import mapped, table, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what a worker remembers (states, pieces): about 260 MB, or 140 MB where memory is shared with more.
ROOM, SMALL_ROOM = (300_000, 400_000), (60_000, 80_000)
LONGEST_KEPT_PIECE = 40


def read_ranks(path: str) -> bytes:
    """The rank file's content; the driver ships it, so executors need no local copy (0.8 MB)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class MergeTransducer(dict):
    """piece (str) -> its ids, packed as 32-bit integers. A dict so that remembered pieces cost one lookup.

    A state is the set of readings still open: for each boundary from which a vocabulary entry may go
    on, (trie node of the bytes since it, last token before it, tokens up to it not yet emitted), the
    longest first; the last item is the boundary at the present byte.
    """

    def __init__(self, ranks: dict[bytes, int], room: tuple[int, int] = ROOM):
        super().__init__()
        self.ranks = ranks
        self.max_states, self.max_pieces = room
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        self.token_at, self.inner = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                at = node << 8 | byte
                if (to := self.child.get(at)) is None:
                    to = self.child[at] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                node = to
            self.token_at[node] = rank
        self.spines: dict[int, tuple | None] = {}
        self.compatible: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}  # state -> its number
        self.states: list[tuple] = []
        self.moves: dict[int, tuple] = {}  # number * 256 + byte -> (number, tokens emitted)
        self.asked = bytearray(1 << 22)  # hashes of moves asked for once: only a second request keeps a move
        self._keep(((0, -1, ()),))

    def _keep(self, items: tuple) -> int:
        if (n := self.number.get(items)) is None:
            n = self.number[items] = len(self.states)
            self.states.append(items)
        return n

    def _spine(self, token: int) -> tuple | None:
        """How a token is merged: its parts along the left and the right edge, each with the rank at which
        it is taken into the next larger one. None if merging its bytes never gives the token."""
        if token in self.spines:
            return self.spines[token]
        parts, split = [bytes((b,)) for b in self.bytes_of[token]], None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            split = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        own = (self.bytes_of[token], 1 << 60)
        if len(parts) > 1:
            spine = None
        elif split is None:
            spine = ([own], [own])
        else:
            spine = tuple([own, (split[k], token), *self._spine(self.ranks[split[k]])[k][1:]] for k in (0, 1))
        self.spines[token] = spine
        return spine

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border: one would join a part at the right edge of ``before`` and
        one at the left edge of ``token`` while both exist (of equal ranks the left one goes first)."""
        if len(self.compatible) > 4 * self.max_states:
            self.compatible.clear()
        after = self._spine(token)
        left, right, apart = self._spine(before)[1], after[0] if after else (), after is not None
        rank_of = self.ranks.get
        for x, taken_x in left:
            for y, taken_y in right:
                r = rank_of(x + y)
                if r is not None and r < taken_x and r <= taken_y:
                    apart = False
                    break
            if not apart:
                break
        self.compatible[before << 20 | token] = apart
        return apart

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after a byte, and the tokens that this settles."""
        items, ended = [], None
        child, token_at, inner = self.child.get, self.token_at, self.inner
        for node, last, out in state:
            to = child(node << 8 | byte)
            if to is None:
                continue
            if ended is None:
                token = token_at[to]
                if token >= 0:
                    fits = self._spine(token) is not None if last < 0 else self.compatible.get(last << 20 | token)
                    if fits or fits is None and self._may_follow(last, token):
                        ended = (0, token, (*out, token))
            if inner[to]:
                items.append((to, last, out))
        if not items:  # settled up to here
            return ((0, ended[1], ()),), ended[2]
        items.append(ended)
        first = items[0][2]
        if not first:
            return tuple(items), ()
        n = 0  # emit what all open readings agree on
        for token in first:
            for _, _, out in items:
                if len(out) <= n or out[n] != token:
                    break
            else:
                n += 1
                continue
            break
        return tuple([(a, b, out[n:]) for a, b, out in items]), first[:n]

    def _move(self, at: int, byte: int) -> tuple:
        key = at << 8 | byte
        state, emitted = self._step(self.states[at], byte)
        bit = key * 0x9E3779B1 >> 7 & 0x3FFFFF
        if not self.asked[bit]:
            self.asked[bit] = 1
            return state, emitted
        move = self.moves[key] = (self._keep(state), emitted)
        return move

    def transduce(self, data: bytes) -> list[int]:
        """Ids of one piece, each taken as soon as it is settled. A state is a number, if kept, or its items."""
        at, out, known, number = 0, [], self.moves.get, self.number.get
        for byte in data:
            if at.__class__ is int:
                at, emitted = known(at << 8 | byte) or self._move(at, byte)
            else:
                at, emitted = self._step(at, byte)
            if at.__class__ is tuple:
                at = number(at, at)
            if emitted:
                out += emitted
        out += (self.states[at] if at.__class__ is int else at)[-1][2]
        if len(self.states) > self.max_states:
            self._forget()
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.ranks.get(data)  # a piece that is itself an entry stays whole
            ids = array("i", (whole,) if whole is not None else self.transduce(data)).tobytes()
        if len(piece) <= LONGEST_KEPT_PIECE:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        """Bound what is remembered: two generations of pieces, the older one without those not met again."""
        if len(self) > self.max_pieces:
            self.older = dict(self)
            self.clear()


def _utf8_classes() -> dict[str, dict[int, str]]:
    """Well-formed UTF-8 as an automaton: state -> byte -> state ('' is the start, between characters)."""
    tail, moves = range(0x80, 0xC0), {s: {} for s in ("", "1", "2", "3", "E0", "ED", "F0", "F4")}
    for lead, to in ((range(0x00, 0x80), ""), (range(0xC2, 0xE0), "1"), (range(0xE1, 0xF0), "2"), (range(0xF1, 0xF4), "3")):
        moves[""] |= dict.fromkeys(lead, to)
    moves[""] |= {0xE0: "E0", 0xED: "ED", 0xF0: "F0", 0xF4: "F4"}  # leads whose second byte is restricted
    for s, seconds, to in (("1", tail, ""), ("2", tail, "1"), ("3", tail, "2"), ("E0", range(0xA0, 0xC0), "1"), ("ED", range(0x80, 0xA0), "1"), ("F0", range(0x90, 0xC0), "2"), ("F4", range(0x80, 0x90), "2")):
        moves[s] |= dict.fromkeys(seconds, to)
    return moves


class _Moves(dict):
    """id -> (next moves, text) from one UTF-8 state with its held bytes."""

    def __init__(self, machine: Utf8Decoder, state: str, held: bytes):
        super().__init__()
        self.machine, self.state, self.held = machine, state, held

    def __missing__(self, token: int) -> tuple[_Moves, str]:
        move = self[token] = self.machine.step(self.state, self.held, self.machine.bytes_of[token])
        return move


class Utf8Decoder:
    """Incremental decoder of id streams; a character cut between ids or chunks is held until complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.table, self.nodes = bytes_of, _utf8_classes(), {}
        self.start = self.node("", b"")

    def node(self, state: str, held: bytes) -> _Moves:
        if (state, held) not in self.nodes:
            if len(self.nodes) > 4096:
                self.nodes.clear()
            self.nodes[state, held] = _Moves(self, state, held)
        return self.nodes[state, held]

    def step(self, state: str, held: bytes, data: bytes) -> tuple[_Moves, str]:
        out, done = [], bytearray()
        for byte in data:
            to = self.table[state].get(byte)
            if to is None and state:  # the held prefix can't go on: replace it, read the byte anew
                out += [done.decode(), "�"]
                done, held, state = bytearray(), b"", ""
                to = self.table[""].get(byte)
            if to is None:
                out += [done.decode(), "�"]
                done = bytearray()
            elif to == "":
                done += held + bytes((byte,))
                held, state = b"", ""
            else:
                held, state = held + bytes((byte,)), to
        return self.node(state, held), "".join([*out, done.decode()])

    def decode(self, ids: Iterable[int]) -> str:
        at, out = self.start, []
        for token in ids:
            at, piece = at[token]
            out.append(piece)
        return "".join(out) + "�" * bool(at.held)


class Codec:
    def __init__(self, content: bytes, pattern: str, room: tuple[int, int] = ROOM):
        self.split = regex.compile(pattern).findall
        self.pieces = MergeTransducer(parse_ranks(content), room)
        self.decoder = Utf8Decoder(self.pieces.bytes_of)

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit integers one after another."""
        self.pieces.trim()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.decode(ids)


_codecs: dict[tuple, Codec] = {}


def codec(content: bytes, pattern: str, room: tuple[int, int]) -> Codec:
    """One codec per Python worker: its tables serve all batches and tasks.

    The small one, for workers that serve other operators too, goes with its task.
    """
    if room == SMALL_ROOM:
        _codecs.clear()
        return Codec(content, pattern, room)
    if (content, pattern, room) not in _codecs:
        _codecs.clear()
        _codecs[content, pattern, room] = Codec(content, pattern, room)
    return _codecs[content, pattern, room]


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _map(df: DataFrame, schema: str, work: Callable[[Codec, pa.RecordBatch], dict[str, pa.Array]], path: str | None, pattern: str, room: tuple[int, int] = ROOM) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    def run(batches):
        own = codec(shipped.value, pattern, room)
        for batch in batches:
            for part in range(0, batch.num_rows, 64):  # keeps the Python objects of few rows alive
                rows = batch.slice(part, 64)
                made = work(own, rows)
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n not in made), *made.values()], [*(n for n in rows.schema.names if n not in made), *made])

    return mapped(df, run, schema)


def _schema(df: DataFrame, **new: str) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in new) + "".join(f", {n} {t}" for n, t in new.items())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with an array column of token ids (an own column of that name is replaced)."""
    return _map(df, _schema(df, **{ids: "array<int>"}), lambda c, b: {ids: _lists([c.packed(t) for t in texts(b.column(text))])}, path, pattern)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that its id column stands for (null ids: empty)."""
    return _map(df, _schema(df, **{text: "string"}), lambda c, b: {text: pa.array([c.decode(x.as_py() or ()) for x in b.column(ids)], pa.string())}, path, public_tokenizers.PATTERN)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN, room: tuple[int, int] = ROOM) -> DataFrame:
    """encode() and decode() of the ids in one pass over the rows."""

    def both(c: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [c.packed(t) for t in texts(batch.column(text))]
        return {ids: _lists(made), decoded: pa.array([c.decode(array("i", x)) for x in made], pa.string())}

    return _map(df, _schema(df, **{ids: "array<int>", decoded: "string"}), both, path, pattern, room)


def digests(df: DataFrame) -> list:
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op4(spark, sf_dir):
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", *digests(coded))


def stage_encode(spark, docs, sf_dir):
    """Pipeline: the kept documents with their token ids."""
    coded = round_trip(docs, room=SMALL_ROOM)
    return coded.select(*docs.columns, *digests(coded), "ids")
