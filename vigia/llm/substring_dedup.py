"""Substring deduplication with repeated-phrase automata.

A window (WINDOW consecutive words) is removed from a document if it also starts in a document with a
smaller id. Its method, linear in the text:

1. Seeds: of each window, the SEED-word phrase with the least hash. Equal windows have equal seeds, so a
   recurring window holds a recurring seed. Word-for-word copies are set aside first (equal digests).
   A seed that two documents hold is a recurring phrase; its words are taken from its owner, the smallest id.
2. The recurring phrases are dealt to shards of about PHRASES phrases, those of one owner together (a long
   owner's over several shards), and each shard is compiled to an Aho-Corasick automaton over words.
3. Documents are streamed through the automata in pieces of PIECE windows. A piece goes through the shards
   that own a seed of it and through no other, since it can't hold their phrases; so work grows with the
   text and not with text times shards. A shard with many occurrences is compiled for several tasks, which
   share its pieces. Phrases and pieces meet by one exchange, sorted so that a shard's phrases come first:
   a task holds one automaton and one batch.
4. A window is located where the automaton finds its seed, word for word. Located windows are confirmed
   across documents by seed and a 64-bit hash of the window, with the smallest id that holds them; the words
   they cover form the spans to remove. Consecutive windows of one seed travel as one row to the seed's
   task. Seeds of more than HOT documents go another way: their windows are reduced by (window, salt), then
   by window, and joined back with the salt, so that a window of very many documents spreads over tasks.

Only documents with a recurring phrase have their text shuffled (a run-time Bloom filter prunes the
rest). No list is longer than the document it belongs to.

Defined results: ids are integers; null and empty texts have no words; texts under WINDOW words lose none; a row with a
null id neither loses words nor makes others lose them; rows that share an id do not shorten each other;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import WordHashes, lists, mapped, prune_scans_at_run_time, run_hashes, sliding_min, stage, table

WINDOW, SEED = 50, 20
#: Documents that hold a seed, from which on its windows are not gathered in one task, and the salts of such windows.
HOT, SALTS = 1000, 64
#: Phrases of a shard (its automaton has at most SEED times as many nodes), and occurrences a task streams through it.
PHRASES, OCCURRENCES = 8192, 32768
#: Windows of a piece of a document.
PIECE = 1024


def _seeds_of_windows(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The seed hash of every window."""
    return sliding_min(run_hashes(words, seed), window - seed + 1)


def _tag(digest: bytes) -> int:
    """Tells texts of one id apart."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _scanned(window: int, seed: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            counts, digests, seeds = [], [], []
            for value in batch.column("t"):
                words = (value.as_py() or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                long = len(words) >= window
                seeds.append(np.unique(_seeds_of_windows(hashes.of(words), window, seed)).view(np.int64) if long else np.empty(0, np.int64))
            made = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_tag, digests), pa.int64()), lists(seeds, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "n", "digest", "tag", "seeds"])

    return run


_MEETING = "shard int, salt int, kind int, id long, tag long, start int, t binary, hot array<boolean>"
_MEETING_ARROW = pa.schema(
    [("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("t", pa.binary()), ("hot", pa.list_(pa.bool_()))]
)


def _routed(window: int, seed: int, piece: int):
    """Rows of the meeting of phrases and texts, by shard and salt: kind 0 has the recurring phrases that a text
    owns, one a line, and which of them are hot; kind 1 has a piece of the text and the word it starts at."""

    def phrases(words, own, routes):
        lines: dict[int, tuple[int, list, list]] = {}
        at = {int(h): k for k, h in reversed(list(enumerate(own)))} if any(r["owner"] for r in routes) else {}
        for r in routes:
            if r["owner"] and (k := at.get(r["seed"])) is not None:
                _, some, hot = lines.setdefault(r["shard"], (r["salts"], [], []))
                some.append(b" ".join(words[k : k + seed]))
                hot.append(r["hot"])
        for shard, (salts, some, hot) in lines.items():
            for salt in range(salts):
                yield shard, salt, 0, 0, b"\n".join(some), hot

    def pieces(words, key, routes, chance):
        shard_of = {r["seed"]: (r["shard"], r["salts"]) for r in routes}
        for a in range(0, len(key), piece):
            part = key[a : a + piece]
            text = b" ".join(words[a : a + len(part) + window - 1])
            for shard, salts in sorted({shard_of[s] for s in np.unique(part).tolist() if s in shard_of}):
                yield shard, (chance + a // piece) % salts, 1, a, text, None

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(batch.num_rows):
                words, routes = (batch.column("t")[k].as_py() or b"").split(), batch.column("routes")[k].as_py()
                if len(words) < window:
                    continue
                id, own, tag = batch.column("id")[k].as_py(), run_hashes(hashes.of(words), seed), _tag(hashlib.sha256(b" ".join(words)).digest())
                key = sliding_min(own, window - seed + 1).view(np.int64)
                rows = [*phrases(words, own.view(np.int64), routes), *pieces(words, key, routes, tag)]
                made = [{"shard": r[0], "salt": r[1], "kind": r[2], "id": id, "tag": tag, "start": r[3], "t": r[4], "hot": r[5]} for r in rows]
                yield pa.RecordBatch.from_pylist(made, _MEETING_ARROW)

    return run


class _Shard:
    """The automaton over the words of one shard's phrases."""

    def __init__(self, hashes: WordHashes, seed: int):
        self.hashes, self.seed, self.keys, self.hot, self.word_ids = hashes, seed, [], [], {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def add(self, phrases: bytes, hot: list[bool]) -> None:
        for phrase, is_hot in zip(phrases.split(b"\n"), hot, strict=True):
            words = phrase.split()
            letters = tuple(self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words)
            self.machine.add_word(letters, len(self.keys))  # a phrase given twice keeps its last number
            self.keys.append(run_hashes(self.hashes.of(words), self.seed)[0])
            self.hot.append(is_hot)

    def compile(self) -> None:
        self.machine.make_automaton()
        self.keys, self.hot = np.array(self.keys, np.uint64), np.array(self.hot, bool)

    def occurrences(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, phrase numbers) of every place in ``words`` where a phrase stands."""
        known = self.word_ids.get
        hits = list(self.machine.iter(tuple(known(w, 0) for w in words))) if len(self.machine) else []
        at = np.array(hits, np.int64).reshape(-1, 2)
        return at[:, 0] - (self.seed - 1), at[:, 1]


def _located(window: int, seed: int):
    """(id, tag, key, hot, start, wins) for each run of windows whose common seed a shard's automaton locates."""

    def run(batches):
        hashes, place, shard = WordHashes(), None, None
        none = np.uint64(2**64 - 1)
        for batch in batches:
            rows, tags, keys, hots, starts, wins = [], [], [], [], [], []
            for r in batch.to_pylist():
                if place != (r["shard"], r["salt"]):
                    place, shard, compiled = (r["shard"], r["salt"]), _Shard(hashes, seed), False
                if r["kind"] == 0:
                    shard.add(r["t"], r["hot"])
                    continue
                if not compiled:
                    shard.compile()
                    compiled = True
                words = r["t"].split()
                at, phrase = shard.occurrences(words)
                if not len(at):
                    continue
                w = hashes.of(words)
                hit, is_hot = np.full(len(words) - seed + 1, none), np.zeros(len(words) - seed + 1, bool)
                hit[at], is_hot[at] = shard.keys[phrase], shard.hot[phrase]
                key, hot_keys = _seeds_of_windows(w, window, seed), np.unique(hit[is_hot])
                found, win = sliding_min(hit, window - seed + 1) == key, run_hashes(w, window).view(np.int64)
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (found[1:] != found[:-1])) + 1
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
                    if found[a]:
                        rows.append(r["id"])
                        tags.append(r["tag"])
                        keys.append(key[a].astype(np.int64))
                        hots.append(bool(np.isin(key[a], hot_keys)))
                        starts.append(r["start"] + a)
                        wins.append(win[a:b])
            made = [pa.array(rows, pa.int64()), pa.array(tags, pa.int64()), pa.array(keys, pa.int64()), pa.array(hots, pa.bool_()), pa.array(starts, pa.int32()), lists(wins, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["id", "tag", "key", "hot", "start", "wins"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(window: int):
    """Window starts of a text -> disjoint covered spans."""

    def run(batches):
        for batch in batches:
            spans = []
            for starts in batch.column("starts"):
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                cut = np.flatnonzero(np.diff(at) > window)
                spans.append([{"start": int(a), "end": int(b) + window} for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(spans, _SPANS)], ["id", "tag", "spans"])

    return run


def _narrow(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n, digest, tag, seeds) per row: word count, SHA-256 of the words joined by one space, seeds."""
    return stage(mapped(_narrow(df, id, text), _scanned(window, seed), "id long, n long, digest binary, tag long, seeds array<long>"), "repeat-scan")


def _sharded(recurring: DataFrame) -> DataFrame:
    """``recurring`` with the shard of each phrase and the number of tasks (salts) that share the shard's texts."""
    shards = max(1, -(-recurring.count() // PHRASES))
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lo")) / PHRASES)
    dealt = recurring.withColumn("shard", F.pmod(F.xxhash64("lo", F.pmod(F.xxhash64("seed"), blocks)), F.lit(shards)).cast("int"))
    salts = dealt.groupBy("shard").agg(F.ceil(F.sum("n") / OCCURRENCES).cast("int").alias("salts"))
    return dealt.join(salts, "shard")


def repeated_spans(df: DataFrame, scanned: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, tag, spans) of the texts that lose words: sorted, disjoint word spans [start, end)."""
    long = scanned.filter((F.col("n") >= window) & F.col("id").isNotNull())
    first = stage(long.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")), "repeat-first")
    copies = long.join(first.filter("first < last").select("digest", "first"), "digest").filter("id > first")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    copies = copies.select("id", "tag", whole.alias("spans")).distinct()

    # Phrases that different texts share, then by document.
    held = long.join(first.select(F.col("first").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", F.explode("seeds").alias("seed"))
    held = stage(held, "repeat-held")
    recurring = held.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    recurring = stage(recurring.select("seed", "lo", "n"), "repeat-seeds")
    shards = stage(_sharded(recurring), "repeat-shards")
    route = F.struct("seed", "shard", "salts", (F.col("n") > HOT).alias("hot"), (F.col("id") == F.col("lo")).alias("owner"))
    wanted = held.join(prune_scans_at_run_time(shards).filter("n > 1"), "seed").groupBy("id").agg(F.collect_list(route).alias("routes"))
    wanted = stage(wanted, "repeat-wanted")
    docs = _narrow(df, id, text).join(prune_scans_at_run_time(wanted).filter(F.size("routes") > 0), "id")
    meeting = mapped(docs, _routed(window, seed, PIECE), _MEETING).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    located = stage(mapped(meeting, _located(window, seed), "id long, tag long, key long, hot boolean, start int, wins array<long>"), "repeat-located")

    def windows(runs: DataFrame) -> DataFrame:
        return runs.select("id", "tag", "key", "start", F.posexplode("wins").alias("pos", "win")).select("id", "tag", "key", "win", (F.col("start") + F.col("pos")).alias("start"))

    # A seed's runs meet in one task, whose partitioning also serves its windows: one exchange of compact rows.
    usual = windows(located.filter("NOT hot").drop("hot").repartition("key"))
    usual = usual.withColumn("lo", F.min("id").over(Window.partitionBy("key", "win"))).filter("id > lo")
    heated = windows(located.filter("hot")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    owners = heated.groupBy("key", "win", "salt").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    same = Window.partitionBy("key", "win")  # at most SALTS rows
    owners = owners.select("key", "win", "salt", F.min("lo").over(same).alias("lo"), F.max("hi").over(same).alias("hi")).filter("lo < hi").drop("hi")
    later = usual.unionByName(heated.join(owners, ["key", "win", "salt"]).filter("id > lo").drop("salt"))
    later = later.groupBy("id", "tag").agg(F.collect_list("start").alias("starts"))
    spans = mapped(later, _merged(window), "id long, tag long, spans array<struct<start:int,end:int>>")
    return stage(spans.join(copies, ["id", "tag"], "left_anti").unionByName(copies), "repeat-spans")


def _shortened(keep_others: bool):
    """Replaces t by its kept words (and n_removed) where ``spans`` (tag -> spans of the id) has the text."""

    def run(batches):
        for batch in batches:
            rows, kept, gone, tags = [], [], [], []
            for k in range(batch.num_rows):
                text, found, n_gone, tag = batch.column("t")[k].as_py(), batch.column("found")[k].as_py(), 0, None
                if found and text:
                    words = text.split()
                    tag = _tag(hashlib.sha256(b" ".join(words)).digest())
                    spans = next((x["spans"] for x in found if x["tag"] == tag), ())
                    for span in reversed(spans):
                        n_gone += span["end"] - span["start"]
                        del words[span["start"] : span["end"]]
                    text = b" ".join(words) if spans else text
                if n_gone or keep_others:
                    rows.append(k)
                    kept.append(text)
                    gone.append(n_gone)
                    tags.append(tag)
            rest = batch.drop_columns(["t", "found"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(tags, pa.int64())], [*rest.schema.names, "t", "n_gone", "tag"])

    return run


def _by_id(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.col("id").alias("span_id")).agg(F.collect_list(F.struct("tag", "spans")).alias("found"))


def removed(spans) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``df`` with the words of repeated windows taken out; texts that lose none stay as they are, null included.

    ``n_gone`` (words taken out) is added as the last column, in place of an own column of that name; a text
    that loses all words becomes empty.
    """
    df = df.drop("n_gone")
    spans = stage(_by_id(repeated_spans(df, scan(df, id, text, window, seed), id, text, window, seed)), "repeat-by-id")
    names = {c: f"_{k}" for k, c in enumerate(df.columns) if c != text}
    wide = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(text).cast("binary").alias("t"), F.col(id).cast("long").alias("join_id"))
    schema = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for c, n in names.items()) + "t binary, n_gone long, tag long"
    # Only texts that lose words meet their spans; the others are told by the stored ids alone.
    some = prune_scans_at_run_time(spans).filter(F.size("found") > 0)
    touched = mapped(wide.join(some, F.col("join_id") == F.col("span_id")).drop("join_id", "span_id"), _shortened(True), schema).drop("tag")
    others = wide.join(spans.select("span_id"), F.col("join_id") == F.col("span_id"), "left_anti").drop("join_id").withColumn("n_gone", F.lit(0).cast("long"))
    out = touched.unionByName(others)
    return out.select(*((F.col("t").cast("string") if c == text else F.col(names[c])).alias(c) for c in df.columns), "n_gone")


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scanned = scan(docs)
    spans = repeated_spans(docs, scanned)
    at = scanned.join(spans, ["id", "tag"], "left").withColumn("n_removed", F.coalesce(removed(F.col("spans")), F.lit(0).cast("long")))
    # Texts are read again only where some words go and some stay.
    part = stage(_by_id(at.filter("n_removed > 0 AND n_removed < n").select("id", "tag", "spans").distinct()), "repeat-part")
    part = prune_scans_at_run_time(part).filter(F.size("found") > 0).hint("merge")
    wide = _narrow(docs, "doc_id", "text").join(part, F.col("id") == F.col("span_id")).drop("span_id")
    kept = mapped(wide, _shortened(False), "id long, t binary, n_gone long, tag long").select("id", "tag", F.sha2("t", 256).alias("sha")).distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    sha = F.when(F.col("n_removed") == 0, F.lower(F.hex("digest"))).when(F.col("n_removed") == F.col("n"), nothing).otherwise(F.col("sha"))
    return at.join(kept, ["id", "tag"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", sha.alias("kept_sha256"))


def stage_substring_dedup(spark, docs, sf_dir):
    """Pipeline: repeated passages go from all but the first document that holds them; every document stays."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)
