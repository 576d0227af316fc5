"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed rows of the word, its first three to five letters and its
last four, so unseen forms of a known stem have a meaning. Filters of one to three words run over the
whole text; each keeps its maximum, and a logistic unit turns the maxima into a score. Embeddings start
from the smoothed log-odds of their rows among training documents and are fitted with the filters by
Adagrad. All labelled documents that were neither fitted nor held out calibrate the score (so that 0.3 is
a sensible global cut) and one threshold per language: they are scored in Spark, whole and at any length,
and counted by score bin, label and language; the driver gets these counts.

Only the fit has a bounded sample: at most ROWS_PER_CLASS labelled documents of each class, the least by a
hash of the id, none over TRAIN_CHARS characters, a CALIBRATION_SHARE of which is not fitted. Scoring reads
whole texts of all documents; the model has a fixed size and is broadcast.

A language needs LEAST_FOR_LANGUAGE calibrating documents of each class, else it has the global threshold.
While a class has no more labels than the sample takes, those documents are a CALIBRATION_SHARE of them. Labels, language, source and id are never inputs of a score; the
language only chooses the threshold.

Defined results: null and empty texts get the score of no words; labels that are null, held out or
without a document are not learned from; without labels of both classes every score is 0; where the
documents not fitted lack a class, the fitted ones calibrate; a null or
unseen language has the global threshold; repeated rows score alike; extra columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import mapped, stage, table

ROWS_PER_CLASS, TRAIN_CHARS, EPOCHS = 2500, 20_000, 4
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
GLOBAL_THRESHOLD, CALIBRATION_SHARE, LEAST_FOR_LANGUAGE = 0.3, 0.2, 15
#: Bins a unit of the score's logit, and the logit's limits: at most so many counts a language.
BINS, LIMIT = 16, 30
_WORDS = re.compile(r"\w+").findall
_BLOCKS = sum(WIDTHS)
_GRAMS = 5


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def grams(word: str) -> tuple[int, ...]:
    """Rows of the embedding table that make up a word."""
    parts = (f"={word}", f"<{word[:3]}", f"<{word[:4]}", f"<{word[:5]}", f"{word[-4:]}>")
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: np.ndarray  # DIM x (_BLOCKS * FILTERS): a block for each width and place in it
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    empty: bool = False
    fitted: list[int] = field(default_factory=list)  # places in the sample

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, positions x FILTERS. ``x`` ends in three rows of zeros, so each width has a position."""
        z, block, out = x @ self.filters, 0, []
        for width in WIDTHS:
            n = len(x) - width + 1
            h = z[:n, block * FILTERS : (block + 1) * FILTERS]
            for j in range(1, width):
                h = h + z[j : j + n, (block + j) * FILTERS : (block + j + 1) * FILTERS]
            out.append(h)
            block += width
        return out

    def logit(self, maxima: np.ndarray) -> float:
        return float(np.maximum(maxima + self.bias, 0) @ self.out) + float(self.offset)

    def chance(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -LIMIT, LIMIT))))

    def score(self, maxima: np.ndarray) -> float:
        return 0.0 if self.empty else self.chance(self.logit(maxima))


class Vocabulary(dict):
    """word -> row of a bounded matrix of word embeddings."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.fresh = model, []
        self.rows = np.zeros((self.LIMIT, DIM), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def embed(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh:
            ids = np.array([grams(w) for w in self.fresh], np.int32)
            self.rows[len(self) - len(ids) : len(self)] = self.model.table[ids].sum(1)
            self.fresh = []
        return self.rows[at]


_PIECE = 8192


def maxima_of(model: Model, vocabulary: Vocabulary, words: list[str]) -> np.ndarray:
    """Largest response of every filter over a whole text, in overlapping pieces of bounded size."""
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    for k in range(0, max(1, len(words)), _PIECE):
        x = vocabulary.embed(words[k : k + _PIECE + max(WIDTHS) - 1])
        if k + _PIECE >= len(words):
            x = np.vstack([x, np.zeros((3, DIM), np.float32)])
        np.maximum(best, np.concatenate([h.max(0) for h in model.responses(x)]), out=best)
    return best


def _log_odds(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each table row between toxic and other documents."""
    counts = np.ones((2, BUCKETS))
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y), np.unique(ids)] += 1
    n = np.bincount(labels.astype(int), minlength=2) + 2
    return np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])


def fit(texts: list[str], labels: list[int], languages: list[str | None], weights: tuple[float, float] = (1.0, 1.0), epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Model from a labelled sample; ``weights`` undo the sampling of the classes (clean, toxic)."""
    rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
    filters = rng.normal(0, 0.2, (DIM, _BLOCKS * FILTERS)).astype(np.float32)
    model = Model(rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), filters, np.full(len(WIDTHS) * FILTERS, -0.1, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), -1.0)
    if not 0 < y.sum() < len(y):
        model.empty = True
        return model
    known: dict[str, tuple[int, ...]] = {}
    rows = []
    for t in texts:
        ids = [known.get(w) or known.setdefault(w, grams(w)) for w in words_of(t)]
        rows.append(np.array(ids, np.int32).reshape(-1, _GRAMS))
    del known
    held = rng.random(len(y)) < CALIBRATION_SHARE
    if not all(0 < y[part].sum() < part.sum() for part in (held, ~held)):
        held[:] = False
    train = np.flatnonzero(~held)
    model.fitted = train.tolist()
    model.table[:, 0] = _log_odds([rows[k] for k in train], y[train]) / _GRAMS
    model.filters[0, ::FILTERS] = 1 / np.repeat(WIDTHS, WIDTHS)  # one filter of each width reads the log-odds
    model.bias[::FILTERS], model.out[:] = -1.0, 0.1

    parts = [model.table, model.filters, model.bias, model.out]
    seen = [np.full_like(p, 1e-2) for p in parts]
    rate = (0.02, 0.02, 0.05, 0.1)
    offset_seen = 1e-2

    def step(k: int, values: np.ndarray, g: np.ndarray, at=...) -> None:
        seen[k][at] += g * g
        values[at] -= rate[k] * g / np.sqrt(seen[k][at])

    for _ in range(epochs):
        for d in rng.permutation(train):
            ids = rows[d]
            x = np.vstack([model.table[ids].sum(1), np.zeros((3, DIM), np.float32)])
            h = model.responses(x)
            top = [r.argmax(0) for r in h]
            pre = np.concatenate([r[t, np.arange(FILTERS)] for r, t in zip(h, top, strict=True)]) + model.bias
            act = np.maximum(pre, 0)
            g = 1 / (1 + np.exp(-np.clip(act @ model.out + model.offset, -30, 30))) - y[d]
            if abs(g) < 0.01:
                continue
            d_act = (g * model.out * (pre > 0)).astype(np.float32)
            d_filters, touched, d_rows, block = np.zeros_like(model.filters), [], [], 0
            for w, width in enumerate(WIDTHS):
                own = d_act[w * FILTERS : (w + 1) * FILTERS]
                for j in range(width):
                    at, cols = top[w] + j, slice((block + j) * FILTERS, (block + j + 1) * FILTERS)
                    d_filters[:, cols] = x[at].T * own
                    real = np.flatnonzero((at < len(ids)) & (own != 0))
                    touched.append(ids[at[real]].ravel())
                    d_rows.append(np.repeat((model.filters[:, cols].T * own[:, None])[real], _GRAMS, 0))
                block += width
            step(3, model.out, (g * act).astype(np.float32))
            step(2, model.bias, d_act)
            step(1, model.filters, d_filters)
            if len(flat := np.concatenate(touched)):
                own_rows, place = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(own_rows), DIM), np.float32)
                np.add.at(grad, place, np.concatenate(d_rows))
                step(0, model.table, grad, own_rows)
            offset_seen += g * g
            model.offset -= 0.1 * g / np.sqrt(offset_seen)

    part = np.flatnonzero(held) if held.any() else train
    _calibrate(model, [texts[k] for k in part], y[part], [languages[k] for k in part], weights)
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray, languages: list[str | None], weights: tuple[float, float]) -> None:
    """Scale and thresholds from a sample in the driver: what holds where no other labels are known."""
    vocabulary = Vocabulary(model)
    raw = np.array([model.logit(maxima_of(model, vocabulary, words_of(t))) for t in texts])
    y = y.astype(np.float64)
    _scale(model, raw, 1 - y, y, weights)
    for language in {x for x in languages if x}:
        own = np.array([x == language for x in languages])
        _cut(model, language, raw[own], 1 - y[own], y[own], weights)


def _scale(model: Model, raw: np.ndarray, clean: np.ndarray, toxic: np.ndarray, weights: tuple[float, float]) -> None:
    """Platt scaling with the classes' natural weights, from how many rows of each class have a logit."""
    goals = 1 / (clean.sum() + 2), 1 - 1 / (toxic.sum() + 2)
    w, goal = np.concatenate([weights[0] * clean, weights[1] * toxic]), np.repeat(goals, len(raw))
    raw, a, b = np.tile(raw, 2), 1.0, 0.0
    for _ in range(50):  # Newton steps, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -LIMIT, LIMIT)))
        g = np.array([(w * (p - goal) * raw).sum(), (w * (p - goal)).sum()])
        q = w * p * (1 - p)
        hess = np.array([[(q * raw * raw).sum(), (q * raw).sum()], [(q * raw).sum(), q.sum()]]) + np.eye(2) * 1e-3 * w.sum()
        move = np.linalg.solve(hess, g)
        a, b = a - move[0], b - move[1]
    model.scale, model.shift = float(max(a, 1e-3)), float(b)


def _cut(model: Model, language: str, low: np.ndarray, clean: np.ndarray, toxic: np.ndarray, weights: tuple[float, float]) -> None:
    """The best cut of a language with enough rows, from the rows of each class in bins with these least logits."""
    if min(toxic.sum(), clean.sum()) < LEAST_FOR_LANGUAGE:
        return
    p, bad, all_ = np.array([model.chance(x) for x in low]), weights[1] * toxic, weights[0] * clean + weights[1] * toxic
    # The F1 of each cut; among equal ones the cut nearest to the global threshold.
    cuts = [*np.unique(p), GLOBAL_THRESHOLD]
    f1 = [2 * bad[p >= c].sum() / max(1e-9, all_[p >= c].sum() + bad.sum()) for c in cuts]
    best = max(f1)
    model.thresholds[language] = float(min((c for c, f in zip(cuts, f1, strict=True) if f > best - 1e-9), key=lambda c: abs(c - GLOBAL_THRESHOLD)))


def _calibrate_on(model: Model, texts: DataFrame, usable: DataFrame, counts: dict[int, int]) -> None:
    """Scale and thresholds from all texts (label_id, t, g) with a label in ``usable`` (label_id, y)."""
    # Logits, not texts, meet the labels: no text is shuffled.
    raw = score(texts, model, text="t", name="raw", raw=True).select("label_id", "g", "raw")
    known = stage(raw.join(usable, "label_id").select("g", "y", "raw"), "toxic-raw")

    def cells(*keys):
        toxic = F.sum(F.col("y").cast("long"))
        return known.groupBy(*keys).agg(F.min("raw").alias("low"), F.avg("raw").alias("mean"), (F.count(F.lit(1)) - toxic).alias("clean"), toxic.alias("toxic"))

    def arrays(got, *names):
        return [np.array([r[k] for r in got], np.float64) for k in names]

    # Sixteen times finer than the bins of the cuts, as the scale isn't known yet.
    total = cells(F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("raw"))) * BINS * 16).alias("bin")).collect()
    mean, clean, toxic = arrays(total, "mean", "clean", "toxic")
    if not (clean.sum() and toxic.sum()):
        return
    weights = counts[0] / clean.sum(), counts[1] / toxic.sum()
    _scale(model, mean, clean, toxic, weights)
    model.thresholds = {}
    enough = cells("g").filter((F.col("clean") >= LEAST_FOR_LANGUAGE) & (F.col("toxic") >= LEAST_FOR_LANGUAGE) & (F.col("g") != "")).select("g")
    z = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("raw") * model.scale + model.shift))
    # The global threshold is a bin's edge too.
    split = (z >= float(np.log(GLOBAL_THRESHOLD / (1 - GLOBAL_THRESHOLD)))).alias("over")
    languages: dict[str, list] = {}
    for r in cells("g", F.floor(z * BINS).alias("bin"), split).join(enough, "g", "left_semi").collect():
        languages.setdefault(r["g"], []).append(r)
    for language, got in languages.items():
        _cut(model, language, *arrays(got, "low", "clean", "toxic"), weights)


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", rows: int = ROWS_PER_CLASS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of ``labels`` (id, label) that is not held out, calibrate on all the others."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("label_id")).agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("label_id", F.lit(11)), F.col("label_id")]
    chosen = usable.filter("y = 0").orderBy(*order).limit(rows).unionByName(usable.filter("y = 1").orderBy(*order).limit(rows))
    # At most 2 * rows ids: the broadcast has a fixed bound.
    texts = docs.select(F.col(id).alias("label_id"), F.col(text).alias("t"), F.col(lang).alias("g"))
    sample = texts.filter(F.coalesce(F.length("t"), F.lit(0)) <= chars)
    # One text an id before anything reaches the driver, however often the id stands in ``docs``.
    sample = sample.join(F.broadcast(chosen), "label_id").groupBy("label_id", "y").agg(F.max(F.struct("t", "g")).alias("x"))
    sample = sample.select("label_id", "y", "x.t", "x.g").orderBy("label_id").toArrow().to_pylist()
    n = [sum(r["y"] == k for r in sample) for k in (0, 1)]
    weights = tuple(counts.get(k, 0) / max(1, n[k]) for k in (0, 1))
    model = fit([r["t"] for r in sample], [r["y"] for r in sample], [r["g"] for r in sample], weights)
    if not model.empty:
        fitted = docs.sparkSession.createDataFrame([(sample[k]["label_id"],) for k in model.fitted], texts.select("label_id").schema)
        _calibrate_on(model, texts.filter(~held_out("label_id")), usable.join(F.broadcast(fitted), "label_id", "left_anti"), counts)
    return model


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score", raw: bool = False) -> DataFrame:
    """``df`` with the toxicity score (or the logit before scaling) of each whole text as its last column, in place of one of that name."""
    df = df.select(*(c for c in df.columns if c != name or c == text))
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    inner = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", s double"

    def run(batches: Iterator[pa.RecordBatch]):
        own = shipped.value
        vocabulary, of = Vocabulary(own), own.logit if raw else own.score
        for batch in batches:
            scores = [of(maxima_of(own, vocabulary, words_of(t.as_py()))) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "s"])

    return mapped(inner, run, schema).toDF(*df.columns, name)


def threshold(model: Model, lang: str = "lang"):
    """The threshold of a row's language."""
    known = F.lit(None).cast("double")
    for language, cut in sorted(model.thresholds.items()):
        known = F.when(F.col(lang) == language, F.lit(cut)).otherwise(known)
    return F.coalesce(known, F.lit(GLOBAL_THRESHOLD))


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GLOBAL_THRESHOLD).cast("int").alias("predicted"), threshold(model).alias("lang_threshold"), (F.col("score") >= threshold(model)).alias("toxic_for_language"))


def stage_toxicity(spark, docs, sf_dir):
    """Pipeline: documents at or over their language's threshold go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    at = f"score_{len(docs.columns)}"
    return score(docs, model, name=at).filter(F.col(at) < threshold(model)).select(*docs.columns)
