"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a run of words across line breaks. A template of n words has the span s, the least power of two
that is n or more; its blocks are the runs of 2 s words that start at multiples of s, so every run of s words
lies whole in one of them, however its lines are wrapped. A template is found in a block that holds
at least CONTAINMENT of its distinct words and all of its ``needs``, the words that tell it from other
licenses: without them a notice that shares the usual words gets no label.

The join is exact and follows the prefix, length and positional filters: words are ordered by how many blocks
hold them, rarest first; a block and a template that share at least ``need`` words share one among the
first size - need + 1 of each, at positions that leave enough words to come. Only words of some template
count, so a block is reduced to these before anything is shuffled; the frequency table has one row per
template word and the inverted index a few rows per template (fixed sizes). Every document takes part: its blocks
of a span are made where it holds enough words of one of the span's templates, which is the join's own threshold
(a block holds no more than its document). ``needs`` are tested on the links that the join has found, and on
nothing before; a template may have none.

Native DataFrame work. Words are runs of digits, letters and everything beyond ASCII, in lower case.

Defined results: null and empty texts have no words, places, labels and score 0; rows that share an id and
a text share their result; a phrase's places are counted at every start; a notice may get the labels of two
templates (the notices of the lesser and the Affero license hold the words of the general one); an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import stage, table


class Template(NamedTuple):
    label: str
    text: str
    #: Words that a block must hold.
    needs: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def span(self) -> int:
        return 1 << (len(self.text.split()) - 1).bit_length()

    def need(self, containment: float) -> int:
        return ceil(containment * len(self.words) - 1e-9)


#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short statements and standard notices of public licenses.
TEMPLATES = (
    Template("mit", "released under the mit license", ("license", "mit")),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("sublicense", "hereby", "granted", "charge"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("hereby", "granted", "fee"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache", "2")),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
        ("apache", "2", "compliance"),
    ),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "3")),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        ("gnu", "general", "redistribute", "3"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or at your option any later version",
        ("gnu", "general", "redistribute", "2"),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("noncommercial", "creative", "commons")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license", ("sharealike", "creative", "commons")),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution", "binary", "forms"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
        ("mozilla", "2"),
    ),
    Template("proprietary", "copyright all rights reserved no part may be reproduced without written permission", ("reserved", "reproduced")),
)
CONTAINMENT = 0.8
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BREAK = _SEPARATOR + "+"


def spaced(text: Column) -> Column:
    """The words with one blank before, between and after them (a lone blank if there are none).

    ``lower`` also lowers letters beyond ASCII; none of them becomes an ASCII letter of a phrase.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), _BREAK, " ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(df: DataFrame, words: str, phrases: dict[str, str]) -> DataFrame:
    """Adds n_base, first_word, last_word and base (array of labels) for a column made by spaced()."""
    w, n = F.col(words), _blanks(F.col(words)) - 1
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        has = F.col(words).contains(f" {phrase} ")
        # Only the blank before a place is taken, so a place that begins inside another one counts.
        parts = F.split(w, f" (?={phrase} )")
        counts.append(F.when(has, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(has, _blanks(parts[0])))
        lasts.append(F.when(has, n - _blanks(F.element_at(parts, -1))))
        labels.append(F.when(has, F.lit(label)))

    def known(values, choose):
        return choose(*values) if len(values) > 1 else values[0]

    return df.withColumns({
        "n_base": sum(counts, F.lit(0)).cast("long"),
        "first_word": known(firsts, F.least).cast("long"),
        "last_word": known(lasts, F.greatest).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    })


def template_blocks(blocks: DataFrame, words: str = "words", templates: tuple[Template, ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``blocks`` joined with every template of their span that they contain: adds label and containment.

    ``words`` is an array column, ``span`` the span whose templates a block is meant for.
    """
    spark = blocks.sparkSession
    spans = sorted({t.span for t in templates})
    vocabulary = {s: sorted({w for t in templates if t.span == s for w in t.words}) for s in spans}
    least = {s: min(t.need(containment) for t in templates if t.span == s) for s in spans}

    def by_span(value):
        pick = F
        for s in spans:
            pick = pick.when(F.col("span") == s, value(s))
        return pick

    held = blocks.withColumn("held", by_span(lambda s: F.array_intersect(F.col(words), F.array(*map(F.lit, vocabulary[s])))))
    held = held.filter(F.size("held") >= by_span(lambda s: F.lit(least[s])))
    # One row per span and template word at most.
    counts = {(r["span"], r["t"]): r["n"] for r in held.select("span", F.explode("held").alias("t")).groupBy("span", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {s: sorted(vocabulary[s], key=lambda t: (counts.get((s, t), 0), t)) for s in spans}
    index = []
    for t in templates:
        place = {w: k for k, w in enumerate(order[t.span])}
        ranked, need = sorted(t.words, key=place.__getitem__), t.need(containment)
        index += [(w, t.span, t.label, ranked, at, need, list(t.needs)) for at, w in enumerate(ranked[: len(ranked) - need + 1])]
    index = F.broadcast(spark.createDataFrame(index, "token string, span int, label string, template array<string>, at int, need int, needs array<string>"))

    ranked = held.withColumn("held", by_span(lambda s: F.array_intersect(F.array(*map(F.lit, order[s])), F.col("held"))))
    prefix = ranked.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - by_span(lambda s: F.lit(least[s])) + 1)).alias("pos", "token"))
    enough = (F.size("held") >= F.col("need")) & (F.least(F.size("template") - F.col("at"), F.size("held") - F.col("pos")) >= F.col("need"))
    shared = F.size(F.array_intersect("template", "held"))
    linked = prefix.join(index, ["token", "span"]).filter(enough).withColumn("shared", shared).filter("shared >= need")
    found = linked.filter(F.size(F.array_except("needs", "held")) == 0)
    return found.withColumn("containment", F.col("shared") / F.size("template")).drop("held", "pos", "token", "template", "at", "need", "needs", "shared")


def blocks_of(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id, h, span, block, words): the template words in each block of ``docs`` (id, h, w made by spaced()).

    A span's blocks are made of the documents that hold as many words of one of its templates as a link needs.
    """
    spark = docs.sparkSession
    tokens = sorted({(w, t.span) for t in templates for w in t.words})
    every = F.array(*(F.lit(w) for w in sorted({w for w, _ in tokens})))
    tokens = F.broadcast(spark.createDataFrame(tokens, "token string, span int"))
    held = docs.select("id", "h", "w", F.array_intersect(F.split(F.trim("w"), " "), every).alias("held"))
    enough = (F.size(F.array_intersect("held", F.array(*map(F.lit, t.words)))) >= t.need(containment) for t in templates)
    spans = F.array_distinct(F.array_compact(F.array(*(F.when(e, F.lit(t.span)) for e, t in zip(enough, templates, strict=True)))))
    # Outer: for a plain explode Spark infers a filter for which it would make ``held`` once a template.
    each = held.select("id", "h", "w", F.explode_outer(spans).alias("span")).filter(F.col("span").isNotNull())
    words = each.select("id", "h", "span", F.posexplode_outer(F.split(F.trim("w"), " ")).alias("pos", "token"))
    placed = words.join(tokens, ["token", "span"])
    own = F.floor(F.col("pos") / F.col("span"))
    in_blocks = placed.select("id", "h", "span", "token", F.explode(F.array(own, own - 1)).alias("block")).filter("block >= 0")
    return in_blocks.groupBy("id", "h", "span", "block").agg(F.collect_set("token").alias("words"))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_labels) for every row."""
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("t"))
    h = F.xxhash64("t")
    based = docs.select("id", h.alias("h"), spaced(F.col("t")).alias("w"))
    based = phrase_places(based, "w", phrases).withColumn("n_words", (_blanks(F.col("w")) - 1).cast("long")).drop("w")
    texts = docs.select("id", h.alias("h"), spaced(F.col("t")).alias("w"))
    blocks = stage(blocks_of(texts, templates), "license-blocks")
    found = template_blocks(blocks, "words", templates).groupBy("id", "h").agg(F.collect_set("label").alias("made"), F.max("containment").alias("best"))
    found = found.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "made", "best")
    out = based.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    made = F.coalesce("made", F.array().cast("array<string>"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return out.select(F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", made)).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), joined(made).alias("template_labels"))


def op5(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


_SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_PLACES = " UNION ALL ".join(f"SELECT '{p}' AS phrase, '{label}' AS label, {len(p.split())} AS size" for p, label in PHRASES.items())
_SQL_TEMPLATES = " UNION ALL ".join(
    f"SELECT '{t.label}' AS label, {t.span} AS span, string_split('{' '.join(t.words)}', ' ') AS tw, string_split('{' '.join(t.needs)}', ' ') AS needs" for t in TEMPLATES
)

ORACLE = f"""
WITH d AS (SELECT doc_id, text, {_SQL_WORDS} AS w FROM documents),
phrases AS ({_SQL_PLACES}),
places AS (SELECT d.doc_id, p.label, unnest(list_filter(range(len(d.w)), lambda i: array_to_string(d.w[i + 1:i + p.size], ' ') = p.phrase)) AS start
           FROM d JOIN phrases p ON contains(array_to_string(d.w, ' '), p.phrase)),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY 1),
templates AS ({_SQL_TEMPLATES}),
blocks AS (SELECT doc_id, span, w, unnest(range(0, (len(w) - 1) // span + 1)) AS block FROM d, (SELECT DISTINCT span FROM templates) WHERE len(w) > 0),
sets AS (SELECT doc_id, span, list_distinct(w[block * span + 1:(block + 2) * span]) AS w FROM blocks),
made AS (SELECT doc_id, list(DISTINCT label) AS made, max(len(list_intersect(w, tw)) / len(tw)) AS best
         FROM sets JOIN templates USING (span) WHERE list_has_all(w, needs) AND len(list_intersect(w, tw)) >= ceil({CONTAINMENT} * len(tw) - 1e-9) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(made, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score,
       coalesce(array_to_string(list_sort(made), ','), '') AS template_labels
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN made USING (doc_id)
"""
