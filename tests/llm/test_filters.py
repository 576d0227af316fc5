"""Toxicity, URL filters, license scans, the pipeline and the registered SQL."""

import datetime as dt
import random
import re
import textwrap

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF
from tests.helpers import same_rows
from tests.llm.helpers import corpus, edited, empty, prose, table
from tests.llm.test_dedup import linked_components, without_repeats
from vigia.llm import decontamination, license_scan, toxicity, url_filters
from vigia.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, duck, key):
    assert same_rows(QUERIES[key](spark, SF), duck.execute(ORACLE[key]))


def test_registration():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "substring-dedup", "decontamination", "byte-level-bpe"]


def toxic_rows(n):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        words, bad, lang = prose(k, 80, 3000).split(), rng.random() < 0.2, rng.choice(["en", "fr"])
        if bad:
            for at in rng.sample(range(80), 4):
                words[at] = rng.choice(["idiot", "scum"]) if lang == "en" else "réq" + rng.choice("abcdef") + str(rng.randrange(100))
        rows.append((k, " ".join(words), lang, int(bad)))
    return rows


def test_toxicity_learns_and_generalises(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(d, t, g) for d, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, _, y in rows] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, rows=300)
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    truth = {d: y for d, _, _, y in rows}
    held = [r for r in scored if r["held"]]
    right = sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held)
    assert len(held) > 150 and right / len(held) > 0.95
    again = toxicity.score(docs.select("text", "doc_id"), model, name="s").collect()
    assert {r["doc_id"]: r["s"] for r in again} == {r["doc_id"]: r["score"] for r in scored}


def test_thresholds_cover_a_rare_language_and_long_texts(spark):
    """All labels that were not fitted calibrate, so a language far too rare for the sample has its cut."""
    rows = [(d, t, "fi" if d % 12 == 0 else "is" if d % 300 == 1 else g, y) for d, t, g, y in toxic_rows(2400)]
    rows = [(d, t + " " + prose(d, 300) if g == "fi" else t, g, y) for d, t, g, y in rows]
    docs = spark.createDataFrame([(d, t, g) for d, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rows=120, chars=1000)  # no text of "fi" is short enough for the sample
    assert set(model.thresholds) == {"en", "fr", "fi"}
    got = toxicity.score(docs, model).filter("lang = 'fi'").withColumn("held", toxicity.held_out()).filter("NOT held").collect()
    truth = {d: y for d, _, _, y in rows}
    assert min(sum(truth[r["doc_id"]] == k for r in got) for k in (0, 1)) >= toxicity.LEAST_FOR_LANGUAGE

    def f1(cut):
        hits = sum(truth[r["doc_id"]] for r in got if r["score"] >= cut)
        return 2 * hits / max(1, sum(r["score"] >= cut for r in got) + sum(truth[r["doc_id"]] for r in got))

    assert f1(model.thresholds["fi"]) >= f1(toxicity.GLOBAL_THRESHOLD)
    again = toxicity.train(docs, labels, rows=120, chars=1000)
    assert again.thresholds == pytest.approx(model.thresholds)


def test_toxicity_edges(spark):
    rows = corpus()
    one_class = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, rows), one_class)
    assert model.empty
    out = toxicity.score(table(spark, rows), model, name="own")
    assert out.columns == [*table(spark, rows).columns, "own"] and {r["own"] for r in out.collect()} == {0.0}
    model = toxicity.fit([t for _, t, _, _ in toxic_rows(200)], [y for _, _, _, y in toxic_rows(200)], [None] * 200, epochs=2)
    scores = toxicity.score(table(spark, rows), model, name="own").collect()
    assert len(scores) == len(rows) and all(0 <= r["own"] <= 1 for r in scores)
    assert len({r["own"] for r in scores if r["doc_id"] in (80, 81, 82)}) == 1
    assert toxicity.score(empty(spark), model).isEmpty()


def test_long_texts_score_in_overlapping_pieces(monkeypatch):
    model = toxicity.fit([t for _, t, _, _ in toxic_rows(100)], [y for _, _, _, y in toxic_rows(100)], [None] * 100, epochs=1)
    words = prose(3, 500).split()
    whole = toxicity.maxima_of(model, toxicity.Vocabulary(model), words)
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert abs(whole - toxicity.maxima_of(model, toxicity.Vocabulary(model), words)).max() < 1e-5


def test_url_filters(spark):
    d = dt.date
    events = [("l", "domain", "example.com", "block", d(2024, 1, 1), True), ("l", "domain", "example.com", "block", d(2024, 2, 1), False),
              ("l", "domain", "example.com", "block", d(2024, 2, 1), True), ("l", "domain", "example.com", "block", d(2024, 3, 1), True),
              ("t", "host", "good.example.com", "allow", d(2024, 1, 15), True), ("p", "prefix", "good.example.com/ads", "block", d(2024, 1, 1), True)]
    history = spark.createDataFrame(events, "list string, kind string, key string, action string, day date, added boolean")
    captures = [(1, "https://u:p@Sub.Example.COM.:80/x", d(2024, 1, 10)), (2, "https://sub.example.com/x", d(2024, 2, 10)), (3, "http://sub.example.com", d(2024, 3, 1)),
                (4, "http://good.example.com/a", d(2024, 1, 20)), (5, "http://good.example.com/a", d(2024, 1, 10)), (6, "http://good.example.com/ads/1?q", d(2024, 1, 20)),
                (7, None, d(2024, 1, 20)), (8, "no url", d(2024, 1, 20)), (9, "http://example.com", None), (10, "http://example.community/", d(2024, 1, 20)), (1, "https://u:p@Sub.Example.COM.:80/x", d(2024, 1, 10))]
    got = url_filters.decide(spark.createDataFrame(captures, "page_id long, url string, fetched date").selectExpr("*", "1 AS k", "2 AS u"), history)
    assert sorted((r["page_id"], r["decision"]) for r in got.collect()) == [(1, "block"), (1, "block"), (2, "none"), (3, "block"), (4, "allow"), (5, "block"), (6, "block"), (7, "none"), (8, "none"), (9, "none"), (10, "none")]
    assert url_filters.decide(got.limit(0).select("page_id", "url", "fetched"), history).isEmpty()
    assert {r["decision"] for r in url_filters.decide(got.select("page_id", "url", "fetched"), history.limit(0)).collect()} == {"none"}


def test_url_filters_match_brute_force(spark):
    """Every capture against every event by plain loops; one key has most of the events and captures."""
    rng = random.Random(12)
    start, hosts = dt.date(2024, 1, 1), ["hot.example.com"] * 6 + ["a.example.com", "example.com", "b.example.org"]
    events = [(rng.choice(["l", "m"]), "host", rng.choice(hosts), rng.choice(["allow", "block"]), start + dt.timedelta(rng.randrange(120)), rng.random() < 0.6) for _ in range(400)]
    events += [("l", "domain", "example.com", "block", start + dt.timedelta(k), k % 20 == 0) for k in range(0, 100, 10)]
    captures = [(k, f"http://{rng.choice(hosts)}/{k % 3}", start + dt.timedelta(rng.randrange(-5, 130))) for k in range(500)]
    out = url_filters.decide(
        spark.createDataFrame(captures, "page_id long, url string, fetched date"), spark.createDataFrame(events, "list string, kind string, key string, action string, day date, added boolean")
    )
    state = {}
    for name, kind, key, action, day, added in events:
        at = state.setdefault((name, kind, key, action), {})
        at[day] = at.get(day, True) and added

    def want(url, fetched):
        host, found = url.split("/")[2], []
        for (name, kind, key, action), days in state.items():
            if host == key or (kind == "domain" and host.endswith("." + key)):
                began = None
                for day in sorted(d for d in days if d <= fetched):
                    began = (began or day) if days[day] else None
                if began:
                    found.append((len(key), kind == "host", action == "allow", began, name, kind, key, action))
        best = max(found, default=None)
        return (best[7], best[4], best[6], best[3]) if best else ("none", None, None, None)

    got = {r["page_id"]: (r["decision"], r["list"], r["key"], r["valid_from"]) for r in out.collect()}
    assert got == {k: want(u, d) for k, u, d in captures} and len({g[:2] for g in got.values()}) == 5


def test_license_scan(spark):
    texts = [(1, "Released UNDER the MIT\nlicense, under-the mit license"), (2, "Apache License; Version 2.0"), (3, "cc by nc cc by nc"), (4, None), (5, ""),
             (6, "under the mit licenses"), (7, "x\nThis work is licensed under the GNU General Public License version 2"), (None, "cc by nc"),
             (3, "cc by nc cc by nc"), (8, "word " * 20_000 + "cc-by-nc"), (9, "...")]
    got = sorted(license_scan.scan(table(spark, texts)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = [(1, 9, 2, 1, 5, "mit"), (2, 5, 1, 0, 0, "apache-2"), (3, 6, 2, 0, 3, "cc-by-nc"), (3, 6, 2, 0, 3, "cc-by-nc"), (4, 0, 0, None, None, ""), (5, 0, 0, None, None, ""),
            (6, 4, 0, None, None, ""), (7, 13, 0, None, None, ""), (8, 20_003, 1, 20_000, 20_000, "cc-by-nc"), (9, 0, 0, None, None, ""), (None, 3, 1, 0, 0, "cc-by-nc")]
    assert [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["labels"] == "" and by_id[7]["score"] == 0 and by_id[4]["score"] == 0  # version 2 is not version 3
    assert license_scan.scan(empty(spark)).isEmpty()


def test_license_notices(spark):
    """Whole notices, wrapped and inside long texts; what shares only the usual words gets no label."""
    notice = {t.label: t.text for t in license_scan.TEMPLATES if t.span >= 16}
    mit = next(t.text for t in license_scan.TEMPLATES if t.label == "mit" and t.span > 16)
    cut = [w for k, w in enumerate(notice["gpl-2"].split()) if k % 9 != 2]  # one word in nine is missing, none of those needed
    cases = [("Licensed under CC BY 4.0", ""), ("Released under the BSD License", ""), ("Licensed under\nCC BY-NC 4.0", "cc-by-nc"), (textwrap.fill(notice["bsd"], 75), "bsd"),
             ("# " + "\n# ".join(textwrap.wrap(notice["mpl-2"], 40)), "mpl-2"), (mit.title(), "mit"), (" ".join(cut), "gpl-2"), (notice["gpl-3"], "gpl-3"),
             (notice["isc"], "isc"), (f"{prose(1, 777)} {textwrap.fill(mit, 60)} {prose(2, 3001)}\n{notice['bsd']}", "bsd,mit"), (" ".join(mit.split()[:60]), "")]
    got = license_scan.scan(table(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()
    assert {r["doc_id"]: r["template_labels"] for r in got} == {k: want for k, (_, want) in enumerate(cases)}


def contained(words):
    """(label, containment) of the templates found in the runs of words, by plain loops."""
    found = set()
    for t in license_scan.TEMPLATES:
        own = set(t.text.split())
        for at in range(0, len(words), t.span):
            block = set(words[at : at + 2 * t.span])
            share = len(block & own) / len(own)
            if share >= license_scan.CONTAINMENT and set(t.needs) <= block:
                found.add((t.label, round(share, 9)))
    return found


def test_license_join_reads_every_document(spark):
    """Templates are joined with the blocks of all documents; the words that must be present decide on links, not on what is read."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(9)]
    templates = (license_scan.Template("five", "w0 w1 w2 w3 w4"), license_scan.Template("seven", "w2 w3 w4 w5 w6 w7 w8"), license_scan.Template("long", " ".join(words + [f"v{k}" for k in range(3)])),
                 license_scan.Template("told", "w0 w1 w2 w3 w5", ("w5",)))
    texts = [(k, " ".join(rng.choice([*words, "x", "v0", "v1"]) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    got = {r["doc_id"]: (r["template_labels"], r["score"]) for r in license_scan.scan(table(spark, texts, extra=False), phrases={"no such phrase": "none"}, templates=templates).collect()}
    assert len(got) == len(texts)
    kinds = set()
    for k, text in texts:
        w, labels, best = text.split(), set(), 0.0
        for t in templates:
            for start in range(0, len(w), t.span):
                block = set(w[start : start + 2 * t.span])
                share = len(block & set(t.words)) / len(t.words)
                if share >= license_scan.CONTAINMENT and set(t.needs) <= block:
                    labels, best = labels | {t.label}, max(best, share)
        assert got[k] == (",".join(sorted(labels)), best)
        kinds |= labels
    assert kinds == {"five", "seven", "long", "told"}
    # A document without a word that its notice needs: its blocks are made and joined, and the link gets no label.
    notice = next(t for t in license_scan.TEMPLATES if t.label == "bsd")
    docs = spark.createDataFrame([(1, 1, " " + notice.text.replace("binary ", "") + " ")], "id long, h long, w string")
    blocks = license_scan.blocks_of(docs)
    assert blocks.filter(f"span = {notice.span}").count() == 1 and license_scan.template_blocks(blocks).isEmpty()
    assert {r["label"] for r in license_scan.template_blocks(blocks, templates=(notice._replace(needs=()),)).collect()} == {"bsd"}


def test_phrase_places_inside_each_other(spark):
    texts = [(1, "a a a"), (2, "b a a"), (3, "a b a"), (4, "a a b a a a a")]
    got = license_scan.scan(table(spark, texts, extra=False), phrases={"a a": "x", "a b a": "y"}).collect()
    assert {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == {
        1: (2, 0, 1, "x"), 2: (1, 1, 1, "x"), 3: (1, 0, 0, "y"), 4: (5, 0, 5, "x,y")}


def test_license_join_matches_brute_force(spark):
    rng = random.Random(9)
    words = sorted({w for t in license_scan.TEMPLATES for w in t.words}) + ["x", "y", "z"]
    blocks = [(k, rng.choice([8, 16, 64]), [rng.choice(words) for _ in range(rng.randrange(0, 300))]) for k in range(400)]
    blocks += [(500 + k, t.span, t.text.split()[k % 2 :]) for k, t in enumerate(license_scan.TEMPLATES)]
    got = license_scan.template_blocks(spark.createDataFrame(blocks, "k int, span int, words array<string>")).collect()
    want = set()
    for k, span, b in blocks:
        for t in license_scan.TEMPLATES:
            share = len(set(b) & set(t.words)) / len(t.words)
            if t.span == span and share >= license_scan.CONTAINMENT and set(t.needs) <= set(b):
                want.add((k, t.label, round(share, 9)))
    assert {(r["k"], r["label"], round(r["containment"], 9)) for r in got} == want and len(want) > 10


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(10)
    texts = []
    for k in range(120):
        parts = [prose(k, rng.randrange(0, 90))]
        for t in rng.sample(license_scan.TEMPLATES, 2):
            parts += [edited(t.text, k, rng.choice([0.01, 0.1, 0.2, 0.3])), prose(k + 500, rng.randrange(0, 40))]
        texts.append((k, "\n".join(parts)))
    got = license_scan.scan(table(spark, texts, extra=False), phrases={"no such phrase": "none"}).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), texts, strict=True):
        want = contained(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
        assert r["labels"] == ",".join(sorted({label for label, _ in want}))
        assert round(r["score"], 9) == max((c for _, c in want), default=0)
    assert len({r["labels"] for r in got}) > 10


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    item = prose(4242, 30)
    rows = corpus() + [(200, f"{prose(1, 5)} {item.upper()} {prose(2, 9)}"), (201, prose(55, 70))]
    docs = table(spark, rows, extra=False)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def texts(df):
        return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)

    kept = stages["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and texts(kept) == texts(docs)  # nothing to learn from
    near = stages["near-dedup"](spark, docs, str(tmp_path))
    lead = linked_components(rows, 5)
    alone = [r for k, r in enumerate(rows) if (r[0] is None or lead[r[0]] == r[0]) and (r[0] is None or r not in rows[:k])]
    assert near.columns == docs.columns and texts(near) == sorted(((str(d), t) for d, t in alone), key=str)
    cut = stages["substring-dedup"](spark, docs, str(tmp_path))
    want = sorted((str(d), tuple(k)) for d, k, _ in without_repeats(rows))
    assert cut.columns == docs.columns and sorted((str(r["doc_id"]), tuple((r["text"] or "").encode().split())) for r in cut.collect()) == want
    assert cut.filter("n_chars != length(text)").isEmpty()
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and texts(clean) == texts(docs.filter("doc_id IS NULL OR doc_id != 200"))
    coded = stages["byte-level-bpe"](spark, docs, str(tmp_path))
    assert coded.count() == len(rows) and coded.filter("size(ids) != n_tokens").isEmpty()
    assert decontamination.normal(item) in decontamination.normal(rows[-2][1])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
