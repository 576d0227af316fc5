"""Columns whose names clash with the operators' own, repeated ids, odd sections."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import prose, table
from vigia.llm import decontamination, sharding, substring_dedup, token_counts, toxicity, url_filters


def test_url_filters_replaces_own_columns(spark):
    captures = spark.createDataFrame([(1, "http://a.example.org/x", "2020-02-01"), (2, None, None)], "id int, url string, day string").select("*", F.col("day").cast("date").alias("fetched"))
    captures = captures.selectExpr("*", "'mine' AS action", "'k' AS key", "1 AS list", "2 AS kind", "'u' AS u", "3 AS d")
    events = spark.createDataFrame([("abuse", "domain", "example.org", "block", "2020-01-01", True)], "list string, kind string, key string, action string, day string, added boolean").withColumn("day", F.col("day").cast("date"))
    out = url_filters.decide(captures, events)
    assert len(out.columns) == len(set(out.columns))
    rows = {r["id"]: r for r in out.collect()}
    assert (rows[1]["decision"], rows[1]["list"], rows[1]["action"], rows[1]["u"]) == ("block", "abuse", "mine", "u")
    assert (rows[2]["decision"], rows[2]["list"]) == ("none", None)


def test_decontamination_with_clashing_names_and_text_ids(spark, tmp_path):
    passage = prose(3, 40)
    items = spark.createDataFrame([("item a", passage)], "item_id string, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, [(1, f"{prose(4, 20)} {passage} {prose(5, 20)}"), (2, prose(6, 60))]).selectExpr("*", "9 AS bad_id", "8 AS bad_h", "'x' AS item_id")
    assert [r["item_id"] for r in decontamination.contaminated(docs, items).collect()] == ["item a"]
    assert [r["doc_id"] for r in decontamination.stage_decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_shards_with_a_shard_column(spark, tmp_path):
    docs = table(spark, [(k, prose(k, 30)) for k in range(40)]).selectExpr("*", "'mine' AS shard", "1 AS shard_key", "2 AS depth")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.filter("shard = 'mine'").count() == 40 and back.select("shard_").distinct().count() > 1


def test_added_columns_take_the_place_of_own_ones(spark):
    docs = table(spark, [(k, prose(1, 80)) for k in range(3)]).selectExpr("*", "5 AS n_gone")
    out = substring_dedup.remove_repeats(docs)
    assert out.columns.count("n_gone") == 1 and sorted(r["n_gone"] for r in out.collect()) == [0, 80, 80]
    model = toxicity.fit(["a"], [0], ["en"])
    scored = toxicity.score(docs, model)
    assert scored.columns.count("score") == 1 and {r["score"] for r in scored.collect()} == {0.0}


def test_a_repeated_label_id_reaches_the_driver_once(spark, monkeypatch):
    docs = table(spark, [(k % 40, f"{'bad words' if k % 2 else 'nice day'} {prose(k % 7, 12)}") for k in range(2000)], extra=False)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, *a, **k: seen.append(len(texts)) or fit(texts, *a, **k))
    toxicity.train(docs, labels)
    assert seen[0] <= 40


def test_sections_in_any_order(spark):
    section = "array<struct<start:long,end:long>>"
    df = spark.createDataFrame([(1, "hello big world", [(10, 15), (0, 5), (None, 3)])], f"doc_id long, text string, s {section}")
    rows = {r["section"]: r["n_tokens"] for r in token_counts.section_tokens(df, sections="s").collect()}
    assert rows[0] > 0 and rows[1] > 0 and rows[2] == 0 and rows.get(-1, 0) > 0
    bad = spark.createDataFrame([(1, "hello big world", [(0, 8), (5, 9)])], f"doc_id long, text string, s {section}")
    with pytest.raises(Exception, match="overlap"):
        token_counts.section_tokens(bad, sections="s").collect()
