"""The raw sale feed as Spark derives it, and the marts that the phone sales store, on rows built here."""

import datetime as dt

from tests.test_incidents import JVM_LIMIT, longest_method
from vigia.operators import kri_phone as KP
from vigia.plans import consumption as C
from vigia.plans.registry import OnUse
from vigia.sources import fixtures as FX

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", None)


def feeds(spark):
    orders = [(k, c, 100.0 * i + 0.35, "FOP"[i % 3], "1-URGENT", dt.datetime(1999 + i % 3, 1 + i % 12, 1 + i % 28))
              for i, (k, c) in enumerate((k, c) for k in (None, -4, 0, *range(1, 90)) for c in (None, -3, 7, 18, 29, 31, 3_000_000))]
    customers = [(c, s) for c in (None, -3, 7, 18, 29, 31, 31, 3_000_000) for s in SEGMENTS]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, "
                                  "o_orderpriority string, o_orderdate timestamp_ntz").createOrReplaceTempView("t_orders")
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").createOrReplaceTempView("t_customer")
    return [spark.sql(texts["r_src"].replace("FROM orders", "FROM t_orders").replace("JOIN customer", "JOIN t_customer")
                      .replace("FROM customer", "FROM t_customer")) for texts in (FX.ROLE_SQL, FX.SPARK_SQL)]


def test_feed_of_spark_is_that_of_the_sql(spark):
    want, got = feeds(spark)
    assert got.dtypes == want.dtypes
    assert want.count() == got.count() > 3000
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    assert longest_method(spark, got) < JVM_LIMIT


def test_phone_sales_store_their_products_only(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, name="stage": stored.append(name) or df)
    day = dt.date(2000, 3, 4)
    sale = spark.createDataFrame([("1", "B", 5.0, day, 4)], "CODDOC string, CODPROMOT string, MONTO_APROB double, FECDESEMB date, DIA int")
    month = C.ConsumptionMonth(OnUse(extra_sales=lambda: {"TCA": sale}), None)
    month.marts = C.StoredMarts(dict.fromkeys(("TC", "PP", "EC", "CD", "CON", "UPG", "IL", "PA", "SEG"), sale))
    got = month.phone_sales
    assert sorted(n for n in stored if n.startswith("mart-")) == sorted(f"mart-{p}" for p in ("TC", "PP", "EC", "CD", "CON", "UPG", "IL"))
    assert sorted(r["PRODUCTO"] for r in got.collect()) == sorted(p.product for p in KP.PHONE_PRODUCTS)
