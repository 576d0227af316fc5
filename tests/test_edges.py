"""Hand-built frames for the edge rules: band limits, curve steps, caps, NULL logic, tie-breaks."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from vigia import constants as K
from vigia.functions.core import keep_first
from vigia.operators import consolidation as C
from vigia.operators import kri_phone as KP
from vigia.operators import retention as RT
from vigia.operators import speech as S
from vigia.params import Period

P = Period("200003")


def test_talk_time_band_last_match_wins(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 59.9, 60, 180, 300, 600, 1200, 300000, 300001)], "t double")
    got = [r[0] for r in df.select(KP.talk_time_band(F.col("t"))).collect()]
    assert got == [None, "[1MIN]", "[1MIN]", "[3MIN]", "[5MIN]", "[10MIN]", "[20MIN]", "[+20]", "[+20]", None]


def test_call_length_band_first_match_wins(spark):
    df = spark.createDataFrame([(x,) for x in (0, 180, 181, 360, 600, 601, -5, None)], "t int")
    got = [r[0] for r in df.select(RT.call_length_band(F.col("t"))).collect()]
    assert got == ["MENORES 3 MIN", "MENORES 3 MIN", "ENTRE 3 MIN Y 6 MIN", "ENTRE 3 MIN Y 6 MIN",
                   "ENTRE 6 MIN Y 10 MIN", "MAYORES A 10 MIN", "-", "-"]


def _detail(spark, rows):
    schema = ("PERIODO string, PRODUCTO string, REG_EV string, CATEGORIA string, OBTENIDO double, NEVALUACION int, "
              "ESPERADO double, PESO_CATEGORIA double, PESO_GRUPO double, PUNTAJE double, FLAG int, "
              "GRUPO_CATEGORIA string, CODIGO string")
    return spark.createDataFrame(rows, schema)


def test_curve_and_cap_limits(spark):
    agents = spark.createDataFrame([("B00001", "TC"), ("B00002", "TC"), ("B00003", "TC"), ("B00004", "SELECT"),
                                    ("B00005", "TC"), ("B00006", "TC")], "REG_EJECUTIVO string, SUB_EQUIPO string")
    tot = {"B00001": 0.44, "B00002": 0.50, "B00003": 0.90, "B00004": 0.30, "B00005": 0.59, "B00006": 0.0}
    rows = []
    for reg, t in tot.items():
        for i in range(2):
            rows.append(("200003", "TC", reg, f"C{i}", 1.0, 1, 1.0, 0.3, 0.3, t / 2, 0, "G", f"200003_{reg}"))
    out = S.speech_curve_cap(_detail(spark, rows), agents)
    sums = {r[0]: round(r[1], 9) for r in out.groupBy("REG_EV").agg(F.sum("PUNTAJE")).collect()}
    assert sums == {"B00001": 0.56, "B00002": 0.57, "B00003": 0.6, "B00004": 0.3, "B00005": 0.59, "B00006": 0.0}
    assert all(v <= K.SPEECH_CAP + 1e-12 for k, v in sums.items() if k != "B00004")


def test_final_note_caps_and_select(spark):
    pc = spark.createDataFrame([("200003", "B00001", 1, "200003_B00001", 0.9), ("200003", "B00002", 1, "200003_B00002", 0.9),
                                ("200003", "B00003", 1, "200003_B00003", -0.2)],
                               "PERIODO string, REG_EJECUTIVO string, NUM_EVALUACION int, CODIGO string, NOTA_PC_RAW double")
    sa = spark.createDataFrame([("200003_B00001", 1, 0.8)], "CODIGO string, NEVALUACION int, NOTA_SA_RAW double")
    agents = spark.createDataFrame([("B00001", "TC"), ("B00002", "SELECT"), ("B00003", "PP")],
                                   "REG_EJECUTIVO string, SUB_EQUIPO string")
    hist = spark.createDataFrame([], "PERIODO string, REG_EJECUTIVO string, NUM_EVALUACION int, NOTA_PC double, "
                                     "NOTA_SA double, SUB_EQUIPO string")
    out = {r["REG_EJECUTIVO"]: (r["NOTA_PC"], r["NOTA_SA"], r["NOTA_FINAL"])
           for r in C.final_note(pc, sa, agents, hist, P).collect()}
    assert out["B00001"] == (0.4, 0.6, 1.0)
    assert out["B00002"] == (0.9, 0.0, 0.9)      # SELECT: manual only, no 0.4 cap
    assert out["B00003"] == (0.0, 0.0, 0.0)      # floor at 0, missing speech → 0


def test_keep_first_nulls_first_and_skew(spark):
    rows = [("k", None, 3), ("k", 1, 2), ("k", 1, 1)] + [("h", i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = {r["k"]: (r["a"], r["b"]) for r in keep_first(df, ["k"], order=[F.col("a")]).collect()}
    assert got == {"k": (None, 3), "h": (0, 0)}


def test_not_in_drops_null_types(spark):
    from vigia.operators.kri_audio import traffic_unify
    batch = spark.createDataFrame(
        [("00000001", "9", "B00001 X", dt.datetime(2000, 3, 2), 10, None, "R"),
         ("00000001", "9", "B00001 X", dt.datetime(2000, 3, 2), 11, "", "R"),
         ("00000001", "9", "B00001 X", dt.datetime(2000, 3, 2), 12, "RET", "R")],
        "NUM_DOCUMENTO string, TELEFONO_CONTACTO string, NOMBRE_AGENTE string, FEC_LLAMADA timestamp_ntz, "
        "DURACION_LLAMADA int, TIP_CLIENTE string, RESULTADO_LLAMADA string")
    agents = spark.createDataFrame([("B00001", "TC")], "REG_EJECUTIVO string, SUB_EQUIPO string")
    leads = spark.createDataFrame([], "TELEFONO string, NUMERO_DOCUMENTO string, TIP_CLIENTE string")
    reg = spark.createDataFrame([], "CODDOC string, NUMTELEFONO string, FLG_VALIDADO int")
    out = traffic_unify(batch, agents, leads, leads, reg, P).collect()
    assert [(r["DURACION_LLAMADA"], r["TIP_CLIENTE"]) for r in out] == [(11, "TC")]


def test_speech_averages_stay_in_generated_code(spark, tmp_path):
    """102 metrics: one scan, and explode and averages in one generated stage; averages equal the plain ones."""
    metrics = [f"M{k}" for k in range(102)]
    wide = spark.range(400).select(F.lit("TC01").alias("VENTA"), F.concat(F.lit("B"), F.col("id") % 3).alias("REG_EV"), F.lit(1).alias("NEVALUACION"), F.lit("x").alias("FLAG_LPDP"),
                                   *[F.when(F.col("id") % 7 != k % 7, (F.col("id") * k % 3 == 0).cast("int")).alias(m) for k, m in enumerate(metrics)])
    wide.write.parquet(str(tmp_path / "wide"))
    feed = spark.read.parquet(str(tmp_path / "wide"))
    long = S.speech_averages(S.pack_metrics(feed, metrics), P)
    got = {(r["REG_EV"], r["CATEGORIA"]): r["OBTENIDO"] for r in S.speech_unpivot(long, metrics).collect()}
    plain = feed.groupBy("REG_EV").agg(*[F.avg(m).alias(m) for m in metrics]).collect()
    assert got == {(r["REG_EV"], m): r[m] for r in plain for m in metrics}
    again = S.speech_average(long, metrics).collect()
    assert {(r["REG_EV"], m): r[m] for r in again for m in metrics} == got
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = S.speech_unpivot(S.speech_averages(S.pack_metrics(feed, metrics), P), metrics)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    assert sum("Scan" in x for x in lines) == 1 and "Union" not in plan
    assert all("*(" in x for x in lines if "HashAggregate" in x or "Generate" in x)


def test_null_averages_are_kept(spark):
    packed = spark.createDataFrame([("TC01", "B1", 1, "x", [1, None])], "VENTA string, REG_EV string, NEVALUACION int, FLAG_LPDP string, METRICAS array<int>")
    long = S.speech_unpivot(S.speech_averages(packed, P), ["A", "B"])
    assert {(r["CATEGORIA"], r["OBTENIDO"]) for r in long.collect()} == {("A", 1.0), ("B", None)}


def test_request_from_text_matches_brute_force(spark):
    """Prose requests against a plain re-implementation over the same texts."""
    import re
    from vigia.operators.requests import request_from_text
    texts = [("m1", "Audio de B00012 cliente DNI: 00000345 y también b00013 con 12345678 ok"),
             ("m2", "sin codigos aqui 87654321"),
             ("m3", "x" * 150 + " 11112222 " + "B00099" + " y " + "y" * 30 + " 33334444")]
    df = spark.createDataFrame(texts, "MSG_ID string, TEXTO string")
    got = sorted((r["MSG_ID"], r["reg_ev"], r["dni"]) for r in
                 request_from_text(df, "TEXTO", F.lit("AUDIO"), keep=["MSG_ID"]).collect())
    exp = []
    for mid, t in texts:
        for m in re.finditer(r"\b(B\d{5})\b", t, re.I):
            lo, hi = max(0, m.start() - 120), min(len(t), m.end() + 200)
            w = t[lo:hi]
            lab = re.search(r"\b(?:DNI|dni)\s*[:#-]?\s*(\d{8})\b", w)
            if lab:
                exp.append((mid, m.group(1).upper(), lab.group(1)))
                continue
            cands = [(abs(lo + x.start() - m.start()), x.group(1)) for x in re.finditer(r"\b(\d{8})\b", w)]
            if cands:
                exp.append((mid, m.group(1).upper(), min(cands, key=lambda c: c[0])[1]))
    assert got == sorted(exp)
    assert ("m1", "B00013", "00000345") in got      # label wins inside the window
    assert ("m3", "B00099", "11112222") in got      # nearest number when no label


def test_run_timestamp_ignores_session_time_zone(spark):
    from vigia.params import run_timestamp
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Lima", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = spark.range(1).select(run_timestamp(P).alias("t")).first()["t"]
            assert got == dt.datetime(2000, 4, 1, 8, 0, 0), tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_python_gets_only_texts_that_need_it(spark, monkeypatch):
    """A Python function runs before the projection that holds it: the condition must be in its argument."""
    import pandas as pd
    from pyspark.sql import types as T
    from vigia.operators import cleaning, requests
    seen = F.pandas_udf(lambda s: pd.Series([f"<{x}>" if x is not None else "NONE" for x in s]), T.StringType())
    for module, name, column in ((cleaning, "_nfkd", cleaning.strip_accents), (requests, "_unescape", requests.html_to_text)):
        monkeypatch.setattr(module, name, seen)
        df = spark.createDataFrame([(f"plain {k}",) for k in range(9)] + [("ñ &amp;",)], "t string")
        got = [r[0] for r in df.select(column(F.col("t"))).collect()]
        assert got.count("NONE") == 9 and sum(x.startswith("<") for x in got) == 1, name


def test_latin1_accents_match_the_general_rule(spark):
    from vigia.operators.cleaning import strip_accents, strip_accents_latin1
    df = spark.createDataFrame([("".join(map(chr, range(1, 256))),), (None,), ("¼ß´ñ",)], "t string")
    assert all(r[0] == r[1] for r in df.select(strip_accents(F.col("t")), strip_accents_latin1(F.col("t"))).collect())


def test_month_filters_reach_the_scan(spark):
    from vigia.plans.registry import QUERIES
    from tests.conftest import SF
    for key, column in (("retention_enrich", "FechaLlamada"), ("traffic_unify", "FEC_LLAMADA"), ("retention_claims", "FECHA_ALTA")):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({column}" in plan, key
    plan = QUERIES["reporting_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(" in plan and "LessThan(" in plan


def test_scans_per_query(spark):
    from vigia.plans.registry import QUERIES
    from tests.conftest import SF
    for key, most in (("audit_source_counts", 4), ("incident_detail", 7), ("consent_increment", 4)):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, (key, plan.count("FileScan"))


def test_identities_grow_with_the_data(duck):
    import duckdb
    from vigia.sources.fixtures import BASE_TABLES, oracle_ctes
    big = duckdb.connect()
    for t in BASE_TABLES:
        big.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    for sql in ("SELECT count(DISTINCT CODDOC) FROM r_sales", "SELECT count(DISTINCT TELEFONO) FROM r_leads",
                "SELECT count(DISTINCT REG_EJECUTIVO) FROM r_agent", "SELECT count(*) FROM r_evaluated"):
        small, large = (con.execute(oracle_ctes() + sql).fetchone()[0] for con in (duck, big))
        assert large > 5 * small, (sql, small, large)


def test_stale_feed_aborts_and_names_every_feed(spark):
    from vigia.operators.audit import assert_feed_period, audit_feed_period
    good = spark.createDataFrame([(dt.date(2000, 3, 5),)], "d date")
    checks = [audit_feed_period(good, "d", P, "GOOD")] + [audit_feed_period(good.limit(0), "d", P, f"F{k}") for k in range(25)]
    all_checks = checks[0]
    for c in checks[1:]:
        all_checks = all_checks.unionByName(c)
    assert_feed_period(checks[0])
    with pytest.raises(ValueError) as e:
        assert_feed_period(all_checks)
    assert all(f"'F{k}'" in str(e.value) for k in range(25)) and "GOOD" not in str(e.value)


def test_feed_folder_newest_only_and_empty_files(spark, tmp_path):
    from vigia.sources.readers import read_many_append
    (tmp_path / "exp_20000301.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "exp_20000302.tsv").write_text("a\tb\n3\t4\n")
    (tmp_path / "exp_20000303.tsv").write_text("")
    read = lambda **k: sorted(tuple(r) for r in read_many_append(spark, str(tmp_path), r"^exp_.*\.tsv$", **k).collect())
    assert read() == [("1", "2"), ("3", "4")] and read(newest_only=True) == [("3", "4")]
    assert read_many_append(spark, str(tmp_path), "nothing") is None


def test_each_report_keeps_its_own_header(spark, tmp_path):
    from vigia.sources.readers import read_report_with_preamble
    (tmp_path / "a.csv").write_text("pre\npre\nx,y,\n1,2,3,9\n4\n")
    (tmp_path / "b.csv").write_text("pre\npre\ny,z\n5,6\n ,7\n")
    df = read_report_with_preamble(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], header_line=3)
    assert df.columns == ["x", "y", "column_3", "z"]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [("1", "2", "3", None), ("4", None, None, None), (None, "5", None, "6"), (None, None, None, "7")]))


def test_identities_stay_whole_beyond_a_hundred_thousand_agents(spark, duck):
    """Codes and documents of keys beyond five and eight digits are unique, and the same in both engines."""
    from vigia.sources.fixtures import ROLE_SQL, _agent, _doc
    keys = [*range(0, 300), *range(99_990, 100_310), *range(2_599_900, 2_600_200), *range(10**8 - 5, 10**8 + 300), 1_100_000_000]
    assert "WHERE" not in ROLE_SQL["r_agent"]
    at = spark.createDataFrame([(k,) for k in keys], "k long").selectExpr(f"{_agent('k')} AS a", f"{_doc('k')} AS d").collect()
    duck.execute("CREATE OR REPLACE TEMP TABLE keys AS SELECT unnest(?)::BIGINT AS k", [keys])
    assert [tuple(r) for r in at] == duck.execute(f"SELECT {_agent('k')}, {_doc('k')} FROM keys").fetchall()
    assert len({r["a"] for r in at}) == len({r["d"] for r in at}) == len(keys)
    assert all(len(r["a"]) == 6 for r in at) and at[7]["a"] == "B00007" and at[7]["d"] == "00000007"


def test_phone_results_do_not_depend_on_row_order(spark):
    """Calls of fractional seconds whose double sums differ by order: equal totals fall to the smallest phone every time."""
    import random
    from vigia.operators import kri_phone as K
    rng = random.Random(5)
    calls = []
    for doc in range(40):
        spent = [rng.randrange(1, 90_000_000) for _ in range(14)]
        for phone in ("900000002", "900000001", "900000003"):
            calls += [(f"D{doc:02}", f"A{doc:02}", phone, dt.datetime(2000, 3, 1, 9, 0, 0, 123_457), us) for us in rng.sample(spent, len(spent))]
    calls = [(d, a, p, t, t + dt.timedelta(microseconds=us)) for d, a, p, t, us in calls]
    sales = spark.createDataFrame([("CD", f"D{k:02}", f"A{k:02}") for k in range(40)], "PRODUCTO string, CODDOC string, CODPROMOT string")
    platform = spark.createDataFrame([], "DNI string, USERNAME string, ANI string, DNIS string, sessionstarttime timestamp_ntz, sessionendtime timestamp_ntz")
    batch = spark.createDataFrame([], "NUM_DOCUMENTO string, REG_EJECUTIVO string, TELEFONO string, DURACION_LLAMADA int")
    seen = set()
    for turn in range(20):
        random.Random(turn).shuffle(calls)
        derived = spark.createDataFrame(calls, "DNI string, REG_EJECUTIVO string, TELF_ANI string, sessionstarttime timestamp_ntz, sessionendtime timestamp_ntz")
        derived = derived.selectExpr("*", "CAST(NULL AS STRING) AS TELF_DNIS").repartition((1, 8, 64)[turn % 3])
        best = K.phone_longest(K.phone_talk_time(sales, K.traffic_sources(batch, platform, derived)))
        seen.add(tuple(sorted(tuple(r) for r in best.collect())))
    assert len(seen) == 1 and {r[3] for r in next(iter(seen))} == {"900000001"}


def _failing(spark, schema):
    """Rows of which the last one fails, after the others have been written."""
    good = spark.createDataFrame([("200003", 7)], schema)
    return good.unionByName(spark.createDataFrame([("200004", 8)], schema).withColumn("V", F.expr("raise_error('torn row')").cast("int")))


def test_failed_writes_leave_the_old_rows(spark, tmp_path):
    from pyspark.errors import PySparkException
    from vigia.operators.sinks import sink_append_or_replace, sink_replace_period
    schema, flat, parted = "PERIODO string, V int", str(tmp_path / "flat"), str(tmp_path / "parted")
    old = spark.createDataFrame([("200002", 1), ("200003", 2)], schema)
    sink_append_or_replace(old, flat)
    sink_replace_period(old, parted)
    rows = lambda path: sorted((r["PERIODO"], r["V"]) for r in spark.read.schema(schema).parquet(path).collect())
    for write in (lambda: sink_append_or_replace(_failing(spark, schema), flat, replace=True), lambda: sink_append_or_replace(_failing(spark, schema), flat),
                  lambda: sink_replace_period(_failing(spark, schema), parted)):
        with pytest.raises(PySparkException):
            write()
        assert rows(flat) == rows(parted) == [("200002", 1), ("200003", 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["flat", "parted"]  # nothing staged is left
    # A table may be replaced by what was read from it; other periods stay; a named period is cleared.
    sink_append_or_replace(spark.read.parquet(flat).where("V = 1"), flat, replace=True)
    sink_replace_period(spark.createDataFrame([("200003", 5)], schema), parted)
    assert rows(flat) == [("200002", 1)] and rows(parted) == [("200002", 1), ("200003", 5)]
    sink_replace_period(spark.createDataFrame([], schema), parted, periods=["200003"])
    assert rows(parted) == [("200002", 1)]


def test_publication_is_undone_when_a_move_fails(spark, tmp_path, monkeypatch):
    from vigia.operators.sinks import sink_replace_period
    from vigia.sources import folders
    schema, path = "PERIODO string, V int", str(tmp_path / "t")
    old = [("200002", 1), ("200003", 2)]
    sink_replace_period(spark.createDataFrame(old, schema), path)
    move = folders._move

    def torn(spark, a, b):
        if ".staged-" in a and b.endswith("PERIODO=200003"):
            monkeypatch.setattr(folders, "_move", move)
            raise OSError("store is gone")
        move(spark, a, b)

    monkeypatch.setattr(folders, "_move", torn)
    with pytest.raises(OSError):
        sink_replace_period(spark.createDataFrame([("200002", 8), ("200003", 9)], schema), path)
    assert sorted((r["PERIODO"], r["V"]) for r in spark.read.schema(schema).parquet(path).collect()) == old


def test_files_load_once(spark, tmp_path, monkeypatch):
    from vigia.operators import sinks as L
    folder, table, ledger = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\n")
    (folder / "copy_of_a.txt").write_text("one\ntwo\n")
    (folder / "b.txt").write_text("three\n")
    read = lambda spark, paths: spark.read.text(paths)
    load = lambda: L.load_files(spark, str(folder), table, ledger, "T", read, "*.txt")
    rows = lambda: sorted(r["value"] for r in L.loaded_rows(spark, table, ledger, "T", "value string").collect())
    assert rows() == []
    publish = L.publish
    monkeypatch.setattr(L, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        load()
    assert rows() == []                                   # a load that ends before publication shows nothing
    monkeypatch.setattr(L, "publish", publish)
    first = load()
    assert rows() == ["one", "three", "two"]              # offered twice in the run, loaded once
    assert load() is None and rows() == ["one", "three", "two"]
    (folder / "late_copy.txt").write_text("three\n")
    (folder / "c.txt").write_text("four\n")
    assert load() not in (None, first) and rows() == ["four", "one", "three", "two"]
    assert len(L.drop_unpublished(spark, table, ledger, "T")) == 1 and rows() == ["four", "one", "three", "two"]
    assert L.load_files(spark, str(folder), table, ledger, "OTHER", read, "*.txt") is not None  # another target


def test_skip_done_makes_one_suffix_a_length(spark):
    from vigia.operators.transcripts import transcript_skip_done
    pending = spark.createDataFrame([("77",), ("123",), ("9",), ("55",)], "call_id string")
    done = spark.createDataFrame([("TC_x_123.txt",), ("TC_55.wav",), ("77.txt",), ("",), (None,)], "FILE_NAME string")
    out = transcript_skip_done(pending, done)
    assert sorted(r[0] for r in out.collect()) == ["55", "9"]
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert transcript_skip_done(pending, done.limit(0)).count() == 4 and transcript_skip_done(pending.limit(0), done).isEmpty()


def test_patch_receivers_of_one_key_are_spread(spark):
    """A (product, evaluation) that holds most agents without a score: its receivers fall into many join keys."""
    from vigia.operators.speech import PATCH_SALTS
    salts = spark.range(3000).select(F.concat(F.lit("B"), "id").alias("REG_EV")).groupBy(F.pmod(F.xxhash64("REG_EV"), F.lit(PATCH_SALTS))).count().collect()
    assert len(salts) == PATCH_SALTS and max(r["count"] for r in salts) < 200


def test_tracking_merge_rewrites_only_touched_buckets(spark, tmp_path):
    from vigia.operators import requests as RQ
    path = str(tmp_path / "tracking")
    schema = "reg_ev string, dni string, estado string, timestamp string"
    first = [(f"B{k:05}", f"{k:08}", "pendiente", "2000-03-01T10:00:00") for k in range(300)]
    RQ.tracking_merge(spark, path, spark.createDataFrame(first, schema))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    events = spark.createDataFrame([("B00007", "00000007", "no_encontrado", "2000-03-02T10:00:00"), ("B00007", "00000007", "old", "2000-02-02T10:00:00")], schema)
    assert len(RQ.tracking_merge(spark, path, events)) == 1
    after = files()
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert len({p.rsplit("/", 2)[1] for p in changed}) == 1      # one CUBO= folder
    rows = {r["dni"]: (r["estado"], r["NO_ENCONTRADO"]) for r in RQ.read_tracking(spark, path).collect()}
    assert len(rows) == 300 and rows.pop("00000007")[0] == "no_encontrado" and {v[0] for v in rows.values()} == {"pendiente"}
    assert RQ.tracking_merge(spark, path, events.limit(0)) == []
    plan = RQ.read_tracking(spark, path, only=[3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(CUBO" in plan or "PartitionFilters: [(CUBO" in plan


def test_consent_history_is_read_without_an_exchange(spark, tmp_path):
    from vigia.operators import consent as C
    leads = spark.createDataFrame([("PP", f"{k:08}", "S", "UF1", None, None) for k in range(50)], "TIP_CLIENTE string, NUMERO_DOCUMENTO string, VARIABLE_26 string, USERFIELD5 string, VARIABLE_3 string, VARIABLE_4 string")
    name = C.consent_history(spark, str(tmp_path / "hist_a"), 8)
    C.append_consent(spark.createDataFrame([("PP", f"PP_{k:08}_S_UF1") for k in range(0, 50, 2)] + [("PP", None)], "TABLA string, CODE string"), name)
    C.append_consent(spark.createDataFrame([("PP", "PP_00000001_S_UF1"), ("TC", "PP_00000003_S_UF1")], "TABLA string, CODE string"), name)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = C.consent_increment(leads, leads.limit(0), spark.table(name), P)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(int(r["NUM_DOCUMENTO"]) for r in out.collect()) == list(range(3, 50, 2))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    at = next(k for k, x in enumerate(lines) if "hist_a" in x and "Scan" in x or name in x)
    # Going up from the history's scan to the join, nothing is exchanged.
    depth, up = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for x in reversed(lines[:at]):
        d = len(x) - len(x.lstrip(" :+-"))
        if d < depth:
            depth = d
            up.append(x)
            if "SortMergeJoin" in x:
                break
    assert "SortMergeJoin" in up[-1] and not any("Exchange" in x for x in up), plan
    spark.sql(f"DROP TABLE {name}")


def test_observed_feeds_are_not_scanned_again(spark):
    from vigia.operators import audit as A
    feed = spark.createDataFrame([(k, dt.datetime(2000, 3, 1 + k)) for k in range(9)], "DIA int, D timestamp_ntz")
    watched, stored = A.FeedAudit({"ALL": "TRUE", "LOW": "DIA < 3", "NONE": "DIA > 99"}, "FEED", "D").on(feed)
    empty, nothing = A.FeedAudit({}, "EMPTY", "D").on(feed.limit(0))
    for df in (watched, empty):
        df.write.format("noop").mode("overwrite").save()
    counts = A.source_counts(spark, [stored])
    assert [tuple(r) for r in counts.collect()] == [("ALL", 9, "OK"), ("LOW", 3, "OK"), ("NONE", 0, "VACIA")]
    checks = A.feed_periods(spark, [stored, nothing], P)
    assert [tuple(r) for r in checks.collect()] == [("FEED", 9, dt.datetime(2000, 3, 9), "200003", True), ("EMPTY", 0, None, None, False)]
    assert "FileScan" not in counts._jdf.queryExecution().executedPlan().toString()
    same = A.audit_feed_period(feed, "D", P, "FEED").collect()
    assert [tuple(r) for r in same] == [tuple(checks.collect()[0])]


def test_report_cells_in_quotes(spark, tmp_path):
    from vigia.sources.readers import read_report_with_preamble
    rows = [("1", 'a, "b"', "x"), ("2", "plain", ""), ("3", '""', "y,z"), ("4", ",", None)]
    def cell(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"') else v
    lines = ["title, with comma"] + ['ID,"NAME, FULL",'] + [",".join(map(cell, r)) for r in rows] * 400
    (tmp_path / "r.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = read_report_with_preamble(spark, str(tmp_path / "r.csv"), header_line=2)
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.columns == ["ID", "NAME, FULL", "column_3"]
    assert got == sorted([("1", 'a, "b"', "x"), ("2", "plain", None), ("3", '""', "y,z"), ("4", ",", None)] * 400, key=lambda r: (r[0], r[1], r[2]))


def test_copies_of_the_best_agent_are_written_by_many_tasks(spark):
    """One (product, evaluation) with one donor and many receivers: the copies stand in more than one partition, each once."""
    n, columns = 300, "PERIODO string, PRODUCTO string, REG_EV string, CATEGORIA string, OBTENIDO double, NEVALUACION int, ESPERADO double, PESO_CATEGORIA double, PESO_GRUPO double, PUNTAJE double, FLAG int, GRUPO_CATEGORIA string, CODIGO string"

    def row(agent, category, score):
        return (P.periodo, "TC", agent, category, 1.0, 1, 0.5, 0.1, 0.2, score, 0, "G", f"{P.periodo}_{agent}")

    rows = [row("B00000", c, 0.2) for c in ("A", "C")] + [row(f"B{k:05d}", "A", 0.0) for k in range(1, n)]
    detail = spark.createDataFrame(rows, columns).repartition(2)
    agents = spark.createDataFrame([(f"B{k:05d}", "TC") for k in range(n)], "REG_EJECUTIVO string, SUB_EQUIPO string")
    manual = spark.createDataFrame([], "PERIODO string, REG_EJECUTIVO string, NUM_EVALUACION int, CODIGO string")
    out = S.zero_score_patch(detail, agents, manual, P).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["REG_EV"], r["CATEGORIA"], r["PUNTAJE"]) for r in out) == sorted((f"B{k:05d}", c, 0.2) for k in range(n) for c in ("A", "C"))
    assert len({r["part"] for r in out if r["REG_EV"] != "B00000"}) > 1


def test_group_scores_read_stored_averages(spark, monkeypatch):
    """The scores and their groups' factors come from stored rows, so the calls are averaged once."""
    from tests.conftest import SF
    from vigia.plans import quality
    from vigia.plans.registry import quality_month
    seen = []
    score = S.speech_score_group
    monkeypatch.setattr(quality.S, "speech_score_group", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or score(df))
    assert quality_month(spark, SF).sa_group_scores.count() > 0
    assert "Generate" not in seen[0] and "Aggregate" not in seen[0]


def test_notes_store_no_texts_of_the_manual_detail(spark):
    """What the notes read of the manual detail is stored without the other columns, and gives the same notes."""
    from tests.conftest import SF
    from vigia.operators.consolidation import manual_note
    from vigia.plans.registry import quality_month
    month = quality_month(spark, SF)
    assert set(month.manual_scores.columns) == {"PERIODO", "CODIGO", "REG_EJECUTIVO", "NUM_EVALUACION", "PESO_PREGUNTA_OBT"}
    assert "manual_detail" not in month.__dict__
    note = [(r["CODIGO"], r["NUM_EVALUACION"], round(r["NOTA_PC_RAW"] or 0, 9)) for r in month.pc_note.collect()]
    assert sorted(note) == sorted((r["CODIGO"], r["NUM_EVALUACION"], round(r["NOTA_PC_RAW"] or 0, 9)) for r in manual_note(month.manual_detail).collect())


def test_averages_of_any_number_of_metrics(spark):
    """Position and mean of every metric where the last row of a call holds fewer than the others; no metric, no row."""
    for n in (0, 1, S.METRICS_WIDTH, 2 * S.METRICS_WIDTH + 3):
        calls = [[(i * k) % 5 if (i + k) % 4 else None for k in range(n)] for i in range(12)]
        packed = spark.createDataFrame([("TC01", "B1", 1, "x", c) for c in calls], "VENTA string, REG_EV string, NEVALUACION int, FLAG_LPDP string, METRICAS array<int>")
        got = {r["POS"]: r["OBTENIDO"] for r in S.speech_averages(packed, P).collect()}
        known = [[c[k] for c in calls if c[k] is not None] for k in range(n)]
        assert got == {k: sum(v) / len(v) if v else None for k, v in enumerate(known)}


def test_metrics_are_made_of_marked_calls_only(spark):
    """No filter of the plan tests the metrics: it would be pushed to the scan, and make them for every call."""
    from tests.conftest import SF
    from vigia.plans.registry import quality_month
    plan = quality_month(spark, SF).averages._jdf.queryExecution().optimizedPlan().toString()
    filters = [x.split("Filter ", 1)[1] for x in plan.splitlines() if "Filter " in x]
    assert filters and not any("l_tax" in x or "METRICAS" in x for x in filters)
