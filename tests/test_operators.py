"""Golden values and edge cases of the engine's own operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import names as N, similarity as S, text as T
from orrery.operators import components as C, graph as G, quality as Q, scoring, timing, traversal
from orrery.sources import files, records, upserts as U


def one(spark, column, *values):
    return spark.range(1).select(column).first()[0]


def test_confidence_band(spark):
    for (base, n, strength, full), want in {(0.8, 3, 0.7, 0.8): (0.418, 0.108, 0.728), (0.9, 0, 1.0, 0.8): (0.405, 0.035, 0.775), (1.0, 20, 1.0, 1.0): (0.804, 0.634, 0.974)}.items():
        cols = scoring.confidence_band(F.lit(base), F.lit(n), F.lit(strength), F.lit(full))
        assert tuple(spark.range(1).select(*cols).first()) == want


def test_composite_band(spark):
    rows = spark.createDataFrame([("g", 0.6, 0.4, 0.8), ("g", 0.4, 0.2, 0.6)], "k string, point double, lower double, upper double")
    assert tuple(scoring.composite_band(rows, "k").select("point", "lower", "upper").first()) == (0.468, 0.227, 0.767)


def test_no_single_signal_flags():
    assert scoring.safety_check() == []


def test_jensen_shannon(spark):
    day = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, day(0))] * 6 + [(2, day(5))] * 6 + [(3, day(0))] * 3 + [(3, day(12))] * 3
    ev = spark.createDataFrame(rows, "entity_id long, ts timestamp_ntz")
    js = {(r.a, r.b): r.js for r in timing.js_divergences(ev).collect()}
    assert js[1, 2] == pytest.approx(0.693147, abs=1e-5) and js[1, 3] == pytest.approx(0.215762, abs=1e-5)


def test_burst_states():
    assert timing.burst_states(np.array([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 20])) == [2] * 7 + [0]
    assert set(timing.burst_states(np.arange(10) * 0.1)) == {2}
    assert set(timing.burst_states(np.array([0, 60, 120, 121, 122, 123, 180.0]))) == {0}
    assert timing.burst_states(np.array([5.0, 5.0, 5.0])) == []


def test_bursts_of_identical_times_are_none(spark):
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))] * 5, "entity_id long, ts timestamp_ntz")
    assert timing.bursts(ev).count() == 0


def test_election_days(spark):
    days = {r.year: r.day for r in timing.election_days(spark, 2020, 2024).collect()}
    assert [days[y].day for y in (2020, 2021, 2022, 2024)] == [3, 2, 8, 5]
    literal = {r.year: r.day for r in timing.election_days(spark, 2020, 2024, literal=True).collect()}
    assert literal[2021].day == 9


def test_names(spark):
    f = lambda fn, v: spark.createDataFrame([(v,)], "v string").select(fn(F.col("v"))).first()[0]
    assert f(N.organisation, "X Foundation Inc") == "X FOUNDATION" and f(N.organisation, "X Foundation") == "X" and f(N.organisation, None) == ""
    assert f(N.sponsor, "Maple Media, Inc.") == "maple media" and f(N.sponsor, "Big Co Trust") == "big co"
    assert f(N.registry, "Société Ltée") == "société" and f(N.company, "Acme Holdings") == "ACME"
    assert f(N.format_ein, "12 3456789") == "12-3456789" and f(N.format_ein, "12") == "12" and f(N.postal_code, "m5v-2h1") == "M5V 2H1" and f(N.postal_code, "12345") is None
    assert f(N.name_variations, "Acme Media, Inc.")[0] == "Acme Media, Inc."


def test_similarity():
    assert S.ratio("abc", "abc") == 100 and S.ratio("abcd", "abxd") == 75 and S.ratio("", "") == 100 and S.lcs("kitten", "sitting") == 4
    assert S.token_sort("a b", "b a") == 100 and S.token_set("acme media", "acme media group") == 100 and S.partial("abc", "xxabcxx") == 100


def test_text(spark):
    f = lambda fn, v: spark.createDataFrame([(v,)], "v string").select(fn(F.col("v"))).first()[0]
    assert f(T.neutral, "A secret scheme.") == "A undisclosed arrangement."
    assert f(T.softened, "This clearly proves it") == "This suggests it"
    assert f(T.corp_status, "Inactive") == "INACTIVE" and f(lambda c: T.corp_status(c, literal=True), "Inactive") == "ACTIVE"
    assert f(T.number, "$1,234.50") == 1234.5 and f(T.number, "x") is None and f(T.number, None) is None
    assert f(T.date_of, "03/02/2020") == dt.date(2020, 2, 3) and f(T.date_of, "no") is None
    assert f(lambda c: T.handle(c, "twitter"), "https://x.com/abc") == "abc"
    found = [(x.kind, x.value) for x in f(T.entities, "Acme Media Inc. (12-3456789, 123456789RR0001) at acme.com, https://skip.com and me@gmail.com")]
    assert ("ein", "12-3456789") in found and ("bn", "123456789RR0001") in found and ("domain", "acme.com") in found and not any("skip" in v or "gmail" in v for _, v in found)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (9, 9), (None, 4)], "src long, dst long")
    assert {tuple(r) for r in C.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 5)}
    assert C.connected_components(edges.where("src > 100")).count() == 0
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in C.connected_components(chain).collect()} == {0}


def test_paths_repeat_no_edge(spark):
    edges = spark.createDataFrame([("a", "b", 1, 2000), ("b", "a", 1, 2000), ("b", "c", 5, 2001)], "src string, dst string, amount int, fiscal_year int")
    found = {"".join(r.path) for r in traversal.paths_from(edges, "a", 4).collect()}
    assert found == {"ab", "aba", "abc"}


def test_validity_is_half_open(spark):
    rows = spark.createDataFrame([(1, None, None), (2, dt.date(2020, 1, 1), dt.date(2020, 2, 1)), (3, dt.date(2020, 2, 1), None)], "id int, valid_from date, valid_to date")
    assert {r.id for r in rows.where(G.valid_at("2020-02-01")).collect()} == {1, 3}


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert Q.completeness(empty, ["a", "b"]).first()[0] == 1 and Q.uniqueness(empty, ["a"]).first()[0] == 1
    metrics = Q.confusion(spark.createDataFrame([], "t boolean, g boolean"), F.col("t"), F.col("g")).first()
    assert metrics.recall == 0 and metrics.accuracy == 0
    assert spark.range(1).select(Q.freshness(F.lit("2024-01-01").cast("date"), F.lit("2024-01-08").cast("date"), 7)).first()[0] == 0.5


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([(1, "a", 5, 1), (2, "b", 6, 1)], "id int, name string, n int, v int")
    new = spark.createDataFrame([(1, None, 7, 2), (3, "c", 8, 2)], "id int, name string, n int, v int")
    assert {(r.id, r.name, r.n) for r in U.upsert(old, new, ["id"], "v").collect()} == {(1, "a", 7), (2, "b", 6), (3, "c", 8)}
    props = spark.range(1).select(U.merged_props(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()[0]
    assert props == {"a": "1", "b": "3"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name,EIN\nAcme,1\n", encoding="utf-8")
    rows = files.aliased(files.read_csv(spark, str(tmp_path / "a.csv")), {"name": ["company"], "ein": [], "city": ["town"]})
    assert [tuple(r) for r in rows.collect()] == [("Acme", "1", None)]
    (tmp_path / "b.json").write_text('{"results": [{"id": "1"}, {"id": "2"}]}')
    assert files.read_json_records(spark, str(tmp_path / "b.json"), "id:string").count() == 2
    (tmp_path / "c.xml").write_text("<all><row><name>A</name><n>1</n></row><row><name>B</name></row></all>")
    assert {(r.name, r.n) for r in files.read_xml(spark, str(tmp_path / "c.xml"), "row", "name string, n int").collect()} == {("A", 1), ("B", None)}
    (tmp_path / "d.txt").write_bytes("café".encode("latin-1"))
    assert files.read_text_files(spark, str(tmp_path / "d.txt")).first().text == "café"
    xml = spark.createDataFrame([("<r xmlns='u'><x><y> v </y></x></r>",)], "t string")
    assert xml.select(files.xml_value(F.col("t"), "no", "x/y")).first()[0] == "v"


def test_reports_of_ownership(spark):
    rows = spark.createDataFrame([("a", "Issuer: Maple Corp\nAcquiror: Big Fund Ltd\nnow holds 12.5% or 1,234,567 common shares"), ("b", "nothing"), ("c", None)], "id string, text string")
    out = {r.id: r for r in records.early_warning(rows).collect()}
    assert out["a"].percent == 12.5 and out["a"].shares == 1234567 and out["a"].confidence == 1.0 and out["b"].confidence == pytest.approx(0.504) and out["c"].percent is None


def test_streaming(spark, tmp_path):
    from orrery.streaming import timing as st

    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1 + i % 2, "click", 1.0, "{}") for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in")).select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for name, frame, mode in (("w", st.overlap_by_window, "complete"), ("d", st.daily_counts, "complete"), ("s", st.sessions, "complete")):
        q = frame(st.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, frame(static).collect()))
    q = st.burst_alerts(st.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("alerts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("alerts").groupBy("entity_id").agg(F.max("n")).collect()[0][1] == 6
