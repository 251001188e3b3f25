"""Queries of data quality and of detection quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import quality as Q
from orrery.plans import domain as D


def dirty(spark, sf_dir):
    """Orders with some values missing."""
    o = D.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderstatus")).alias("status"), "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderdate")


DIRTY = "d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_custkey % 11 <> 0 THEN o_orderstatus END AS status, o_custkey, year(o_orderdate) AS year, o_totalprice, o_orderdate FROM orders)"
PARTS = {
    "quality_completeness": "SELECT (count(priority) + count(status)) / CAST(2 * count(*) AS DOUBLE) AS v FROM d",
    "quality_consistency": "SELECT sum(CASE WHEN regexp_matches(priority, '^[1-3]-') THEN 1 ELSE 0 END) / CAST(count(priority) AS DOUBLE) AS v FROM d WHERE priority IS NOT NULL",
    "quality_uniqueness": "SELECT 1 - sum(n - 1) / CAST(sum(n) AS DOUBLE) AS v FROM (SELECT count(*) AS n FROM d GROUP BY o_custkey, year, status)",
    "quality_accuracy": "SELECT sum(CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 1 ELSE 0 END) / CAST(count(o_totalprice) AS DOUBLE) AS v FROM d",
}


def part(spark, sf_dir, name):
    rows = dirty(spark, sf_dir)
    return {
        "quality_completeness": lambda: Q.completeness(rows, ["priority", "status"]), "quality_consistency": lambda: Q.consistency(rows, "priority", "^[1-3]-"),
        "quality_uniqueness": lambda: Q.uniqueness(rows, ["o_custkey", "year", "status"]), "quality_accuracy": lambda: Q.accuracy(rows, "o_totalprice", F.col("o_totalprice").between(1000, 400000)),
    }[name]()


def _one(name):
    return lambda spark, sf_dir: part(spark, sf_dir, name).select(F.round("value", 6).alias("value"))


for _name, _sql in PARTS.items():
    query(_name, f"WITH {DIRTY} SELECT round(v, 6) AS value FROM ({_sql})")(_one(_name))


@query("quality_report", f"WITH {DIRTY}, p AS (" + " UNION ALL ".join(f"SELECT '{n.removeprefix('quality_')}' AS dimension, v, CAST({Q.THRESHOLDS[n.removeprefix('quality_')]} AS DOUBLE) AS threshold FROM ({s})" for n, s in PARTS.items()) + ") SELECT dimension, round(v, 6) AS value, threshold, v >= threshold AS passed FROM p")
def quality_report(spark, sf_dir):
    return Q.report({n.removeprefix("quality_"): part(spark, sf_dir, n) for n in PARTS}).withColumn("value", F.round("value", 6))


@query("quality_timeliness", "SELECT o_orderpriority, round(avg(greatest(0, 1 - datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 800.0)), 6) AS freshness FROM orders GROUP BY ALL")
def quality_timeliness(spark, sf_dir):
    fresh = Q.freshness(F.to_date("o_orderdate"), F.lit("2001-08-02").cast("date"), 400)
    return D.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(fresh), 6).alias("freshness"))


RATES = """round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 0 END, 6) AS specificity"""
COUNTS = """CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn"""
INTS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn"
RATE_COLUMNS = ("recall", "precision", "f1", "fpr", "fnr", "accuracy", "specificity")


def rounded(rows):
    return rows.select(*[F.round(c, 6).alias(c) if c in RATE_COLUMNS else F.col(c) for c in rows.columns])


@query("confusion_metrics", f"SELECT {INTS}, {RATES} FROM (SELECT {COUNTS} FROM labels)")
def confusion_metrics(spark, sf_dir):
    return rounded(Q.confusion(D.table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query("metrics_by_type", f"SELECT lang, {INTS}, {RATES} FROM (SELECT lang, {COUNTS} FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def metrics_by_type(spark, sf_dir):
    rows = D.table(spark, sf_dir, "labels").join(D.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(Q.confusion(rows, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]))


BINS = ", ".join(f"('{a:.2f}-{b:.2f}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in Q.HISTOGRAM)


@query("fp_histogram", f"SELECT bin, count(x) AS n FROM (VALUES {BINS}) t(bin, a, b) LEFT JOIN (SELECT value / 100 AS x FROM events WHERE event_type = 'error') e ON x >= a AND (x < b OR b = 1 AND x <= b) GROUP BY bin")
def fp_histogram(spark, sf_dir):
    return Q.histogram(D.table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("value") / 100).alias("score")), "score")


CASES = [(True, ["shared_funder", "timing"], ["infra"]), (True, ["timing"], ["shared_funder"]), (False, ["timing", "infra"], []), (True, ["infra", "shared_funder"], [])]


@query("signal_performance", """SELECT * FROM (VALUES ('shared_funder', 2::BIGINT, 2::BIGINT, 0::BIGINT, 1::BIGINT, 0.666667::DOUBLE), ('timing', 3, 2, 1, 0, 1.0), ('infra', 2, 1, 1, 1, 0.5)) t(signal, n_found, in_tp, in_fp, n_missed, detection_rate)""")
def signal_performance(spark, sf_dir):
    return Q.signal_performance(spark.createDataFrame(CASES, "positive boolean, found array<string>, missed array<string>")).withColumn("detection_rate", F.round("detection_rate", 6))


RUNS = "r AS (SELECT date_trunc('month', o_orderdate)::DATE AS run_at, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS recall FROM orders GROUP BY ALL)"


def runs(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("run_at")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("recall"))


@query("run_trend", f"WITH {RUNS}, l AS (SELECT * FROM r ORDER BY run_at DESC LIMIT 30) SELECT run_at, round(recall, 6) AS recall, round(recall - lag(recall) OVER (ORDER BY run_at), 6) AS delta, coalesce(recall - lag(recall) OVER (ORDER BY run_at) < -0.02, false) AS regression FROM l")
def run_trend(spark, sf_dir):
    return Q.trend(runs(spark, sf_dir), "recall", 0.02).select("run_at", F.round("recall", 6).alias("recall"), F.round("delta", 6).alias("delta"), "regression")


@query("run_summary", f"WITH {RUNS} SELECT round(min(recall), 6) AS least, round(max(recall), 6) AS most, round(avg(recall), 6) AS mean, round(max_by(recall, run_at), 6) AS latest FROM r")
def run_summary(spark, sf_dir):
    rows = Q.run_summary(runs(spark, sf_dir), "recall")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


GOLDEN = [("a", "positive", 0.6, ["x"], ["x", "y"], 0.5, None), ("b", "positive", 0.6, ["x", "z"], ["x"], None, None), ("c", "negative", 0.3, [], [], None, 0.45), ("d", "negative", 0.5, [], [], None, None), ("e", "positive", 0.44, [], [], None, None)]


@query("golden_cases", "SELECT * FROM (VALUES ('a', true, '', true), ('b', true, 'z', false), ('c', false, '', true), ('d', true, '', false), ('e', false, '', false)) t(id, detected, missing, passed)")
def golden_cases(spark, sf_dir):
    rows = Q.golden_check(spark.createDataFrame(GOLDEN, "id string, label string, score double, required array<string>, found array<string>, least double, most double"))
    return rows.select("id", "detected", F.array_join("missing", ",").alias("missing"), "passed")


@query("synthetic_burst")
def synthetic_burst(spark, sf_dir):
    rows = Q.synthetic_events(spark, "burst", 5, 3)
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), (F.max("us") - F.min("us") < 1_800_000_000).alias("within"))
