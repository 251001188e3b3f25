"""Queries of the composite score, over written-out signals and over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import scoring as S
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED

FC, SF, BO, PI, TC, IS = "funding_concentration", "shared_funder", "board_overlap", "personnel_interlock", "temporal_coordination", "infrastructure_sharing"
ROWS = [
    ("a", 1, TC, 0.8, 0.9, 3), ("a", 2, SF, 0.6, 0.9, 2), ("a", 3, IS, 1.0, 0.7, 1), ("b", 1, TC, 1.0, 1.0, 3), ("b", 2, SF, 1.0, 1.0, 2), ("b", 3, IS, 1.0, 1.0, 1), ("c", 1, FC, 1.0, 1.0, 1), ("c", 2, SF, 1.0, 1.0, 1),
    ("d", 1, SF, 1.0, 1.0, 1), ("d", 2, FC, 1.0, 1.0, 1), ("e", 1, FC, 1.0, 1.0, 1), ("e", 2, SF, 1.0, 1.0, 1), ("e", 3, BO, 1.0, 1.0, 4), ("e", 4, PI, 1.0, 1.0, 4), ("f", 1, FC, 1.0, 1.0, 1), ("f", 2, SF, 1.0, 1.0, 1), ("f", 3, SF, 0.5, 1.0, 1), ("g", 1, IS, 1.0, 1.0, 9),
]
VALUES = ", ".join(f"('{g}', {o}, '{t}', CAST({s} AS DOUBLE), CAST({c} AS DOUBLE), {e})" for g, o, t, s, c, e in ROWS)
DIM = ", ".join(f"('{k}', '{c}', CAST({w} AS DOUBLE), CAST({m} AS DOUBLE))" for k, (c, w, m) in S.SIGNALS.items())
PAIR = ", ".join(f"('{a}', '{b}', CAST({f} AS DOUBLE)), ('{b}', '{a}', CAST({f} AS DOUBLE))" for (a, b), f in S.CORRELATED.items())
BASE = f"""s AS (SELECT * FROM (VALUES {VALUES}) t(group_id, ord, signal_type, strength, confidence, evidence_count)), dim AS (SELECT * FROM (VALUES {DIM}) t(signal_type, category, w, cap)), cor AS (SELECT * FROM (VALUES {PAIR}) t(other, signal_type, f)),
r AS (SELECT group_id, signal_type, category, max_by(least(w * strength * confidence, cap), ord) AS raw FROM s JOIN dim USING (signal_type) GROUP BY ALL),
m AS (SELECT a.group_id, a.signal_type, product(f) AS f FROM s a JOIN cor ON cor.signal_type = a.signal_type JOIN (SELECT group_id, signal_type AS other, min(ord) AS o FROM s GROUP BY ALL) b ON b.group_id = a.group_id AND b.other = cor.other AND b.o < a.ord GROUP BY ALL),
c AS (SELECT r.group_id, r.signal_type, category, raw, raw * coalesce(f, 1) AS adjusted FROM r LEFT JOIN m ON m.group_id = r.group_id AND m.signal_type = r.signal_type)"""


def signals(spark):
    return spark.createDataFrame(ROWS, "group_id string, ord int, signal_type string, strength double, confidence double, evidence_count int")


@query("composite_score", f"""WITH {BASE}, n AS (SELECT group_id, count(*) AS n_signals FROM s GROUP BY ALL), z AS (SELECT group_id, sum(raw) AS raw, least(1.0, sum(adjusted)) AS adjusted, count(DISTINCT category) AS n_categories FROM c GROUP BY ALL)
SELECT group_id, n_signals, n_categories, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted, n_signals >= 2 AND n_categories >= 2 AS valid, n_signals >= 2 AND n_categories >= 2 AND round(adjusted, 9) >= 0.45 AS flagged FROM n JOIN z USING (group_id)""")
def composite_score(spark, sf_dir):
    return S.composite(signals(spark)).withColumn("raw", F.round("raw", 6)).withColumn("adjusted", F.round("adjusted", 6))


@query("composite_categories", f"WITH {BASE} SELECT group_id, category, round(sum(adjusted), 6) AS score FROM c GROUP BY ALL")
def composite_categories(spark, sf_dir):
    return S.categories(signals(spark)).withColumn("score", F.round("score", 6))


BAND = """b AS (SELECT group_id, ord, least(0.95, greatest(0.05, confidence * least(1.0, 0.5 + 0.1 * ln(1 + evidence_count)) * (0.7 + 0.3 * strength) * 0.9)) AS p, 0.15 + greatest(0.02, 0.2 - 0.02 * evidence_count) + 0.02 AS m FROM s)"""


@query("confidence_band", f"WITH {BASE}, {BAND} SELECT group_id, ord, round(p, 3) AS point, round(greatest(0, p - m), 3) AS lower, round(least(1, p + m), 3) AS upper FROM b")
def confidence_band(spark, sf_dir):
    point, lower, upper = S.confidence_band(F.col("confidence"), F.col("evidence_count"), F.col("strength"), F.lit(0.8))
    return signals(spark).select("group_id", "ord", point.alias("point"), lower.alias("lower"), upper.alias("upper"))


@query("composite_band", f"""WITH {BASE}, {BAND}, x AS (SELECT group_id, round(p, 3) AS point, round(greatest(0, p - m), 3) AS lower, round(least(1, p + m), 3) AS upper FROM b),
g AS (SELECT group_id, sum(point * point) / sum(point) * (1 - 0.2 * (1 - 1.0 / count(*))) AS p, min(lower) AS lo, max(upper) AS hi, 1 - (0.5 + 0.5 * (1 - (max(point) - min(point)))) AS d FROM x GROUP BY ALL)
SELECT group_id, round(p, 3) AS point, round(lo + (p - lo) * d, 3) AS lower, round(hi - (hi - p) * d, 3) AS upper FROM g""")
def composite_band(spark, sf_dir):
    return S.composite_band(confidence_band(spark, sf_dir), "group_id")


@query("funding_signal", f"""WITH {FUNDED}, y AS (SELECT * FROM funded WHERE fiscal_year = 1997), sel AS (SELECT 'C' || c_custkey AS id, c_mktsegment AS group_id FROM customer),
o AS (SELECT group_id, dst, count(DISTINCT src) AS n, sum(amount) AS t FROM y JOIN sel ON id = src GROUP BY ALL HAVING count(DISTINCT src) >= 2), g AS (SELECT dst, sum(amount) AS g FROM y GROUP BY ALL)
SELECT group_id, count(*) AS n_shared, round(max(CAST(t AS DOUBLE) / CAST(g AS DOUBLE)), 6) AS concentration, round(least(1.0, 0.2 * count(*) + 0.5 * max(CAST(t AS DOUBLE) / CAST(g AS DOUBLE))), 6)::DOUBLE AS strength FROM o JOIN g USING (dst) GROUP BY ALL""")
def funding_signal(spark, sf_dir):
    """The shared-funder signal of each market segment: one aggregate by group and funder, joined to the funders' totals."""
    edges = D.funded_by(spark, sf_dir, 1997)
    group = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.col("c_mktsegment").alias("group_id"))
    own = edges.join(group, "src").groupBy("group_id", "dst").agg(F.count_distinct("src").alias("n"), F.sum("amount").alias("t")).where("n >= 2")
    given = edges.groupBy("dst").agg(F.sum("amount").alias("g"))
    share = F.col("t").cast("double") / F.col("g").cast("double")
    out = own.join(given, "dst").groupBy("group_id").agg(F.count("*").alias("n_shared"), F.max(share).alias("concentration"))
    strength = F.least(F.lit(1.0), 0.2 * F.col("n_shared") + 0.5 * F.col("concentration"))
    return out.select("group_id", "n_shared", F.round("concentration", 6).alias("concentration"), F.round(strength, 6).alias("strength"))


@query("coordination_composite")
def coordination_composite(spark, sf_dir):
    """End to end: timing, funding and infrastructure of each market segment as signals, then one score."""
    from orrery.operators import timing as T

    funding = funding_signal(spark, sf_dir).select("group_id", "n_shared", "concentration")
    segment = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("group_id"))
    events = D.timing_events(spark, sf_dir).join(segment, "entity_id")
    per = events.groupBy("group_id", T.bins("ts", 86_400).alias("bin")).agg(F.count_distinct("entity_id").alias("n"))
    timing = per.groupBy("group_id").agg(F.avg((F.col("n") > 1).cast("double")).alias("score"), F.lit(0.9).alias("confidence"))
    infra = funding.select("group_id", F.lit(5.0).alias("top"), F.lit(0.8).alias("confidence"))
    out = S.composite(S.assemble(timing, funding, infra))
    return out.select("group_id", "n_signals", "n_categories", F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"), "valid", "flagged")


