"""Queries of the research queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import leads as L
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED

QUEUE = """q AS (SELECT event_id AS lead_id, user_id % 5 AS session_id, 'u' || user_id AS target, event_type AS target_type, CAST(1 + event_id % 5 AS INTEGER) AS priority, (event_id % 100) / 100.0::DOUBLE AS confidence,
  CAST(event_id % 4 AS INTEGER) AS depth, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status, ts AS created_at FROM events)"""


#: The queue without the seventh of events that lead_enqueue takes as new leads.
REST = QUEUE.replace("FROM events)", "FROM events WHERE event_id % 7 <> 1)")


def queue(spark, sf_dir, part="true"):
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "pending").when(i % 3 == 1, "in_progress").otherwise("completed")
    return D.table(spark, sf_dir, "events").where(part).select(
        i.alias("lead_id"), (F.col("user_id") % 5).alias("session_id"), F.concat(F.lit("u"), "user_id").alias("target"), F.col("event_type").alias("target_type"), (1 + i % 5).cast("int").alias("priority"),
        (i % 100 / 100.0).alias("confidence"), (i % 4).cast("int").alias("depth"), status.alias("status"), F.col("ts").alias("created_at"),
    )


@query("lead_dequeue", f"WITH {QUEUE} SELECT lead_id, priority, confidence FROM q WHERE status = 'pending' ORDER BY priority, confidence DESC, created_at, lead_id LIMIT 25")
def lead_dequeue(spark, sf_dir):
    return L.dequeue(queue(spark, sf_dir), 25).select("lead_id", "priority", "confidence")


@query("lead_enqueue", f"""WITH {REST}, n AS (SELECT event_id AS lead_id, user_id % 5 AS session_id, 'u' || user_id AS target, event_type AS target_type, CAST(1 + event_id % 5 AS INTEGER) AS priority, event_id % 100 / 100.0 AS confidence FROM events WHERE event_id % 7 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, target, target_type ORDER BY priority, confidence DESC, lead_id) AS r FROM n)
SELECT lead_id, session_id, target, target_type, priority FROM o WHERE r = 1 AND (session_id, target, target_type) NOT IN (SELECT (session_id, target, target_type) FROM q WHERE status IN ('pending', 'in_progress'))""")
def lead_enqueue(spark, sf_dir):
    i = F.col("event_id")
    new = D.table(spark, sf_dir, "events").where(i % 7 == 1).select(i.alias("lead_id"), (F.col("user_id") % 5).alias("session_id"), F.concat(F.lit("u"), "user_id").alias("target"), F.col("event_type").alias("target_type"), (1 + i % 5).cast("int").alias("priority"), (i % 100 / 100.0).alias("confidence"))
    return L.enqueue(queue(spark, sf_dir, "event_id % 7 <> 1"), new).select("lead_id", "session_id", "target", "target_type", "priority")


@query("lead_skip", f"WITH {QUEUE} SELECT status, skip_reason, count(*) AS n FROM (SELECT CASE WHEN r IS NOT NULL THEN 'skipped' ELSE status END AS status, r AS skip_reason FROM (SELECT *, CASE WHEN status = 'pending' THEN CASE WHEN depth > 2 THEN 'depth' WHEN confidence < 0.3 THEN 'confidence' END END AS r FROM q)) GROUP BY ALL")
def lead_skip(spark, sf_dir):
    return L.skip(queue(spark, sf_dir), 2, 0.3).groupBy("status", "skip_reason").agg(F.count("*").alias("n"))


@query("queue_stats", f"""WITH {QUEUE} SELECT status, NULL::INTEGER AS priority, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM q GROUP BY status UNION ALL
SELECT status, priority, count(*), round(avg(confidence), 6) FROM q WHERE status = 'pending' GROUP BY ALL""")
def queue_stats(spark, sf_dir):
    return L.stats(queue(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("funding_leads", f"WITH {FUNDED} SELECT src AS target, max(fiscal_year) AS year, CASE WHEN max(amount) > 100000 THEN 1 WHEN max(amount) > 10000 THEN 2 ELSE 3 END AS priority FROM funded WHERE dst = 'S1' GROUP BY src HAVING max(amount) >= 1000")
def funding_leads(spark, sf_dir):
    own = D.funded_by(spark, sf_dir).where("dst = 'S1'").groupBy(F.col("src").alias("target")).agg(F.max("fiscal_year").alias("year"), F.max("amount").alias("amount"))
    keep = L.follows(F.lit("funding"), F.lit(0.8), F.col("amount"), ["funding"], 0.5, 1000)
    return own.where(keep).select("target", "year", L.amount_priority(F.col("amount")).alias("priority"))


@query("ownership_leads", "SELECT l_linenumber AS line, CASE WHEN l_quantity * 2 > 50 THEN 1 WHEN l_quantity * 2 > 10 THEN 2 ELSE 3 END AS priority, greatest(1, least(5, CASE WHEN l_quantity * 2 > 50 THEN 1 WHEN l_quantity * 2 > 10 THEN 2 ELSE 3 END - 1)) AS raised, count(*) AS n FROM lineitem GROUP BY ALL")
def ownership_leads(spark, sf_dir):
    p = L.stake_priority(F.col("l_quantity") * 2)
    return D.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), p.alias("priority"), L.boosted(p, 1).alias("raised")).groupBy("line", "priority", "raised").agg(F.count("*").alias("n"))


@query("lead_dedupe", """WITH l AS (SELECT p_name AS value, CASE WHEN p_partkey % 2 = 0 THEN 'pattern' ELSE 'model' END AS method, p_size / 60.0 AS confidence FROM part), g AS (SELECT lower(value) AS key, max(confidence) AS c, count(DISTINCT method) AS n FROM l GROUP BY ALL)
SELECT key, round(CASE WHEN n > 1 THEN least(1.0, c + 0.05) ELSE c END, 6)::DOUBLE AS confidence, n > 1 AS hybrid FROM g WHERE CASE WHEN n > 1 THEN least(1.0, c + 0.05) ELSE c END >= 0.5""")
def lead_dedupe(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), F.when(F.col("p_partkey") % 2 == 0, "pattern").otherwise("model").alias("method"), (F.col("p_size") / 60.0).alias("confidence"))
    return L.merge_extracted(rows).select("key", F.round("confidence", 6).alias("confidence"), (F.col("method") == "hybrid").alias("hybrid"))
