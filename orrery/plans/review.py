"""Queries of duplicates, reviews, matches and leads that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import leads as L, resolution as R, review as V
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED
from orrery.plans.leads import QUEUE, queue


@query("duplicate_groups", """WITH r AS (SELECT p_partkey AS id, upper(p_name) AS name, p_partkey // 4 AS ein FROM part), n AS (SELECT name, min(id) AS m FROM r GROUP BY name HAVING count(*) > 1)
SELECT id, m AS "group" FROM r JOIN n USING (name)""")
def duplicate_groups(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("ein"), F.lit("").alias("bn"))
    return V.duplicate_groups(rows, None)


@query("duplicate_groups_by_number", """WITH e AS (SELECT c_custkey AS id, c_custkey // 3 AS k, min(c_custkey) OVER (PARTITION BY c_custkey // 3) AS m, count(*) OVER (PARTITION BY c_custkey // 3) AS n FROM customer)
SELECT id, m AS "group" FROM e WHERE n > 1""")
def duplicate_groups_by_number(spark, sf_dir):
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("ein"), F.concat(F.lit("b-"), F.floor(k / 3).cast("string")).alias("bn"))
    return V.duplicate_groups(rows, None)


@query("city_matches")
def city_matches(spark, sf_dir):
    """Names of nations with one letter dropped, against all nations of the region."""
    n = D.table(spark, sf_dir, "nation")
    a = n.select("n_regionkey", F.concat(F.left("n_name", F.lit(3)), F.substring("n_name", 5, 30)).alias("a"))
    return a.join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").select("a", "b", V.same_city(F.col("a"), F.col("b")).alias("same"))


def named_parts(spark, sf_dir):
    return D.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query("best_names")
def best_names(spark, sf_dir):
    names = named_parts(spark, sf_dir)
    asked = names.select((-F.col("id")).alias("id"), F.concat_ws(" ", F.when(F.col("id") % 3 == 0, F.reverse(F.split("name", " "))).otherwise(F.split("name", " "))).alias("name")).withColumn("name", F.concat("name", F.when(F.col("id") % 2 == 0, " Inc").otherwise(" blue")))
    return V.best_by_name(asked, names).withColumn("confidence", F.round("confidence", 6))


@query("vendor_matches")
def vendor_matches(spark, sf_dir):
    names = named_parts(spark, sf_dir)
    vendors = names.select((-F.col("id")).alias("id"), F.concat(F.lit("the "), "name").alias("name"))
    return V.vendor_matches(vendors, names.where("id % 2 = 0"), names.where("id % 2 = 1")).withColumn("confidence", F.round("confidence", 6))


RESOLVED = """res AS (SELECT l_orderkey AS task_id, CASE l_quantity::INTEGER % 6 WHEN 0 THEN 'same_entity' WHEN 1 THEN 'different' WHEN 2 THEN 'merge_left' WHEN 3 THEN 'merge_right' WHEN 4 THEN 'skip' ELSE 'odd' END AS resolution, l_extendedprice AS nr FROM lineitem),
last AS (SELECT task_id, arg_max(resolution, nr) AS resolution FROM res GROUP BY ALL),
t AS (SELECT o_orderkey AS id, o_custkey AS source_id, o_custkey + 1 AS candidate_id, resolution, CASE WHEN resolution IS NULL THEN 'pending' WHEN resolution = 'same_entity' THEN 'approved' WHEN resolution LIKE 'merge%' THEN 'merged' WHEN resolution = 'skip' THEN 'skipped' ELSE 'rejected' END AS status FROM orders LEFT JOIN last ON task_id = o_orderkey)"""


def lines(spark, sf_dir):
    """Line items with what orders equal times: the first row of the first file by name, which the SQL finds first too (read by many
    threads, it takes one or the other), and q, the quantity rounded as the SQL does. The larger counts: names are turned digit by digit."""
    name = F.concat(F.translate(F.hex("_metadata.file_name"), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    rows = D.table(spark, sf_dir, "lineitem").select("*", (-F.col("_metadata.row_index")).alias("row"), name.alias("file"))
    return rows.withColumn("q", F.rint("l_quantity").cast("int"))


def tasks(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), (F.col("o_custkey") + 1).alias("candidate_id"), F.lit("pending").alias("status"))
    kinds = F.array(*map(F.lit, ["same_entity", "different", "merge_left", "merge_right", "skip"]))
    resolution = F.coalesce(F.get(kinds, F.col("q") % 6), F.lit("odd"))
    decisions = lines(spark, sf_dir).select(F.col("l_orderkey").alias("task_id"), resolution.alias("resolution"), F.lit("ann").alias("reviewer"), F.col("l_extendedprice").alias("decided_at"), "row", "file")
    return V.reviewed(rows, decisions, ("file", "row"))


@query("review_decisions", f"WITH {RESOLVED} SELECT status, resolution, count(*) AS n FROM t GROUP BY ALL")
def review_decisions(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("status", "resolution").agg(F.count("*").alias("n"))


@query("review_merges", f"WITH {RESOLVED} SELECT CASE WHEN resolution = 'merge_left' THEN source_id ELSE candidate_id END AS kept, CASE WHEN resolution = 'merge_left' THEN candidate_id ELSE source_id END AS gone FROM t WHERE status = 'merged'")
def review_merges(spark, sf_dir):
    return V.merges(tasks(spark, sf_dir))


JUDGED = """v AS (SELECT l_orderkey AS id, CASE l_quantity::INTEGER % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'defer' ELSE 'wait' END AS verdict, l_extendedprice AS nr FROM lineitem),
f AS (SELECT id, arg_min(verdict, nr) AS verdict FROM v WHERE verdict <> 'wait' GROUP BY ALL),
m AS (SELECT o_orderkey AS id, o_custkey AS source_id, o_custkey % 50 AS target_id, o_totalprice AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'rejected' WHEN verdict = 'approve' THEN 'approved' WHEN verdict = 'reject' THEN 'rejected' WHEN verdict = 'defer' THEN 'deferred' ELSE 'pending' END AS status FROM orders LEFT JOIN f ON f.id = o_orderkey)"""


def matches(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), (F.col("o_custkey") % 50).alias("target_id"), F.col("o_totalprice").alias("confidence"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending").alias("status"))
    kinds = F.array(*map(F.lit, ["approve", "reject", "defer", "wait"]))
    verdicts = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.get(kinds, (F.col("l_quantity").cast("int") % 4)).alias("verdict"), F.lit("bo").alias("reviewer"), F.col("l_extendedprice").alias("at"))
    return V.judged(rows, verdicts)


@query("match_verdicts", f"WITH {JUDGED} SELECT status, count(*) AS n FROM m GROUP BY ALL")
def match_verdicts(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("same_as_edges", f"WITH {JUDGED} SELECT source_id AS src, target_id AS dst, 'SAME_AS' AS rel_type, max(confidence) AS confidence, 'bo' AS approved_by FROM m WHERE status = 'approved' GROUP BY ALL")
def same_as_edges(spark, sf_dir):
    return V.same_as(matches(spark, sf_dir))


@query("match_actions", """WITH o AS (SELECT o_totalprice - floor(o_totalprice) AS c, o_orderkey % 3 * 0.05::DOUBLE AS boost, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'fuzzy' ELSE 'other' END AS strategy FROM orders)
SELECT CASE WHEN c >= 0.95 THEN 'auto' WHEN c >= 0.85 THEN 'review' ELSE 'none' END AS reference, CASE WHEN least(1, c + boost) >= 0.9 THEN 'auto_merged' WHEN least(1, c + boost) >= 0.7 THEN 'queued' ELSE 'no_match' END AS border,
  strategy, count(*) AS n, round(sum(CASE strategy WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.95 WHEN 'fuzzy' THEN least(0.85, c) ELSE 0.5 END), 4)::DOUBLE AS confidence FROM o GROUP BY ALL""")
def match_actions(spark, sf_dir):
    c = F.col("o_totalprice") - F.floor("o_totalprice")
    boost, turn = F.col("o_orderkey") % 3 * F.lit(0.05), F.col("o_orderkey") % 4
    strategy = F.when(turn == 0, "exact").when(turn == 1, "normalized").when(turn == 2, "fuzzy").otherwise("other")
    rows = D.table(spark, sf_dir, "orders").select(V.cross_reference_action(c).alias("reference"), R.cross_border_action(c, boost).alias("border"), strategy.alias("strategy"), R.strategy_confidence(strategy, c).alias("x"))
    return rows.groupBy("reference", "border", "strategy").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("confidence"))


@query("lead_changes", f"""WITH {QUEUE}, c AS (SELECT event_id AS lead_id, CASE user_id % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'skip' WHEN 3 THEN 'requeue' WHEN 4 THEN 'set_priority' END AS action, CAST(user_id % 8 AS INTEGER) AS p FROM events),
j AS (SELECT q.*, action, p FROM q JOIN c USING (lead_id))
SELECT CASE action WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'skip' THEN 'skipped' WHEN 'requeue' THEN 'pending' ELSE status END AS status,
  CASE WHEN p BETWEEN 1 AND 5 AND (action = 'requeue' OR (action = 'set_priority' AND status = 'pending')) THEN p ELSE priority END AS priority,
  CASE WHEN action IN ('complete', 'fail') THEN 'done' WHEN action = 'requeue' THEN NULL ELSE 'old' END AS result, CASE WHEN action = 'skip' THEN 'done' END AS skip_reason, count(*) AS n FROM j GROUP BY ALL""")
def lead_changes(spark, sf_dir):
    rows = queue(spark, sf_dir).select("*", F.lit("old").alias("result"), F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    kinds = F.array(*[F.lit(x) for x in ("complete", "fail", "skip", "requeue", "set_priority", None)])
    commands = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("lead_id"), F.get(kinds, (F.col("user_id") % 6).cast("int")).alias("action"), (F.col("user_id") % 8).cast("int").alias("priority"), F.lit("done").alias("result"), F.col("ts").alias("at"))
    return L.changed(rows, commands).groupBy("status", "priority", "result", "skip_reason").agg(F.count("*").alias("n"))


PLACED = """pl AS (SELECT 'C' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'bn' || c_custkey END AS bn, NULL AS ein, CASE WHEN c_nationkey < 10 THEN 'CA-ON' WHEN c_nationkey < 15 THEN 'US-NY' END AS place FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'e' || s_suppkey END, CASE WHEN s_nationkey < 12 THEN 'US' ELSE 'CA' END FROM supplier)"""


@query("cross_border_leads", f"""WITH {FUNDED}, {PLACED}, e AS (SELECT src, dst, CASE WHEN amount > 30000 THEN 0.9 WHEN amount > 20000 THEN 0.4 END::DOUBLE AS confidence FROM funded WHERE fiscal_year = 1996),
m AS (SELECT e.*, coalesce(a.place, '') AS pa, coalesce(b.place, '') AS pb, a.name AS na, b.name AS nb, a.bn AS bna, b.bn AS bnb, a.ein AS ea, b.ein AS eb FROM e JOIN pl a ON a.id = src JOIN pl b ON b.id = dst WHERE confidence IS NULL OR confidence >= 0.5),
o AS (SELECT src AS source_id, coalesce(bnb, eb, nb) AS target, confidence, pa || '>' || pb AS flow FROM m WHERE (pa IN ('', 'US') OR pa LIKE 'US-%') AND pb LIKE 'CA%'
  UNION ALL SELECT src, coalesce(bnb, eb, nb), confidence, pa || '>' || pb FROM m WHERE NOT (pa IN ('', 'US') OR pa LIKE 'US-%') AND pb LIKE 'US%'
  UNION ALL SELECT dst, coalesce(bna, ea, na), confidence, pb || '>' || pa FROM m WHERE NOT (pb IN ('', 'US') OR pb LIKE 'US-%') AND pa LIKE 'US%')
SELECT source_id, target, flow, coalesce(confidence, 0.8)::DOUBLE AS confidence FROM o""")
def cross_border_leads(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    text = F.lit(None).cast("string")
    c = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), k).alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("bn"), k)).alias("bn"), text.alias("ein"), F.when(F.col("c_nationkey") < 10, "CA-ON").when(F.col("c_nationkey") < 15, "US-NY").alias("jurisdiction"))
    p = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s).alias("id"), F.col("s_name").alias("name"), text.alias("bn"), F.when(s % 3 == 0, F.concat(F.lit("e"), s)).alias("ein"), F.when(F.col("s_nationkey") < 12, "US").otherwise("CA").alias("jurisdiction"))
    edges = D.funded_by(spark, sf_dir, 1996).withColumn("confidence", F.when(F.col("amount") > 30000, 0.9).when(F.col("amount") > 20000, 0.4))
    return L.cross_border(c.unionByName(p), edges).select("source_id", "target", "flow", "confidence")
