"""Queries of source records, registries and review work."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import infrastructure as I, quality as Q, reports as P, resolution as R
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED
from orrery.sources import records as S

CATEGORY = "CASE WHEN c = 1 AND b THEN 'DIRECTOR_OF' WHEN c IN (1, 3) THEN 'EMPLOYED_BY' WHEN c IN (5, 6, 7) THEN 'FUNDED_BY' WHEN c IN (10, 11) THEN 'OWNS' END"


@query("powermap_edges", f"""WITH r AS (SELECT o_orderkey AS rel_id, o_custkey AS f, o_orderkey % 150 AS t, o_orderkey % 12 + 1 AS c, o_orderkey % 2 = 0 AS b FROM orders),
x AS (SELECT rel_id, {CATEGORY} AS rel_type, 'C' || f AS a, 'S' || t AS z FROM r WHERE f % 4 > 0 AND t BETWEEN 1 AND 100 AND rel_id % 9 > 0)
SELECT rel_id, rel_type, CASE WHEN rel_type = 'FUNDED_BY' THEN z ELSE a END AS src, CASE WHEN rel_type = 'FUNDED_BY' THEN a ELSE z END AS dst FROM x WHERE rel_type IS NOT NULL""")
def powermap_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = D.table(spark, sf_dir, "orders")
    rows = orders.select(k.alias("rel_id"), F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), k % 150).alias("to_id"), (k % 12 + 1).cast("int").alias("category"), (k % 2 == 0).alias("is_board"))
    customers = D.table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("C"), "c_custkey").alias("id"))
    others = spark.range(1, 101).select(F.concat(F.lit("s"), "id").alias("source_id"), F.concat(F.lit("S"), "id").alias("id"))
    return S.powermap_edges(rows, customers.unionByName(others), rows.where("rel_id % 9 = 0"))


TITLES = ["Board Chair", "CEO", "Member", "Trustee and President", "Clerk", None, "Shareholder", "Head of News"]
TITLE_ROWS = ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t + chr(39)})" for i, t in enumerate(TITLES))
ANY = lambda words: "(" + " OR ".join(f"contains(coalesce(lower(t), ''), '{w}')" for w in words) + ")"


@query("title_flags", f"""SELECT id, CASE WHEN {ANY(S.POSITIONS[0][0])} THEN 'DIRECTOR_OF' WHEN {ANY(S.POSITIONS[1][0])} THEN 'OWNS' ELSE 'EMPLOYED_BY' END AS rel_type, {ANY(S.EXECUTIVE)} AS executive, {ANY(S.BOARD)} AS board FROM (VALUES {TITLE_ROWS}) v(id, t)""")
def title_flags(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(TITLES)), "id int, t string")
    executive, board = S.title_flags(F.col("t"))
    return rows.select("id", S.position_type(F.col("t")).alias("rel_type"), executive.alias("executive"), board.alias("board"))


@query("source_counts", "SELECT count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events")
def source_counts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", '{"a": 1}').when(F.col("event_type") == "view", '{"b": 2}').otherwise("{}").alias("external_ids"))
    return S.source_counts(rows, ["a", "b"])


@query("target_companies", "SELECT name FROM (SELECT c_name AS name FROM customer WHERE starts_with(CAST(c_custkey % 7 AS VARCHAR), '0') UNION SELECT c_name FROM customer WHERE c_nationkey = 3 AND (contains(lower(c_name), '11') OR contains(lower(c_name), '9'))) ORDER BY name LIMIT 100")
def target_companies(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 7).cast("string").alias("profile"), F.when(F.col("c_nationkey") == 3, "CA").alias("country"))
    return S.target_companies(rows, ["11", "9"], 100)


@query("review_tasks_by_priority", "SELECT o_orderkey AS id, p AS priority FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS p FROM orders) ORDER BY o_orderkey % 4, o_orderdate, o_orderkey LIMIT 40")
def review_tasks_by_priority(spark, sf_dir):
    priority = F.element_at(F.array(*map(F.lit, P.PRIORITY)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"))
    return P.by_priority(rows).limit(40).select("id", "priority")


@query("audit_query", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50")
def audit_query(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events")
    for condition in ("ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00'", "ts < TIMESTAMP_NTZ'2024-01-12 00:00:00'", "event_type = 'purchase'"):
        rows = rows.where(condition)
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


@query("entity_evidence", """SELECT DISTINCT 'S' || l_suppkey AS id, o_orderkey AS evidence_id, o_orderdate AS retrieved_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def entity_evidence(spark, sf_dir):
    nodes = D.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("id")).agg(F.collect_set("l_orderkey").alias("evidence_refs"))
    evidence = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("retrieved_at"))
    return P.entity_evidence(nodes, evidence)


@query("unknowns", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR (c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING')")
def unknowns(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").withColumn("a", F.col("c_acctbal") < 0).withColumn("b", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment") == "BUILDING"))
    return P.unknowns(rows, ["a", "b"]).select("c_custkey")


@query("health_checks", """WITH c AS (SELECT count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1.0 ELSE 0 END) AS tn, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END) AS fn FROM labels),
r AS (SELECT n, tp / (tp + fn) AS recall, tp / (tp + fp) AS prec, fp / (fp + tn) AS fpr, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
SELECT 'recall' AS name, round(recall, 6) AS value, 0.85::DOUBLE AS target, CASE WHEN recall >= 0.85 THEN 'pass' ELSE 'fail' END AS status FROM r UNION ALL SELECT 'fpr', round(fpr, 6), 0.05, CASE WHEN fpr <= 0.05 THEN 'pass' ELSE 'fail' END FROM r
UNION ALL SELECT 'precision', round(prec, 6), 0.8, CASE WHEN prec >= 0.8 THEN 'pass' ELSE 'fail' END FROM r UNION ALL SELECT 'f1', round(f1, 6), 0.8, CASE WHEN f1 >= 0.8 THEN 'pass' ELSE 'fail' END FROM r UNION ALL SELECT 'sample', n, 10, CASE WHEN n >= 10 THEN 'pass' ELSE 'fail' END FROM r""")
def health_checks(spark, sf_dir):
    m = Q.confusion(D.table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return P.health_checks(m).withColumn("value", F.round("value", 6))


@query("first_leads", """WITH l AS (SELECT lower(c_name) AS key, 0 AS o, 'page' AS kind, 0.9 AS confidence FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT lower(c_name), 1, 'registry', 0.95 FROM customer WHERE c_custkey % 3 = 0)
SELECT key, arg_min(kind, o) AS kind, CAST(arg_min(confidence, o) AS DOUBLE) AS confidence FROM l GROUP BY key""")
def first_leads(spark, sf_dir):
    names = D.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("value"))
    return P.first_leads([(names.where("c_custkey % 2 = 0"), "page", 0.9), (names.where("c_custkey % 3 = 0"), "registry", 0.95)])


@query("networks", "SELECT * FROM (VALUES ('AS13335', 'Cloudflare', 'cdn'), ('AS16276', 'OVH', 'hosting'), ('AS1', NULL, NULL)) t(asn, owner, kind)")
def networks(spark, sf_dir):
    owner, kind = I.network(F.col("asn"))
    return spark.createDataFrame([("AS13335",), ("AS16276",), ("AS1",)], "asn string").select("asn", owner.alias("owner"), kind.alias("kind"))


@query("sponsor_confidence", "SELECT p_partkey, round(0.3 * p_size / 50 + CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM part")
def sponsor_confidence(spark, sf_dir):
    s = F.col("p_size")
    return D.table(spark, sf_dir, "part").select("p_partkey", F.round(R.sponsor_confidence(s / 50, s % 2 == 0, s % 3 == 0, s % 5 == 0), 6).alias("confidence"))


@query("unresolved_grants", f"""WITH {FUNDED} SELECT DISTINCT 'C' || c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 AND 'C' || c_custkey IN (SELECT src FROM funded)""")
def unresolved_grants(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), k).alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") == 3, "CA").alias("country"), F.when(k % 3 == 0, "x").alias("bn"), F.when(k % 5 == 0, "y").alias("resolved_to"))
    return R.unresolved_grants(nodes, D.funded_by(spark, sf_dir), "CA")


@query("cross_border_candidates", "SELECT g.c_custkey AS recipient_id, s.s_suppkey AS candidate_id FROM customer g JOIN supplier s ON g.c_nationkey = s.s_nationkey AND s.s_suppkey % 2 = 0 WHERE (g.c_custkey % 3 = 0 OR g.c_custkey % 4 = s.s_suppkey % 4)")
def cross_border_candidates(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    grants = D.table(spark, sf_dir, "customer").select(k.alias("recipient_id"), F.col("c_nationkey").alias("country"), F.when(k % 3 != 0, k % 4).alias("state"))
    charities = D.table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 2 == 0, s).alias("bn"), F.col("s_nationkey").alias("country"), (s % 4).alias("state"))
    return R.cross_border_candidates(grants, charities)


@query("cross_reference_stages")
def cross_reference_stages(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("bn"))
    s = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("bn"))
    return R.staged(c, s).groupBy("stage").agg(F.count("*").alias("n"))


@query("ad_hoc", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY ALL")
def ad_hoc(spark, sf_dir):
    """A parameterised statement over a registered table."""
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > :least GROUP BY ALL", args={"least": 100}, customer=D.table(spark, sf_dir, "customer"))
