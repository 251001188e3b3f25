"""Queries that find entities, sources and ads, and page through results."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import lookup as L
from orrery.plans import domain as D
from orrery.plans.domain import ORGS

DIRECTORY = ORGS + """, dir AS (SELECT *, CASE WHEN id LIKE 'C%' THEN 'Client ' || substr(id, 2) END AS alias, CASE WHEN id LIKE 'C%' THEN 'Page of ' || name END AS page_name,
  CASE WHEN id LIKE 'S%' THEN '10-' || lpad(substr(id, 2), 7, '0') END AS ein, CASE WHEN id LIKE 'C%' THEN lpad(substr(id, 2), 9, '0') || 'RR0001' END AS bn FROM orgs)"""


def directory(spark, sf_dir):
    """Organisations with made aliases, pages and numbers."""
    of, number = F.substring("id", 1, 1), F.substring("id", 2, 20)
    customer = of == "C"
    return D.organisations(spark, sf_dir).select(
        "*", F.when(customer, F.array(F.concat(F.lit("Client "), number))).alias("aliases"), F.when(customer, F.concat(F.lit("Page of "), "name")).alias("page_name"),
        F.when(~customer, F.concat(F.lit("10-"), F.lpad(number, 7, "0"))).alias("ein"), F.when(customer, F.concat(F.lpad(number, 9, "0"), F.lit("RR0001"))).alias("bn"), F.lit(None).cast("string").alias("ad_id"),
    )


@query("entity_search_aliases", f"""WITH {DIRECTORY}, h AS (SELECT * FROM dir WHERE contains(lower(name), 'client 1') OR contains(lower(page_name), 'client 1') OR contains(lower(alias), 'client 1') OR ein = 'Client 1' OR bn = 'Client 1')
SELECT id, name, (SELECT count(*) FROM h) AS total FROM h ORDER BY confidence DESC, name, id LIMIT 20 OFFSET 3""")
def entity_search_aliases(spark, sf_dir):
    return L.search(directory(spark, sf_dir), "Client 1", ["ORGANIZATION"], skip=3).select("id", "name", "total")


@query("entity_search_number", f"WITH {DIRECTORY} SELECT id, ein, 1::BIGINT AS total FROM dir WHERE ein = '10-0000007'")
def entity_search_number(spark, sf_dir):
    return L.search(directory(spark, sf_dir), "10-0000007").select("id", "ein", "total")


@query("entity_quick", f"""WITH {DIRECTORY} SELECT id, name FROM dir WHERE contains(lower(name), 'customer#00000001') OR contains(lower(page_name), 'customer#00000001') OR contains(lower(alias), 'customer#00000001')
ORDER BY CASE WHEN lower(name) = 'customer#00000001' THEN 0 ELSE 1 END, length(name), name, id LIMIT 5""")
def entity_quick(spark, sf_dir):
    return L.quick(directory(spark, sf_dir), "Customer#00000001").select("id", "name")


LEADS = """ld AS (SELECT c_custkey AS lead_id, CASE c_custkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'name' WHEN 3 THEN 'bn' WHEN 4 THEN 'ein' ELSE 'entity_id' END AS kind,
  CASE c_custkey % 6 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' .;' WHEN 2 THEN substr(c_name, 1, length(c_name) - 1) WHEN 3 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') || 'RR0001' WHEN 4 THEN '10-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE 'C' || c_custkey END AS identifier FROM customer)"""


@query("lead_entities", f"""WITH {DIRECTORY}, {LEADS}, n AS (SELECT lead_id, id, name FROM ld JOIN dir ON (kind = 'bn' AND bn = identifier) OR (kind = 'ein' AND ein = identifier) OR (kind = 'entity_id' AND id = identifier)),
w AS (SELECT *, lower(rtrim(trim(identifier), '.,;:')) AS p FROM ld WHERE kind = 'name'),
f AS (SELECT lead_id, id, name, row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN lower(name) = lower(identifier) THEN 0 ELSE 1 END, length(name), id) AS r FROM w JOIN dir ON lower(name) = lower(identifier) OR rtrim(trim(lower(name)), '.') = p OR starts_with(lower(name), p))
SELECT lead_id, id AS entity_id, name FROM n UNION ALL SELECT lead_id, id, name FROM f WHERE r = 1""")
def lead_entities(spark, sf_dir):
    k = F.col("c_custkey")
    number, turn, name = k.cast("string"), k % 6, F.col("c_name")
    kind = F.when(turn <= 2, "name").when(turn == 3, "bn").when(turn == 4, "ein").otherwise("entity_id")
    value = F.when(turn == 0, F.upper(name)).when(turn == 1, F.concat(name, F.lit(" .;"))).when(turn == 2, F.left(name, F.length(name) - 1)).when(turn == 3, F.concat(F.lpad(number, 9, "0"), F.lit("RR0001")))
    value = value.when(turn == 4, F.concat(F.lit("10-"), F.lpad(number, 7, "0"))).otherwise(F.concat(F.lit("C"), number))
    leads = D.table(spark, sf_dir, "customer").select(k.alias("lead_id"), kind.alias("kind"), value.alias("identifier"))
    return L.entities_of_leads(leads, directory(spark, sf_dir))


SOURCES = [
    ("irs990", ["ein", "name"], ["funding", "board"], ["US"]), ("cra", ["bn", "name"], ["funding", "cross_border"], ["CA"]), ("edgar", ["cik", "name"], ["ownership"], ["US"]),
    ("sedar", ["sedar_profile", "name"], ["ownership"], ["CA"]), ("meta_ads", ["meta_page_id", "name"], ["sponsor"], ["*"]),
]


@query("sources_for_lead", "SELECT * FROM (VALUES ('name, CA', 'cra'), ('name, CA', 'meta_ads'), ('name, CA', 'sedar'), ('ownership', 'edgar'), ('ownership', 'sedar'), ('US', 'edgar'), ('US', 'irs990'), ('US', 'meta_ads')) t(asked, name)")
def sources_for_lead(spark, sf_dir):
    sources = spark.createDataFrame(SOURCES, "name string, identifiers array<string>, lead_types array<string>, jurisdictions array<string>")
    asked = [("name, CA", L.sources_for(sources, identifier="name", jurisdiction="CA")), ("ownership", L.sources_for(sources, lead_type="ownership")), ("US", L.sources_for(sources, jurisdiction="US"))]
    out = None
    for what, rows in asked:
        own = rows.select(F.lit(what).alias("asked"), "name")
        out = own if out is None else out.unionByName(own)
    return out


@query("registry_scores", """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'auto 1' END AS code, c_mktsegment || ' ' || c_custkey AS name, c_custkey || ' auto ' || c_custkey AS other FROM customer),
s AS (SELECT id, name, CASE WHEN lower(code) = 'auto 1' THEN 100 WHEN starts_with(lower(name), 'auto 1') THEN 90 WHEN starts_with(lower(other), 'auto 1') THEN 85 WHEN contains(lower(name), 'auto') AND contains(lower(name), '1') THEN 70
  WHEN contains(lower(other), 'auto') AND contains(lower(other), '1') THEN 65 WHEN contains(lower(name), 'auto 1') THEN 60 WHEN contains(lower(other), 'auto 1') THEN 55 END AS score FROM r)
SELECT id, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 400""")
def registry_scores(spark, sf_dir):
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k == 7, "AUTO 1").alias("code"), F.concat_ws(" ", "c_mktsegment", k.cast("string")).alias("name"), F.concat_ws(" ", k.cast("string"), F.lit("Auto"), k.cast("string")).alias("other_name"))
    return L.registry_scores(rows, "Auto 1", 400).select("id", "score")


@query("page_with_cursor", """WITH p AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey > 10))
SELECT c_custkey, (SELECT count(*) FROM p) > 25 AS has_more, to_base64(encode(CAST(c_acctbal AS DECIMAL(18,2)) || '|' || c_custkey)) AS cursor FROM p WHERE r <= 25""")
def page_with_cursor(spark, sf_dir):
    return L.page_after(D.table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", (5000.0, 10), 25).select("c_custkey", "has_more", "cursor")


@query("session_ads", """SELECT o_orderkey AS ad_id, o_orderpriority AS title, s_name AS sponsor_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def session_ads(spark, sf_dir):
    ads = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ad_id"), F.col("o_orderpriority").alias("title"))
    edges = D.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    nations = D.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    entities = D.table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return L.ads_of(ads, edges, entities).select("ad_id", "title", "sponsor_name")
