"""Queries over the graph's neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orrery.catalog import query
from orrery.operators import graph as G
from orrery.plans import domain as D
from orrery.plans.domain import DIRECTORS, FUNDED, ORGS

YEAR = 1996


def listed(column: str):
    return F.array_join(F.col(column), ",")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients of one market segment."""
    return D.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("id"))


@query("shared_funders", f"""WITH {FUNDED}, sel AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT dst AS funder, count(DISTINCT src) AS n_recipients, CAST(sum(amount) AS DOUBLE) AS total,
       array_to_string(list_sort(list_distinct(list(fiscal_year))), ',') AS years
FROM funded JOIN sel ON src = id WHERE fiscal_year = {YEAR} GROUP BY dst HAVING count(DISTINCT src) >= 2""")
def shared_funders(spark, sf_dir):
    rows = G.shared_funders(D.funded_by(spark, sf_dir, YEAR), selected(spark, sf_dir))
    return rows.select("funder", F.col("n_recipients").cast("long"), F.col("total").cast("double"), listed("years").alias("years"))


@query("shared_funders_concentration", f"""WITH {FUNDED}, y AS (SELECT * FROM funded WHERE fiscal_year = {YEAR}),
sel AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
own AS (SELECT dst, count(DISTINCT src) AS n, sum(amount) AS total, count(DISTINCT fiscal_year) AS yrs FROM y JOIN sel ON src = id GROUP BY dst HAVING count(DISTINCT src) >= 2),
given AS (SELECT dst, sum(amount) AS g FROM y GROUP BY dst)
SELECT dst AS funder, name, n AS n_recipients, CAST(total AS DOUBLE) AS total, round(CAST(total AS DOUBLE) / CAST(g AS DOUBLE), 6) AS concentration, yrs AS years_active
FROM own JOIN given USING (dst) JOIN (WITH {ORGS} SELECT id, name FROM orgs) o ON o.id = dst""")
def shared_funders_concentration(spark, sf_dir):
    rows = G.funder_concentration(D.funded_by(spark, sf_dir, YEAR), selected(spark, sf_dir))
    named = rows.join(D.organisations(spark, sf_dir).select(F.col("id").alias("funder"), "name"), "funder")
    return named.select("funder", "name", F.col("n_recipients").cast("long"), F.col("total").cast("double"), F.round("concentration", 6).alias("concentration"), F.size("years").cast("long").alias("years_active"))


@query("funding_recipients_topn", f"""WITH {FUNDED}, {ORGS} SELECT src AS id, name, CAST(amount AS DOUBLE) AS amount, fiscal_year
FROM funded JOIN orgs ON id = src WHERE dst = 'S1' AND amount >= 1000 ORDER BY amount DESC, src, fiscal_year LIMIT 20""")
def funding_recipients_topn(spark, sf_dir):
    return G.top_partners(D.funded_by(spark, sf_dir), D.organisations(spark, sf_dir), "S1", "dst", 20, 1000).withColumn("amount", F.col("amount").cast("double"))


@query("funding_sources_topn", f"""WITH {FUNDED}, {ORGS} SELECT dst AS id, name, CAST(amount AS DOUBLE) AS amount, fiscal_year
FROM funded JOIN orgs ON id = dst WHERE src = 'C1' ORDER BY amount DESC, dst, fiscal_year LIMIT 20""")
def funding_sources_topn(spark, sf_dir):
    return G.top_partners(D.funded_by(spark, sf_dir), D.organisations(spark, sf_dir), "C1", "src", 20).withColumn("amount", F.col("amount").cast("double"))


@query("shared_directors", f"""WITH {DIRECTORS} SELECT src AS person, count(*) AS n_boards, array_to_string(list_sort(list(dst)), ',') AS boards
FROM directors WHERE dst IN ('S1','S2','S3','S4','S5','S6','S7','S8') GROUP BY src HAVING count(*) >= 2""")
def shared_directors(spark, sf_dir):
    boards = spark.createDataFrame([(f"S{i}",) for i in range(1, 9)], "id string")
    return G.shared_directors(D.director_of(spark, sf_dir), boards, 2).select("person", F.col("n_boards").cast("long"), listed("boards").alias("boards"))


@query("board_interlocks", f"""WITH {DIRECTORS} SELECT o.dst AS other, count(DISTINCT o.src) AS n_people
FROM directors o WHERE o.dst <> 'S1' AND o.src IN (SELECT src FROM directors WHERE dst = 'S1') GROUP BY o.dst""")
def board_interlocks(spark, sf_dir):
    return G.board_interlocks(D.director_of(spark, sf_dir), "S1").select("other", F.col("n_people").cast("long"))


@query("entity_stats", f"""WITH {FUNDED}, {DIRECTORS}, {ORGS},
o AS (SELECT src AS id, count(*) AS n_out, count(DISTINCT dst) AS n_funders FROM funded GROUP BY src),
i AS (SELECT dst AS id, count(*) AS n_in, count(DISTINCT src) AS n_recipients FROM funded GROUP BY dst),
d AS (SELECT dst AS id, count(DISTINCT src) AS n_directors FROM directors GROUP BY dst)
SELECT id, coalesce(n_out, 0) AS n_out, coalesce(n_funders, 0) AS n_funders, coalesce(n_in, 0) AS n_in, coalesce(n_recipients, 0) AS n_recipients, coalesce(n_directors, 0) AS n_directors
FROM orgs LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN d USING (id)""")
def entity_stats(spark, sf_dir):
    return G.entity_stats(D.organisations(spark, sf_dir), D.funded_by(spark, sf_dir), D.director_of(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    funded = D.funded_by(spark, sf_dir).select("src", "dst", F.lit("FUNDED_BY").alias("rel_type"), "valid_from", "valid_to")
    seats = D.director_of(spark, sf_dir).select("src", "dst", F.lit("DIRECTOR_OF").alias("rel_type"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return funded.unionByName(seats)


TYPED = FUNDED + ", " + DIRECTORS + """, edges AS (SELECT src, dst, 'FUNDED_BY' AS rel_type, valid_from, valid_to FROM funded
  UNION ALL SELECT src, dst, 'DIRECTOR_OF', NULL, NULL FROM directors)"""


@query("entity_relationships", f"""WITH {TYPED} SELECT rel_type, direction, other, count(*) AS n FROM (
  SELECT rel_type, 'out' AS direction, dst AS other FROM edges WHERE src = 'S3' UNION ALL SELECT rel_type, 'in', src FROM edges WHERE dst = 'S3') GROUP BY ALL""")
def entity_relationships(spark, sf_dir):
    return G.adjacent(typed(spark, sf_dir), "S3", "both", ["FUNDED_BY", "DIRECTOR_OF"]).groupBy("rel_type", "direction", "other").agg(F.count("*").alias("n"))


@query("entity_relationships_as_of", f"""WITH {TYPED} SELECT rel_type, src AS other FROM edges
WHERE dst = 'S3' AND (valid_from IS NULL OR valid_from <= DATE '1997-06-30') AND (valid_to IS NULL OR valid_to > DATE '1997-06-30')""")
def entity_relationships_as_of(spark, sf_dir):
    return G.adjacent(typed(spark, sf_dir), "S3", "in").where(G.valid_at("1997-06-30")).select("rel_type", "other")


@query("recipient_pairs_shared_funders", f"""WITH {FUNDED}, y AS (SELECT DISTINCT src, dst FROM funded WHERE fiscal_year = {YEAR})
SELECT a.src AS a, b.src AS b, count(*) AS shared FROM y a JOIN y b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 5""")
def recipient_pairs_shared_funders(spark, sf_dir):
    return G.recipient_pairs(D.funded_by(spark, sf_dir, YEAR), 5)


@query("network_metrics", f"""WITH {FUNDED}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM funded),
n AS (SELECT count(*) AS n FROM (SELECT a FROM s UNION SELECT b FROM s)), e AS (SELECT count(*) AS m FROM s)
SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / (n * (n - 1)), 6) AS density, round(2.0 * m / n, 6) AS mean_degree FROM n, e""")
def network_metrics(spark, sf_dir):
    return G.network_metrics(D.funded_by(spark, sf_dir)).withColumn("density", F.round("density", 6)).withColumn("mean_degree", F.round("mean_degree", 6))


@query("degree_top", f"""WITH {FUNDED}, s AS (SELECT DISTINCT src, dst FROM funded)
SELECT id, count(*) AS degree FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id ORDER BY degree DESC, id LIMIT 50""")
def degree_top(spark, sf_dir):
    pairs = D.funded_by(spark, sf_dir).select("src", "dst").distinct()
    return pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(50)


@query("entity_search", f"""WITH {ORGS} SELECT id, name, confidence FROM orgs WHERE lower(name) LIKE '%00001%' AND lower(jurisdiction) = 'asia'
ORDER BY confidence DESC, name, id LIMIT 20 OFFSET 2""")
def entity_search(spark, sf_dir):
    return G.search_entities(D.organisations(spark, sf_dir), "00001", "Asia", 2, 20).select("id", "name", "confidence")


@query("autocomplete", f"""WITH {ORGS} SELECT id, name, CASE WHEN starts_with(lower(name), 'supplier') THEN 0 ELSE 1 END AS rank, confidence
FROM orgs WHERE contains(lower(name), 'supplier') ORDER BY rank, confidence DESC, name, id LIMIT 10""")
def autocomplete(spark, sf_dir):
    return G.autocomplete(D.organisations(spark, sf_dir), "Supplier")


@query("registry_search", f"""WITH {ORGS}, s AS (SELECT id, name, CASE WHEN lower(id) = 'customer 12' THEN 100 WHEN starts_with(lower(name), 'customer 12') THEN 90
  WHEN contains(lower(name), 'customer') AND contains(lower(name), '12') THEN 70 WHEN contains(lower(name), 'customer 12') THEN 60 END AS score FROM orgs)
SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 20""")
def registry_search(spark, sf_dir):
    return G.registry_search(D.organisations(spark, sf_dir).select("id", "name"), "customer 12")


@query("federated_search", """WITH s AS (SELECT 'customer' AS source, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part),
m AS (SELECT DISTINCT source, name FROM s WHERE contains(lower(name), 'e')), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY name) AS n FROM m)
SELECT source, name, CAST(n AS INTEGER) AS n FROM r WHERE n <= 5""")
def federated_search(spark, sf_dir):
    sources = [("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")]
    rows = None
    for source, column in sources:
        own = D.table(spark, sf_dir, source).where(F.lower(column).contains("e")).select(F.lit(source).alias("source"), F.col(column).alias("name")).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("name"))).where("n <= 5")


@query("keyset_page", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey > 10) ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def keyset_page(spark, sf_dir):
    after = (F.col("c_acctbal") < 5000) | ((F.col("c_acctbal") == 5000) & (F.col("c_custkey") > 10))
    return D.table(spark, sf_dir, "customer").where(after).orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name", "c_acctbal")
