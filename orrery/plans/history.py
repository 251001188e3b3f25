"""Queries over the graph in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import history as H
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED

AT = "(valid_from IS NULL OR valid_from <= DATE '{0}') AND (valid_to IS NULL OR valid_to > DATE '{0}')"
A, B = AT.format("1996-07-01"), AT.format("1997-07-01")


@query("graph_as_of", f"""WITH {FUNDED}, s AS (SELECT * FROM funded WHERE {A}), e AS (SELECT src AS node, 1 AS o FROM s UNION ALL SELECT dst, 0 FROM s)
SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in FROM e GROUP BY node""")
def graph_as_of(spark, sf_dir):
    return H.degrees_at(D.funded_by(spark, sf_dir), "1996-07-01")


@query("entities_as_of", f"""WITH {FUNDED} SELECT src AS node, min(valid_from) AS created FROM funded GROUP BY src HAVING min(valid_from) IS NULL OR min(valid_from) <= DATE '1995-06-30'""")
def entities_as_of(spark, sf_dir):
    first = D.funded_by(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.min("valid_from").alias("created"))
    return first.where(F.col("created").isNull() | (F.col("created") <= F.lit("1995-06-30").cast("date")))


@query("graph_diff", f"""WITH {FUNDED}, a AS (SELECT src, dst, sum(amount) AS x FROM funded WHERE {A} GROUP BY ALL), b AS (SELECT src, dst, sum(amount) AS y FROM funded WHERE {B} GROUP BY ALL)
SELECT src, dst, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (src, dst) WHERE x IS DISTINCT FROM y""")
def graph_diff(spark, sf_dir):
    return H.diff(D.funded_by(spark, sf_dir), "1996-07-01", "1997-07-01").select("src", "dst", "change")


@query("relationship_changes", f"""WITH {FUNDED}, o AS (SELECT src AS other, valid_from, CASE WHEN valid_from = valid_to THEN NULL ELSE valid_to END AS valid_to FROM funded WHERE dst = 'S1')
SELECT other, CASE WHEN valid_from >= DATE '2000-01-01' THEN 'added' ELSE 'removed' END AS change, valid_from AS changed_at FROM o
WHERE valid_from >= DATE '2000-01-01' OR valid_to >= DATE '2000-01-01'""")
def relationship_changes(spark, sf_dir):
    edges = D.funded_by(spark, sf_dir).withColumn("valid_to", F.when(F.col("valid_from") != F.col("valid_to"), F.col("valid_to"))).withColumn("updated_at", F.lit(None).cast("date"))
    return H.changes_since(edges, "S1", "2000-01-01")


@query("relationship_timeline", f"""WITH {FUNDED}, o AS (SELECT src, dst, valid_from, CASE WHEN valid_from = valid_to THEN NULL ELSE valid_to END AS valid_to FROM funded WHERE dst IN ('S1', 'S2'))
SELECT src, dst, count(*) AS n_periods, min(valid_from) AS first, max(coalesce(valid_to, DATE '2002-01-01')) AS last,
  CAST(sum(datediff('day', valid_from, coalesce(valid_to, DATE '2002-01-01'))) AS BIGINT) AS total_days, bool_or(valid_to IS NULL OR valid_to > DATE '2002-01-01') AS active FROM o GROUP BY ALL""")
def relationship_timeline(spark, sf_dir):
    edges = D.funded_by(spark, sf_dir).where(F.col("dst").isin("S1", "S2")).withColumn("valid_to", F.when(F.col("valid_from") != F.col("valid_to"), F.col("valid_to")))
    return H.timeline(edges, "2002-01-01")


@query("entity_history", f"""WITH {FUNDED}, d AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 30 DAY)) AS DATE) AS day), o AS (SELECT * FROM funded WHERE src = 'S1' OR dst = 'S1')
SELECT day, count(src) AS n FROM d LEFT JOIN o ON (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to > day) GROUP BY day""")
def entity_history(spark, sf_dir):
    return H.entity_history(D.funded_by(spark, sf_dir), "S1", "1996-01-01", "1998-01-01")


@query("cochange_patterns", f"""WITH {FUNDED}, m AS (SELECT strftime(valid_from, '%Y-%m') AS month, src, dst FROM funded), t AS (SELECT month, dst, count(DISTINCT src) AS n FROM m GROUP BY ALL),
s AS (SELECT month, count(DISTINCT src) AS n_sources FROM m GROUP BY ALL HAVING count(DISTINCT src) >= 2)
SELECT month, n_sources, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_shared_targets FROM s JOIN t USING (month) GROUP BY ALL""")
def cochange_patterns(spark, sf_dir):
    return H.cochange(D.funded_by(spark, sf_dir))
