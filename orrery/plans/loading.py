"""Queries of loading: incremental reads, upserts, run tracking, records to edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.plans import domain as D
from orrery.sources import files as S, records as R, upserts as U


@query("incremental_by_mark", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'")
def incremental_by_mark(spark, sf_dir):
    return U.since(D.table(spark, sf_dir, "orders"), "o_orderdate", "2001-01-01").select("o_orderkey", "o_custkey")


@query("incremental_by_hash", """WITH r AS (SELECT c_custkey, c_name AS name, md5(c_name || '|' || coalesce(c_mktsegment, '') || '|' || c_nationkey) AS record_hash FROM customer)
SELECT c_custkey, record_hash FROM r WHERE c_custkey % 3 > 0""")
def incremental_by_hash(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment", "c_nationkey")
    known = rows.where("c_custkey % 3 = 0").withColumn("record_hash", F.md5(F.concat_ws("|", "name", "c_mktsegment", "c_nationkey")))
    return U.changed_records(rows, known, ["name", "c_mktsegment", "c_nationkey"]).select("c_custkey", "record_hash")


@query("latest_run_per_source", "SELECT user_id AS source, event_id AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST) AS r FROM events) WHERE r = 1")
def latest_run_per_source(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("run_id"), "ts")
    return U.latest(rows, "source", "ts").select("source", "run_id")


@query("source_health", """WITH r AS (SELECT 's' || user_id AS source, CASE WHEN user_id % 10 > 0 THEN ts END AS completed_at, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'partial' END AS status FROM events),
l AS (SELECT source, max(completed_at) AS c, max_by(status, completed_at) AS s FROM r GROUP BY source)
SELECT source, CASE WHEN c IS NULL THEN 'never_run' WHEN datesub('hour', c, TIMESTAMP '2024-02-01') > 168 THEN 'stale' WHEN s = 'completed' THEN 'healthy' ELSE 'unknown' END AS health FROM l""")
def source_health(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    runs = e.select(F.concat(F.lit("s"), "user_id").alias("source"), F.when(F.col("user_id") % 10 > 0, F.col("ts")).alias("completed_at"), F.when(F.col("event_id") % 2 == 0, "completed").otherwise("partial").alias("status"))
    return U.source_health(runs, F.lit("2024-02-01").cast("timestamp_ntz")).select("source", "health")


@query("ingest_counts", """SELECT event_type AS source, count(*) AS records, sum(CASE WHEN o = 0 THEN 1 ELSE 0 END)::BIGINT AS created, sum(CASE WHEN o = 1 THEN 1 ELSE 0 END)::BIGINT AS errors, CASE WHEN sum(CASE WHEN o = 1 THEN 1 ELSE 0 END) = 0 THEN 'completed' ELSE 'partial' END AS status
FROM (SELECT event_type, CASE WHEN value > 95 THEN 1 ELSE 0 END AS o FROM events) GROUP BY ALL""")
def ingest_counts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 95, "error").otherwise("created").alias("outcome"))
    return U.ingest_counts(rows).select("source", "records", "created", "errors", "status")


@query("upsert_edges", """WITH o AS (SELECT o_custkey AS src, o_orderstatus AS dst, o_orderkey AS version, o_totalprice AS amount, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS note FROM orders)
SELECT src, dst, max(version) AS version, max_by(amount, version) AS amount, max_by(note, version) FILTER (note IS NOT NULL) AS note FROM o GROUP BY ALL""")
def upsert_edges(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"))
    return U.upsert(o.where("version % 3 = 0"), o.where("version % 3 <> 0"), ["src", "dst"], "version")


@query("registrations_with_children", "SELECT o_orderkey AS reg_id, count(DISTINCT l_returnflag || l_linestatus) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def registrations_with_children(spark, sf_dir):
    main = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reg_id"))
    subjects = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reg_id"), F.concat("l_returnflag", "l_linestatus").alias("subject"))
    return R.registrations(main, subjects).select("reg_id", F.size("subjects").cast("long").alias("n"))


@query("target_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'auto')")
def target_filter(spark, sf_dir):
    return R.targeted(D.table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], ["00012", "AUTO"]).select("c_custkey")


FILINGS = [
    ("12-3456789", "Funder Inc", 2021, [("ann lee", None), ("Bo Ray", "Board Chair"), ("Cy Poe", "Manager")], [("X Foundation", "98-7654321", None, 10.0), ("Nord Verein", None, "DE", 5.0), ("Plain Co", None, "US", 1.0)]),
]


@query("filing_edges", """SELECT * FROM (VALUES ('DIRECTOR_OF', 'P:ANN LEE', NULL::DOUBLE, 1.0::DOUBLE), ('DIRECTOR_OF', 'P:BO RAY', NULL, 1.0), ('EMPLOYED_BY', 'P:CY POE', NULL, 1.0), ('FUNDED_BY', 'EIN:987654321', 10.0, 1.0),
('FUNDED_BY', 'ORG:DE:NORD VEREIN', 5.0, 0.8), ('FUNDED_BY', 'ORG:PLAIN', 1.0, 0.8)) t(rel_type, src, amount, confidence)""")
def filing_edges(spark, sf_dir):
    from orrery.schemas import FILING

    rows = spark.createDataFrame([(e, n, y, "NY", o, g) for e, n, y, o, g in FILINGS], FILING)
    return R.filing_edges(rows).select("rel_type", "src", "amount", "confidence")


@query("charity_star", """WITH l AS (SELECT o_custkey AS bn, max(o_orderdate) AS fiscal_end FROM orders GROUP BY ALL),
g AS (SELECT o_custkey AS bn, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_custkey AS bn, 'CA-' || c_mktsegment AS jurisdiction, fiscal_end, coalesce(n, 0) AS n_donees FROM customer LEFT JOIN l ON l.bn = c_custkey LEFT JOIN g ON g.bn = c_custkey""")
def charity_star(spark, sf_dir):
    charities = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bn"), F.col("c_mktsegment").alias("province"))
    orders = D.table(spark, sf_dir, "orders")
    financials = orders.select(F.col("o_custkey").alias("bn"), F.col("o_orderdate").alias("fiscal_end"), F.col("o_totalprice").alias("revenue"))
    donees = D.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("bn"), F.col("l_suppkey").alias("donee"), F.col("l_extendedprice").alias("amount"))
    return R.charity_star(charities, financials, donees).select("bn", "jurisdiction", "fiscal_end", F.size("donees").cast("long").alias("n_donees"))


@query("submission_filings", """SELECT o_custkey AS cik, o_orderkey AS accession, CASE o_orderkey % 3 WHEN 0 THEN 'SC 13D' WHEN 1 THEN 'SCHEDULE 13G/A' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) AS filed, o_orderkey % 3 < 2 AS is_ownership FROM orders""")
def submission_filings(spark, sf_dir):
    k = F.col("o_orderkey")
    form = F.when(k % 3 == 0, "SC 13D").when(k % 3 == 1, "SCHEDULE 13G/A").otherwise("10-K")
    own = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct(k.alias("a"), form.alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))).alias("r"))
    recent = F.struct(F.col("r.a").alias("accessionNumber"), F.col("r.f").alias("form"), F.col("r.d").alias("filingDate"))
    return R.submission_filings(own.select("cik", F.struct(recent.alias("recent")).alias("filings")))


@query("upsert_undirected", """WITH o AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, o_orderkey AS version, o_totalprice AS amount FROM orders)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(version) AS version, max_by(amount, version) AS amount FROM o GROUP BY least(src, dst), greatest(src, dst)""")
def upsert_undirected(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("amount"))
    return U.upsert_undirected(o.where("version % 3 = 0"), o.where("version % 3 <> 0"), "version")


@query("archive_keys", "SELECT o_orderkey, o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m') || '/' || o_orderkey || '.xml' AS key FROM orders")
def archive_keys(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select("o_orderkey", S.archive_key(F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_orderkey").cast("string"), "xml").alias("key"))


@query("node_keys", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ein:' || (100000000 + c_custkey) WHEN 1 THEN 'bn:B' || c_custkey WHEN 2 THEN 'id:' || c_custkey ELSE 'name:' || regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') END AS key FROM customer""")
def node_keys(spark, sf_dir):
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(k, F.when(k % 4 == 0, F.concat_ws("-", F.lit("10"), F.lpad(k.cast("string"), 7, "0"))).alias("ein"), F.when(k % 4 == 1, F.concat(F.lit("b "), k)).alias("bn"), F.when(k % 4 == 2, k.cast("string")).alias("id"), F.col("c_name").alias("name"))
    return rows.select("c_custkey", U.node_key().alias("key"))


@query("ad_edges", """SELECT 'PAGE:' || o_custkey AS src, CASE o_orderkey % 4 WHEN 0 THEN 15.0 WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 END::DOUBLE AS amount, CAST(o_orderdate AS DATE) AS valid_from, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL""")
def ad_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    spend = F.struct(F.when((k % 4).isin(0, 1), "10").alias("lower_bound"), F.when((k % 4).isin(0, 2), "20").alias("upper_bound"))
    ads = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("page_id"), F.when(F.col("o_orderstatus") != "F", "Some Sponsor Inc").alias("funding_entity"), spend.alias("spend"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ad_delivery_start_time"))
    return R.ad_edges(ads).groupBy("src", "amount", "valid_from").agg(F.count("*").alias("n"))


@query("current_children", "SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL")
def current_children(spark, sf_dir):
    """Of each order's lines the one marked current: the dearest of those numbered 1."""
    marked = F.struct((-F.col("l_extendedprice")).alias("o"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") == 1, "true").alias("_current"))
    rows = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(marked)).alias("children"))
    return rows.select("l_orderkey", R.current_child(F.col("children"))["price"].alias("price")).where("price IS NOT NULL")


@query("separators", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS separator FROM customer")
def separators(spark, sf_dir):
    sep = F.get(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("c_custkey") % 4).cast("int"))
    return D.table(spark, sf_dir, "customer").select("c_custkey", S.sniffed_separator(F.concat(F.lit("id"), sep, F.lit("name"), sep, F.col("c_mktsegment"))).alias("separator"))


@query("organisation_types", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'nonprofit' WHEN 1 THEN 'political_org' WHEN 2 THEN 'corporation' WHEN 3 THEN 'unknown' WHEN 4 THEN 'corporation' ELSE 'unknown' END AS kind FROM part""")
def organisation_types(spark, sf_dir):
    given = F.array(*[F.array(*map(F.lit, x)) for x in (["Newspaper", "Philanthropy"], ["LawFirm", "PoliticalParty"], ["School", "Business"], ["University", "LawFirm"], ["Newspaper", "Other"], ["Other", "None"])])
    return D.table(spark, sf_dir, "part").select("p_partkey", R.organisation_type(F.get(given, (F.col("p_partkey") % 6).cast("int"))).alias("kind"))
