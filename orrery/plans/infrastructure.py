"""Queries over shared infrastructure: pages' hosts, and written-out profiles for what the tables do not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import infrastructure as I
from orrery.plans import domain as D

HTML = [
    ("a.example", "<script>ga('create','UA-12345-1');</script> GTM-ABC123 wp-content/x"),
    ("b.example", "ua-12345-1 G-ABCDEFGHIJ ca-pub-1234567890123456"),
    ("c.example", "fbq('init', '123456789012345') gtm-abc123 Joomla! wix.com"),
    ("d.example", "ca-pub-1234567890123456 fbq( \"init\" , \"123456789012345\" )"),
    ("e.example", "nothing here"),
]
ROWS = ", ".join("('" + d + "', '" + h.replace("'", "''") + "')" for d, h in HTML)
TAGS = " UNION ALL ".join(f"""SELECT domain, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(html, '(?i){p.replace("'", "''")}', 1))) AS value FROM v""" for k, p in I.TAGS.items())
SYSTEM = "CASE " + " ".join(f"WHEN regexp_matches(html, '(?i){p}') THEN '{n}'" for p, n in I.CMS.items()) + " END"
SIGNALS = f"v AS (SELECT * FROM (VALUES {ROWS}) t(domain, html)), t AS ({TAGS} UNION ALL SELECT domain, 'cms', {SYSTEM} FROM v WHERE {SYSTEM} IS NOT NULL)"
WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in I.WEIGHTS.items()) + " END"


def pages(spark):
    return spark.createDataFrame(HTML, "domain string, html string")


@query("infra_tags", f"WITH {SIGNALS} SELECT domain, kind, value FROM t")
def infra_tags(spark, sf_dir):
    return I.page_tags(pages(spark))


PAIRS = SIGNALS + f""", p AS (SELECT a.domain AS a, b.domain AS b, CAST(sum({WEIGHT.replace("kind", "a.kind")}) AS DOUBLE) AS score, array_to_string(list_sort(list(a.kind || '=' || a.value)), ';') AS signals,
  list(a.kind) AS kinds FROM t a JOIN t b ON a.kind = b.kind AND a.value = b.value AND a.domain < b.domain GROUP BY ALL)"""


@query("infra_pairs", f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score, round(least(1.0, score / 10), 6) AS confidence, signals FROM p")
def infra_pairs(spark, sf_dir):
    rows = I.shared(I.page_tags(pages(spark)))
    return rows.select("a", "b", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.array_join("signals", ";").alias("signals"))


@query("infra_edges", f"WITH {PAIRS} SELECT a AS src, b AS dst, round(score / 10, 6) AS confidence, CASE WHEN list_has_any(kinds, ['analytics', 'gtm', 'pixel', 'adsense']) THEN 'analytics' ELSE 'infrastructure' END AS category FROM p WHERE score / 10 >= 0.3")
def infra_edges(spark, sf_dir):
    return I.infra_edges(I.shared(I.page_tags(pages(spark)))).select("src", "dst", F.round("confidence", 6).alias("confidence"), "category")


PROFILES = [
    ("a.example", "GoDaddy.com, LLC", ["NS1.X.NET.", "ns2.x.net"], ["104.16.1.1"], ["AS13335"], "R3", ["a.example", "shared.example"]),
    ("b.example", "godaddy", ["ns1.x.net"], ["52.1.2.3"], ["AS13335"], "R3", ["b.example", "www.b.example", "shared.example"]),
    ("c.example", " Own Registrar ", ["ns9.y.net"], ["104.16.1.1"], [], None, ["c.example"]),
    ("d.example", None, [], [], [], "E1", []),
]


@query("infra_profiles", """SELECT * FROM (VALUES ('a.example', 'b.example', CAST(0.5 + 1.5 + 0.5 + 0.3 + 4.0 AS DOUBLE), 'asn;nameserver;registrar;san;ssl_issuer'), ('a.example', 'c.example', CAST(3.0 AS DOUBLE), 'ip')) t(a, b, score, kinds)""")
def infra_profiles(spark, sf_dir):
    rows = spark.createDataFrame(PROFILES, "domain string, registrar string, nameservers array<string>, ips array<string>, asns array<string>, issuer string, sans array<string>")
    return I.shared(I.profile_signals(rows)).select("a", "b", F.round("score", 6).alias("score"), F.array_join("kinds", ";").alias("kinds"))


HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("infra_hosts", f"""SELECT {HOST} AS host, count(*) AS n_pages, sum(CASE WHEN regexp_matches(html, '(?i)UA-\\d{{4,10}}-\\d{{1,4}}|G-[A-Z0-9]{{10,}}') THEN 1 ELSE 0 END)::BIGINT AS n_tagged,
  sum(CASE WHEN {SYSTEM} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_no_cms FROM pages GROUP BY ALL""")
def infra_hosts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), (F.size(I.tags(F.col("html"), "analytics")) > 0).alias("tagged"), I.cms(F.col("html")).isNull().alias("no_cms"))
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum(F.col("tagged").cast("long")).alias("n_tagged"), F.sum(F.col("no_cms").cast("long")).alias("n_no_cms"))


@query("certificate_fingerprints", "SELECT c_custkey, substr(sha256('CN=' || c_mktsegment || ':' || array_to_string(list_sort([c_name, c_mktsegment]), ',')), 1, 16) AS fingerprint FROM customer")
def certificate_fingerprints(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").select("c_custkey", I.certificate(F.concat(F.lit("CN="), "c_mktsegment"), F.array("c_name", "c_mktsegment")).alias("fingerprint"))


BUILT = "CASE page_id % 4 WHEN 0 THEN '<script src=/jquery.min.js>' WHEN 1 THEN '<div NG-APP>__vue__' WHEN 2 THEN '/_next/static/react.production.js' ELSE '' END"


@query("page_technologies", f"""WITH p AS (SELECT page_id, html || {BUILT} AS h FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(h, '(?i)react\\.production|__REACT_DEVTOOLS') THEN 'React' END, CASE WHEN regexp_matches(h, '(?i)vue\\.js|__VUE__') THEN 'Vue.js' END, CASE WHEN regexp_matches(h, '(?i)ng-app|angular\\.js') THEN 'Angular' END,
  CASE WHEN regexp_matches(h, '(?i)jquery\\.js|jquery\\.min\\.js') THEN 'jQuery' END, CASE WHEN regexp_matches(h, '(?i)_next/static|__NEXT_DATA__') THEN 'Next.js' END, CASE WHEN regexp_matches(h, '(?i)cloudflareinsights|cf-ray') THEN 'Cloudflare' END) AS built_with FROM p""")
def page_technologies(spark, sf_dir):
    turn = F.col("page_id") % 4
    more = F.when(turn == 0, "<script src=/jquery.min.js>").when(turn == 1, "<div NG-APP>__vue__").when(turn == 2, "/_next/static/react.production.js").otherwise("")
    return D.table(spark, sf_dir, "pages").select("page_id", F.array_join(I.technologies(F.concat("html", more)), ",").alias("built_with"))
