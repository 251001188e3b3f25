"""Queries of reports, texts and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.functions import text as T
from orrery.operators import reports as R
from orrery.plans import domain as D
from orrery.plans.domain import FUNDED, ORGS


@query("rank_entities", f"WITH {FUNDED}, {ORGS}, n AS (SELECT src AS id, count(*) AS n FROM funded GROUP BY src) SELECT id, round(1.0 / (length(name) % 3 + 1) * confidence * (1 + 0.1 * n), 6) AS score FROM orgs JOIN n USING (id) ORDER BY score DESC, id LIMIT 50")
def rank_entities(spark, sf_dir):
    n = D.funded_by(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    rows = D.organisations(spark, sf_dir).join(n, "id")
    score = R.entity_rank(F.length("name") % 3, F.col("confidence"), F.col("n"))
    return rows.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("rank_relationships", f"WITH {FUNDED} SELECT src, dst, fiscal_year, round(0.9 * (ln(CAST(amount AS DOUBLE) + 1) + 1) * 1.5, 6) AS score FROM funded ORDER BY amount DESC, src, dst, fiscal_year LIMIT 50")
def rank_relationships(spark, sf_dir):
    best = D.funded_by(spark, sf_dir).orderBy(F.desc("amount"), "src", "dst", "fiscal_year").limit(50)
    score = R.relationship_rank(F.lit("FUNDED_BY"), F.col("amount").cast("double"), F.lit(0.9))
    return best.select("src", "dst", "fiscal_year", F.round(score, 6).alias("score"))


@query("cross_border_flags", f"""WITH {FUNDED}, {ORGS}, y AS (SELECT DISTINCT src, dst FROM funded WHERE fiscal_year = 1996)
SELECT DISTINCT CASE WHEN a.jurisdiction = 'ASIA' THEN src ELSE dst END AS first_id, CASE WHEN a.jurisdiction = 'ASIA' THEN dst ELSE src END AS second_id, 'FUNDED_BY' AS rel_type
FROM y JOIN orgs a ON a.id = src JOIN orgs b ON b.id = dst WHERE (a.jurisdiction, b.jurisdiction) IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA'))""")
def cross_border_flags(spark, sf_dir):
    edges = D.funded_by(spark, sf_dir, 1996).select("src", "dst", F.lit("FUNDED_BY").alias("rel_type"))
    return R.cross_border(edges, D.organisations(spark, sf_dir), "ASIA", "EUROPE")


STOP = ["that", "with", "this", "from"]


@query("ad_themes", """WITH w AS (SELECT regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '[^\\p{L}\\p{N}]', '', 'g') AS word FROM conversations)
SELECT word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ('that', 'with', 'this', 'from') GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 10""")
def ad_themes(spark, sf_dir):
    return R.top_words(D.table(spark, sf_dir, "conversations"), "text", STOP)


def ads(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    return e.select(F.col("event_id").alias("ad_id"), F.floor("value").cast("long").alias("spend_low"), F.ceil("value").cast("long").alias("spend_high"), F.concat(F.lit("s"), F.col("user_id") % 20).alias("sponsor"), F.col("event_type").alias("platform"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("r"), F.col("user_id") % 4)).alias("region"), F.to_date("ts").alias("day"))


ADS = "a AS (SELECT event_id AS ad_id, CAST(floor(value) AS BIGINT) AS lo, CAST(ceil(value) AS BIGINT) AS hi, 's' || user_id % 20 AS sponsor, event_type AS platform, CASE WHEN user_id % 4 > 0 THEN 'r' || user_id % 4 END AS region, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'click'))"


@query("ad_summary", f"WITH {ADS} SELECT count(*) AS n_ads, CAST(sum(lo) AS BIGINT) AS spend_low, CAST(sum(hi) AS BIGINT) AS spend_high, count(DISTINCT sponsor) AS n_sponsors, count(DISTINCT platform) AS n_platforms, min(day) AS first, max(day) AS last FROM a")
def ad_summary(spark, sf_dir):
    return R.ad_summary(ads(spark, sf_dir))


@query("ad_groups", f"""WITH {ADS}, g AS (SELECT 'sponsor' AS kind, sponsor AS value, 0.85 AS confidence, ad_id FROM a UNION ALL SELECT 'region', region, 0.5, ad_id FROM a WHERE region IS NOT NULL)
SELECT kind, value, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n_ads, array_to_string(list_slice(list_sort(list(ad_id)), 1, 5), ',') AS first_ads FROM g GROUP BY kind, value, confidence
HAVING kind = 'sponsor' OR count(*) >= 3 ORDER BY confidence DESC, n_ads DESC, value LIMIT 10""")
def ad_groups(spark, sf_dir):
    return R.ad_groups(ads(spark, sf_dir)).withColumn("first_ads", F.array_join("first_ads", ","))


@query("evidence_index", """WITH p AS (SELECT o_orderkey % 500 AS evidence_id, 0 AS part, 'C' || o_custkey AS used_by FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey % 700, 1, 'S' || l_suppkey FROM lineitem)
SELECT evidence_id, part, min(used_by) AS used_by FROM (SELECT *, min(part) OVER (PARTITION BY evidence_id) AS m FROM p) WHERE part = m GROUP BY evidence_id, part""")
def evidence_index(spark, sf_dir):
    a = D.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 500).alias("evidence_id"), F.concat(F.lit("C"), "o_custkey").alias("used_by"))
    b = D.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 700).alias("evidence_id"), F.concat(F.lit("S"), "l_suppkey").alias("used_by"))
    return R.evidence_index([a, b])


@query("severity", """SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'critical' WHEN l_discount * 10 >= 0.6 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END AS concentration,
  CASE WHEN l_linenumber >= 5 THEN 'high' WHEN l_linenumber >= 3 THEN 'medium' ELSE 'low' END AS overlap, count(*) AS n FROM lineitem GROUP BY ALL""")
def severity(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").select(R.concentration_severity(F.col("l_discount") * 10).alias("concentration"), R.overlap_severity(F.col("l_linenumber")).alias("overlap"))
    return rows.groupBy("concentration", "overlap").agg(F.count("*").alias("n"))


LOADED = "The secret scheme and coordinated propaganda of a front group: "


def neutral_sql(column: str) -> str:
    for pattern, words in T.NEUTRAL:
        column = f"regexp_replace({column}, '{pattern}', '{words.replace('$1', chr(92) + '1')}', 'gi')"
    return column


@query("neutral_language", f"SELECT conv_id, turn, {neutral_sql(chr(39) + LOADED + chr(39) + ' || text')} AS neutral FROM conversations")
def neutral_language(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.neutral(F.concat(F.lit(LOADED), "text")).alias("neutral"))


@query("text_kinds", """WITH h AS (SELECT lower(substr(text, 1, 500)) AS h, length(trim(text, ' ')) AS n FROM conversations)
SELECT CASE WHEN contains(h, 'linkedin') THEN 'linkedin' WHEN starts_with(h, 'from:') OR contains(substr(h, 1, 200), 'subject:') THEN 'email' WHEN contains(h, 'reuters') OR contains(h, 'associated press') OR contains(h, 'ap news') THEN 'news'
  WHEN contains(h, 'for immediate release') THEN 'press_release' ELSE 'unknown' END AS kind, n >= 10 AND n <= 100000 AS valid, count(*) AS n FROM h GROUP BY ALL""")
def text_kinds(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations").select(T.text_kind(F.col("text")).alias("kind"), T.text_valid(F.col("text")).alias("valid"))
    return rows.groupBy("kind", "valid").agg(F.count("*").alias("n"))


@query("page_text", """SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#\\s]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b.*?</nav\\s*>', ' ', 'g'), '(?is)<footer\\b.*?</footer\\s*>', ' ', 'g'), '(?is)<header\\b.*?</header\\s*>', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_chars FROM pages""")
def page_text(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), F.char_length(T.plain_text(F.col("html"))).cast("long").alias("n_chars"))


@query("extract_entities")
def extract_entities(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.entities(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.kind", "e.value", "e.confidence", "e.start")


RAW = ["Business Corporation", "Non-Profit OBNL", "agricultural society", "Coop", "", "Unlimited"]
RAW_SQL = ", ".join(f"({i}, '{v}')" for i, v in enumerate(RAW))


@query("corp_types", f"""SELECT id, CASE WHEN contains(t, 'non-profit') OR contains(t, 'obnl') THEN 'NONPROFIT' WHEN contains(t, 'coop') THEN 'COOPERATIVE' WHEN contains(t, 'society') THEN 'SOCIETY' WHEN contains(t, 'unlimited') THEN 'UNLIMITED_LIABILITY'
  WHEN contains(t, 'business') THEN 'FOR_PROFIT' ELSE 'UNKNOWN' END AS corp_type FROM (SELECT id, lower(v) AS t FROM (VALUES {RAW_SQL}) t(id, v))""")
def corp_types(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(RAW)), "id int, v string")
    return rows.select("id", T.corp_type(F.col("v")).alias("corp_type"))
