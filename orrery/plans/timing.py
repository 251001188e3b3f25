"""Queries over the timing of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalog import query
from orrery.operators import timing as T
from orrery.plans import domain as D
from orrery.plans.domain import EVENTS

def events(spark, sf_dir):
    return D.timing_events(spark, sf_dir)


@query("event_gaps", f"""WITH {EVENTS} SELECT event_id, entity_id, gap_us, gap_us > 6000000 AND gap_us < 3600000000 AS close FROM (
SELECT event_id, entity_id, greatest(6000000, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity_id ORDER BY ts, event_id)) AS gap_us, lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS p FROM ev) WHERE p IS NOT NULL""")
def event_gaps(spark, sf_dir):
    us = F.round(F.col("gap") * 60_000_000).cast("long")
    return T.gaps(events(spark, sf_dir)).where("gap IS NOT NULL").select("event_id", "entity_id", us.alias("gap_us"), ((us > 6_000_000) & (us < 3_600_000_000)).alias("close"))


@query("burst_islands_threshold", f"""WITH {EVENTS}, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0 AS gap FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN greatest(gap, 0.1) <= 240 THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT entity_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_events FROM r GROUP BY entity_id, run HAVING count(*) > 3""")
def burst_islands_threshold(spark, sf_dir):
    return T.islands(events(spark, sf_dir), 240)


@query("burst_kleinberg")
def burst_kleinberg(spark, sf_dir):
    return T.bursts(events(spark, sf_dir), rate_mode="kleinberg")


LAGS = EVENTS + """, c AS (SELECT entity_id, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM ev GROUP BY ALL), sp AS (SELECT min(hour) AS lo, max(hour) AS hi FROM c), l AS (SELECT unnest(range(-24, 25)) AS lag),
x AS (SELECT entity_id AS a, lag, hi - lo + 1 - abs(lag) AS w, coalesce(sum(n) FILTER (hour + lag BETWEEN lo AND hi), 0) AS x, coalesce(sum(n * n) FILTER (hour + lag BETWEEN lo AND hi), 0) AS xx FROM c, sp, l GROUP BY ALL),
y AS (SELECT entity_id AS b, lag, coalesce(sum(n) FILTER (hour - lag BETWEEN lo AND hi), 0) AS y, coalesce(sum(n * n) FILTER (hour - lag BETWEEN lo AND hi), 0) AS yy FROM c, sp, l GROUP BY ALL),
xy AS (SELECT p.entity_id AS a, q.entity_id AS b, lag, sum(p.n * q.n) AS xy FROM c p, l JOIN c q ON q.hour = p.hour + lag AND p.entity_id < q.entity_id GROUP BY ALL),
s AS (SELECT a, b, lag, w * xx - x * x AS vx, w * yy - y * y AS vy, w * coalesce(xy, 0) - x * y AS cov FROM x JOIN y USING (lag) LEFT JOIN xy USING (a, b, lag) WHERE a < b AND w > 0)"""


@query("hourly_lag_corr", f"WITH {LAGS} SELECT a, b, CAST(lag AS INTEGER) AS lag, round(CASE WHEN vx > 0 AND vy > 0 THEN cov / sqrt(CAST(vx AS DOUBLE) * vy) ELSE 0 END, 6) + 0.0 AS corr FROM s")
def hourly_lag_corr(spark, sf_dir):
    return T.lag_correlations(events(spark, sf_dir)).withColumn("corr", F.round("corr", 6) + 0.0)


@query("lead_lag_significance")
def lead_lag_significance(spark, sf_dir):
    return T.lead_lag(events(spark, sf_dir))


JS = EVENTS + """, t AS (SELECT entity_id, count(*) AS total FROM ev GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT entity_id, total, h FROM t, (SELECT unnest(range(24)) AS h)),
c AS (SELECT entity_id, hour(ts) AS h, count(*) AS n FROM ev GROUP BY ALL),
p AS (SELECT g.entity_id, g.h, (coalesce(n, 0) / CAST(total AS DOUBLE) + CAST(1e-10 AS DOUBLE)) / (1 + 24 * CAST(1e-10 AS DOUBLE)) AS p FROM g LEFT JOIN c ON c.entity_id = g.entity_id AND c.h = g.h),
js AS (SELECT a.entity_id AS a, b.entity_id AS b, sum(0.5 * a.p * ln(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * ln(b.p / ((a.p + b.p) / 2))) AS js FROM p a JOIN p b ON a.h = b.h AND a.entity_id < b.entity_id GROUP BY ALL)"""


@query("sync_js_pairs", f"WITH {JS} SELECT a, b, round(js, 6) AS js FROM js")
def sync_js_pairs(spark, sf_dir):
    return T.js_divergences(events(spark, sf_dir)).withColumn("js", F.round("js", 6))


@query("sync_js", f"""WITH {JS} SELECT n AS n_entities, round(m, 6) AS mean_js, round(greatest(0, 1 - m / ln(2)), 6) AS sync, round(least(1.0, s / (n * 50.0)), 6) AS confidence
FROM (SELECT count(*) AS n, sum(total) AS s FROM t), (SELECT avg(js) AS m FROM js)""")
def sync_js(spark, sf_dir):
    rows = T.synchronisation(events(spark, sf_dir))
    return rows.select("n_entities", *[F.round(c, 6).alias(c) for c in ("mean_js", "sync", "confidence")])


@query("overlap_ratio", f"""WITH {EVENTS}, b AS (SELECT epoch_us(ts) // 21600000000 AS bin, count(DISTINCT entity_id) AS n FROM ev GROUP BY ALL)
SELECT round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS overlap_ratio, count(*) AS n_bins FROM b""")
def overlap_ratio(spark, sf_dir):
    return T.overlap_ratio(events(spark, sf_dir), 6).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query("coordination_score")
def coordination_score(spark, sf_dir):
    return T.coordination(events(spark, sf_dir), rate_mode="kleinberg")


NEWS = "news AS (SELECT DISTINCT epoch_us(ts) - 1800000000 AS a, epoch_us(ts) + 1800000000 AS b FROM ev WHERE event_type = 'error' AND k >= 95)"
HOURS = {"purchase": 4, "signup": 24, "view": 12, "click": 6}
PLANNED = "planned AS (SELECT DISTINCT epoch_us(ts) - CAST(h AS BIGINT) * 1800000000 AS a, epoch_us(ts) + CAST(h AS BIGINT) * 1800000000 AS b FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 24 WHEN 'view' THEN 12 WHEN 'click' THEN 6 ELSE 4 END AS h FROM ev WHERE k >= 98 AND entity_id % 10 = 0))"


def news(spark, sf_dir):
    return T.windows(events(spark, sf_dir).where("event_type = 'error' AND k >= 95"), F.lit(1), F.lit("breaking_news"), 0.9)


def planned(spark, sf_dir):
    hours = F.coalesce(F.create_map(*[x for k, v in HOURS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")], F.lit(4))
    return T.windows(events(spark, sf_dir).where("k >= 98 AND entity_id % 10 = 0"), hours, F.lit("scheduled"), 0.95)


@query("hardneg_breaking", f"WITH {EVENTS}, {NEWS} SELECT event_id, entity_id FROM ev WHERE EXISTS (SELECT 1 FROM news WHERE epoch_us(ts) BETWEEN a AND b)")
def hardneg_breaking(spark, sf_dir):
    return T.inside(events(spark, sf_dir), news(spark, sf_dir), "left_semi").select("event_id", "entity_id")


@query("hardneg_scheduled", f"WITH {EVENTS}, {PLANNED} SELECT event_id, entity_id FROM ev WHERE EXISTS (SELECT 1 FROM planned WHERE epoch_us(ts) BETWEEN a AND b)")
def hardneg_scheduled(spark, sf_dir):
    return T.inside(events(spark, sf_dir), planned(spark, sf_dir), "left_semi").select("event_id", "entity_id")


@query("hardneg_filtered_events", f"WITH {EVENTS}, {NEWS}, {PLANNED}, w AS (SELECT * FROM news UNION SELECT * FROM planned) SELECT event_id, entity_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM w WHERE epoch_us(ts) BETWEEN a AND b)")
def hardneg_filtered_events(spark, sf_dir):
    spans = news(spark, sf_dir).unionByName(planned(spark, sf_dir))
    return T.inside(events(spark, sf_dir), spans, "left_anti").select("event_id", "entity_id")


FIRST = "SELECT CAST(y AS INTEGER) AS year, make_date(y, 11, 1) AS n FROM range(2016, 2027) t(y)"


@query("hardneg_election_days", f"SELECT year, CAST(n + CAST((8 - isodow(n)) % 7 AS INTEGER) + 1 AS DATE) AS day FROM ({FIRST})")
def hardneg_election_days(spark, sf_dir):
    return T.election_days(spark, 2016, 2026)


@query("hardneg_high_volume", f"""WITH {EVENTS}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY ALL),
b AS (SELECT x.day, x.n, avg(p.n) AS m, stddev_pop(p.n) AS s FROM d x JOIN d p ON p.day < x.day AND p.day >= x.day - 30 GROUP BY ALL)
SELECT day, n, round((n - m) / s, 6) AS z, round(least(0.95, 0.5 + 0.1 * (n - m) / s), 6) AS confidence FROM b WHERE s > 0 AND (n - m) / s > 1""")
def hardneg_high_volume(spark, sf_dir):
    return T.busy_days(events(spark, sf_dir), 1.0).withColumn("z", F.round("z", 6)).withColumn("confidence", F.round("confidence", 6))


@query("event_counts", f"""WITH {EVENTS} SELECT entity_id, count(*) AS n, round(count(*) / CAST(greatest(1, datediff('day', min(ts)::DATE, max(ts)::DATE)) AS DOUBLE), 6) AS per_day FROM ev GROUP BY ALL""")
def event_counts(spark, sf_dir):
    days = F.greatest(F.lit(1), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))))
    return events(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.count("*") / days, 6).alias("per_day"))


@query("timing_events_for_entities", """SELECT event_id, user_id AS matched FROM events WHERE user_id IN (3, 5, 8) AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def timing_events_for_entities(spark, sf_dir):
    """Events whose parties overlap a list, one row per party that is in it."""
    rows = events(spark, sf_dir).withColumn("parties", F.array("entity_id")).where(F.col("event_type").isin("click", "view"))
    rows = rows.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    wanted = F.array(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(8).cast("long"))
    return rows.where(F.arrays_overlap("parties", wanted)).select("event_id", F.explode(F.array_intersect("parties", wanted)).alias("matched"))
