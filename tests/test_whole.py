"""Queries that take whole tables: nothing outside a subset is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import catalog
from orrery.plans import domain as D


def run(name, spark, sf):
    return catalog.queries()[name](spark, sf)


@pytest.fixture(scope="module")
def series(spark, sf):
    """Hourly counts of every entity, by hand."""
    rows = D.timing_events(spark, sf).select("entity_id", F.col("ts").cast("string").alias("ts")).collect()
    hours = {(r.entity_id, i): int(np.datetime64(r.ts.replace(" ", "T"), "h").astype(int)) for i, r in enumerate(rows)}
    first, last = min(hours.values()), max(hours.values())
    out = {e: np.zeros(last - first + 1) for e, _ in hours}
    for (e, _), h in hours.items():
        out[e][h - first] += 1
    return out


def pearson(x, y, lag):
    x, y = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[:lag])
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0


def test_lag_correlations_of_all_entities(spark, sf, series):
    rows = {(r.a, r.b, r.lag): r["corr"] for r in run("hourly_lag_corr", spark, sf).collect()}
    assert max(series) > 6 and len(rows) == len(series) * (len(series) - 1) // 2 * 49
    for (a, b, lag), c in list(rows.items())[:: max(1, len(rows) // 500)]:
        assert c == pytest.approx(pearson(series[a], series[b], lag), abs=1e-6)  # rounded


def test_lead_lag_of_all_entities(spark, sf, series):
    rows = run("lead_lag_significance", spark, sf).collect()
    enough = sorted(e for e, x in series.items() if x.sum() >= 10)
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in enough for b in enough if a < b}
    assert all(abs(r.p_value * 1001 - round(r.p_value * 1001)) < 1e-6 for r in rows)  # 1,000 rounds


def test_coordination_of_all_entities(spark, sf, series):
    row = run("coordination_score", spark, sf).first()
    assert (row.n_events, row.n_actors) == (sum(x.sum() for x in series.values()), len(series))


def test_leads_of_all_events(spark, sf):
    events = D.table(spark, sf, "events").count()
    assert run("lead_skip", spark, sf).agg(F.sum("n")).first()[0] == events
    assert run("queue_stats", spark, sf).where("priority IS NULL").agg(F.sum("n")).first()[0] == events
    assert run("lead_dequeue", spark, sf).where("lead_id % 7 <> 0").count() > 0
    assert run("lead_enqueue", spark, sf).where("lead_id % 7 <> 1").count() == 0


def test_records_of_all_rows(spark, sf):
    assert run("source_health", spark, sf).count() == D.table(spark, sf, "events").select("user_id").distinct().count()
    assert run("entity_evidence", spark, sf).select("id").distinct().count() == D.table(spark, sf, "lineitem").select("l_suppkey").distinct().count()
    assert run("cross_border_candidates", spark, sf).agg(F.max("recipient_id")).first()[0] > 100


def test_neutral_language_of_whole_texts(spark, sf, tmp_path):
    text = "x" * 100 + " a secret scheme " + "y" * 2000
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = run("neutral_language", spark, str(tmp_path)).first().neutral
    assert out.endswith("x" * 100 + " a undisclosed arrangement " + "y" * 2000)
    rows = D.table(spark, sf, "conversations").where("length(text) > 80").join(run("neutral_language", spark, sf), ["conv_id", "turn"])
    assert rows.where("right(text, 10) <> right(neutral, 10)").count() == 0
