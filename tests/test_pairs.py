"""Operators on pairs against all pairs by hand, over several blocks to a key."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import history as H, infrastructure as I, pairs as P, resolution as R, timing as T


def test_equal_pairs(spark):
    rng = random.Random(1)
    rows = {(rng.choice("ab"), i) for i in range(60)} | {("hot", i) for i in range(40)} | {("one", 7)}
    df = spark.createDataFrame(list(rows), "k string, v long")
    got = [tuple(r) for r in P.equal_pairs(df, ["k"], "v", size=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, a, b) for k, a in rows for x, b in rows if k == x and a < b}
    assert P.equal_pairs(df.where("v < 0"), ["k"], "v").count() == 0


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3 == 0), v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))] + [(200, 1, None), (201, 1, [0.0] * 4), (202, 1, [1.0, 2.0]), (203, 1, [float("nan")] * 4), (204, 1, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = {(r.a, r.b): r.cosine for r in R.by_vector(df, "label", 0.5).collect()}
    want = {}
    for (i, x, u), (j, y, v) in combinations([r for r in rows if r[2] and any(r[2]) and not np.isnan(r[2]).any()], 2):
        if x == y and len(u) == len(v) and (c := np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))) >= 0.5:
            want[i, j] = c
    assert set(got) == set(want) and (202, 204) in got and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_lags_in_blocks(spark):
    """More entities than a block holds; each pair and lag once, by the definition."""
    rng = random.Random(3)
    rows = [(e, f"2024-01-0{rng.randint(1, 2)} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00") for e in range(300) for _ in range(3)]
    events = spark.createDataFrame(rows, "entity_id long, t string").selectExpr("entity_id", "cast(t as timestamp_ntz) ts")
    got = T.lag_correlations(events, 2).collect()
    assert len(got) == len({(r.a, r.b, r.lag) for r in got}) == 300 * 299 // 2 * 5 and all(r.a < r.b for r in got)
    hours = [(e, (int(t[9]) - 1) * 24 + int(t[11:13])) for e, t in rows]
    lo, hi = min(h for _, h in hours), max(h for _, h in hours)
    series = np.zeros((300, hi - lo + 1))
    for e, h in hours:
        series[e, h - lo] += 1
    for r in rng.sample(got, 300):
        x, y = series[r.a], series[r.b]
        x, y = (x[: len(x) - r.lag], y[r.lag :]) if r.lag >= 0 else (x[-r.lag :], y[: r.lag])
        assert abs(r["corr"] - (np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else 0.0)) < 1e-9


def test_trigrams_lose_no_pair(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))) for _ in range(120)] + ["Acme Corp", "acme corp.", ""]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in re.split(r"[^\w]+", name.lower()) if w for i in range(len(w) + 1)}

    sets = [grams(n) for n in names]
    want = {(a, b) for a in range(0, len(names), 2) for b in range(1, len(names), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3}
    got = R.trigram_candidates(df.where("id % 2 = 0"), df.where("id % 2 = 1"), top=1000).collect()
    assert {(r.source_id, r.target_id) for r in got} == want and len(want) > 20


def test_weak_signals_are_looked_up(spark):
    """A score that weak kinds can't reach together: the same pairs as all pairs, filtered."""
    rng = random.Random(5)
    rows = {(f"d{i}", k, f"{k}{rng.randint(0, n)}") for i in range(40) for k, n in (("registrar", 1), ("ssl_issuer", 1), ("cms", 2))} | {(f"d{i}", "ip", f"ip{rng.randint(0, 25)}") for i in range(40)} | {(f"d{i}", "nameserver", f"n{rng.randint(0, 9)}") for i in range(40) for _ in range(2)}
    df = spark.createDataFrame(sorted(rows), "domain string, kind string, value string")
    df = df.dropDuplicates(["domain", "kind", "value"])
    key = lambda r: (r.a, r.b, round(r.score, 9), tuple(r.signals))
    every, strong = I.shared(df).where("score >= 3").collect(), I.shared(df, 3.0).collect()
    assert sorted(map(key, every)) == sorted(map(key, strong)) and strong


def test_history_with_open_bounds(spark):
    rows = [("x", "a", None, "2020-03-01"), ("x", "b", "2020-01-31", None), ("c", "x", None, None), ("x", "d", "2020-02-01", "2020-02-02"), ("y", "z", None, None), ("x", "e", "2019-01-01", "2019-06-01"), ("x", "f", "2021-01-01", None)]
    edges = spark.createDataFrame(rows, "src string, dst string, f string, t string").select("src", "dst", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    got = {str(r.day): r.n for r in H.entity_history(edges, "x", "2020-01-01", "2020-04-15", 31).collect()}
    days = ["2020-01-01", "2020-02-01", "2020-03-03", "2020-04-03"]
    assert got == {d: sum("x" in r[:2] and (r[2] is None or r[2] <= d) and (r[3] is None or r[3] > d) for r in rows) for d in days}


def test_entities_travel_few_times(spark, monkeypatch):
    """4,000 entities are eight blocks, so each travels eight times."""
    met, seen = P.met, []
    monkeypatch.setattr(P, "met", lambda *args: seen.append(out := met(*args)) or out)
    events = spark.range(20_000).selectExpr("id % 4000 entity_id", "timestampadd(HOUR, cast(id % 47 as int), timestamp_ntz'2024-01-01') ts")
    T.js_divergences(events)
    assert seen.pop().count() <= 8 * 4000
    T.lag_correlations(events, 1)
    assert seen.pop().count() <= 8 * 4000


def test_entities_travel_seldom(spark):
    """45,000 entities travel 11 times each, and a block's strips hold its rows once."""
    assert P.met(spark.range(45_000), [], "id", T.LARGE, 8).count() == 11 * 45_000
    assert [i for s in T.strips(4096, 4096) for i in range(4096)[s]] == list(range(4096)) and len(range(4096)[next(T.strips(4096, 4096))]) * 4096 <= T.PAIRS
    assert [i for s in T.strips(3, 1 << 30) for i in range(3)[s]] == [0, 1, 2]
