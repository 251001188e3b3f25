"""Components against union and find, with hubs, chains and loops."""

import random
import threading
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orrery import catalog
from orrery.operators import components
from orrery.operators.components import connected_components, sharing_components
from orrery.plans.tables import written


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(2)
    edges = [(5000, i) for i in range(1000, 1800)] + [(1, i) for i in range(100, 400)]  # hubs above and below their neighbours
    edges += [(i, i + 1) for i in range(6000, 6120)] + [tuple(rng.sample(range(7000, 7400), 2)) for _ in range(260)] + [(399, 7000)]
    rows = edges + [(9, 9), (None, 3), (4, None)] + edges[:50]
    out = connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert {r.node: r.component for r in out} == brute(edges) and len(out) == len(brute(edges))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def pairs_of(edges):
    held = {}
    for r, f in edges:
        held.setdefault(r, set()).add(f)
    return [(a, b) for a, b in combinations(held, 2) if len(held[a] & held[b]) > 1]


@pytest.mark.parametrize("funders, most, recipients", [(12, 4, 40), (60, 5, 80), (9, 2, 60), (200, 12, 60), (3000, 60, 30)])
def test_sharing_two(spark, funders, most, recipients):
    """Few and many to a recipient, so that either side is paired for what the first pass leaves."""
    rng = random.Random(funders)
    rows = [(r, f) for r in range(recipients) for f in rng.sample(range(funders), rng.randint(1, most))]
    rows += [(1000, 5000), (1000, 5001), (1000, 5002), (1001, 5000), (1001, 5002), (1001, 5003), (1002, 5003), (1002, 1)]  # neighbours in no order
    out = sharing_components(spark.createDataFrame([*rows, *rows[:9], (None, 1), (7, None)], "src long, dst long")).collect()
    assert {r.node: r.component for r in out} == brute(pairs_of(rows)) and len(out) == len({r.node for r in out})


@pytest.mark.parametrize("query", ["connected_components", "funding_clusters"])
def test_large_funders_make_no_pairs(spark, tmp_path, query):
    """60,000 recipients of the same three funders: 1.8 billion pairs a funder."""
    n = 60_000
    rows = spark.range(3 * n).select(F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_suppkey"), F.lit(2.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit("2020-01-01").cast("timestamp_ntz").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3 * n).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 3).alias("o_custkey"), F.lit("2020-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    out = catalog.queries()[query](spark, str(tmp_path))
    assert (out.where("component = 'C0'").count() if query == "connected_components" else out.first().n_members) == n
    stop.cancel()


def test_few_outside_meet_the_rest(spark, monkeypatch):
    """300 recipients of 40 funders each, and ten of two funders that no order puts side by side: only the ten meet the others."""
    rng = random.Random(4)
    rows = [(r, f) for r in range(300) for f in range(40)] + [(r, f) for r in range(300, 310) for f in rng.sample(range(40), 2)] + [(400, 0), (400, 99)]
    monkeypatch.setattr(components, "equal_pairs", lambda *args: pytest.fail("pairs of all"))
    out = sharing_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert {r.node: r.component for r in out} == {r: 0 for r in range(310)}


def test_few_holders_of_two_make_no_pairs_of_all(spark, monkeypatch):
    """3,000 recipients of four funders of 250 drawn at random: few hold the same two, seldom as neighbours."""
    rng = random.Random(5)
    rows = [(r, f) for r in range(3000) for f in rng.sample(range(250), 4)]
    monkeypatch.setattr(components, "equal_pairs", lambda *args: pytest.fail("pairs of all"))
    out = sharing_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert {r.node: r.component for r in out if r.node != r.component} == {n: c for n, c in brute(pairs_of(rows)).items() if n != c}


def test_written_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    table = written(spark.range(5000).groupBy(F.col("id") % 977).count(), "counts")
    assert disk.getAllFiles().size() <= before and table.count() == 977
