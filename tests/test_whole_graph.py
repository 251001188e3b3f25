"""Walks over all of FUNDED_BY against walks by hand: no year or amount is left out."""

import datetime as dt
from itertools import combinations

import pytest

from orrery import catalog

# recipient, funder, amounts by year: small ones, none of 1996
GRANTS = [(1, 1, 1994, 10), (1, 2, 1995, 20), (2, 2, 1995, 30), (2, 3, 1997, 5), (3, 1, 1993, 7), (3, 3, 1994, 9), (4, 4, 1998, 1), (1, 3, 1992, 2), (5, 4, 1997, 3), (5, 2, 1992, 4), (4, 2, 1994, 8)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    lines = [(i, f, float(a), 0.0, dt.datetime(y, 6, 1)) for i, (_, f, y, a) in enumerate(GRANTS)]
    heads = [(i, r, dt.datetime(y, 5, 1)) for i, (r, _, y, _) in enumerate(GRANTS)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(heads, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


def near(start):
    links = {(f"C{r}", f"S{f}") for r, f, _, _ in GRANTS}
    links |= {(b, a) for a, b in links}
    seen, front = {start: 0}, [start]
    while front:
        front = sorted({b for a in front for x, b in links if x == a and b not in seen})
        seen |= {b: max(seen.values()) + 1 for b in front}
    return seen, links


def test_walks(spark, tables):
    run = lambda name: catalog.queries()[name](spark, tables).collect()
    away, links = near("S1")
    assert [r.hops for r in run("shortest_path")] == [away["S2"]] == [2]
    paths = [("S1",)]
    found = []
    for _ in range(4):
        paths = [(*p, b) for p in paths if p[-1] != "S3" for a, b in links if a == p[-1] and frozenset((a, b)) not in [frozenset(e) for e in zip(p, p[1:])]]
        found += sorted(">".join(p) for p in paths if p[-1] == "S3")
    assert [r.path for r in run("all_paths")] == found[:10]
    dist = {s: {n: d for n, d in near(s)[0].items() if d <= 2} for s in ("S1", "S2", "S3")}
    want = {n: len(h) for n in away if n not in dist and len(h := [s for s in dist if n in dist[s]]) >= 2}
    assert {r.node: r.n_starts for r in run("connecting_entities")} == want
    assert {(r.src, r.dst) for r in run("entity_network")} == {(a, b) for a, b in links if a[0] == "C" and max(away[a], away[b]) <= 2 and min(away[a], away[b]) < 2}
    assert {r.id for r in run("lead_expansion")} == {n for n, d in away.items() if d <= 2}


def test_components(spark, tables):
    funders = {c: {f for r, f, _, _ in GRANTS if r == c} for c in range(1, 6)}
    pairs = [(a, b) for a, b in combinations(funders, 2) if len(funders[a] & funders[b]) >= 2]
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    rows = catalog.queries()["connected_components"](spark, tables).collect()
    assert {r.node: r.component for r in rows} == {f"C{x}": f"C{g}" for x, g in group.items()} and group
    clusters = catalog.queries()["funding_clusters"](spark, tables).collect()
    assert {(r.cluster, r.n_members) for r in clusters} == {(f"C{g}", list(group.values()).count(g)) for g in group.values()}
