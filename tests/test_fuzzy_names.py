"""Fuzzy names against all pairs, scored by hand."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from orrery.functions.similarity import SCORERS
from orrery.operators import resolution as R

SOURCE = ["IBM US", "Acmee Corpp", "Tiny Ab", "Northern Trst Fnd", "Acme", "A B", "Nrthern Trust Found", "", None]
TARGET = ["IBM USA", "Acme Corp", "Tiny Abc", "Northern Trust Fund", "Acme Media Group of the Greater North", "B A", "Other", "", None]


@pytest.mark.parametrize("score", ["token_sort", "weighted", "ratio", "token_set"])
@pytest.mark.parametrize("cutoff", [60.0, 85.0])
def test_fuzzy_names_lose_no_pair(spark, score, cutoff):
    rows = lambda names, c: spark.createDataFrame([(f"{c}{i}", n) for i, n in enumerate(names)], "id string, name string")
    source, target = rows(SOURCE, "a"), rows(TARGET, "b")
    a, b = R.named(source, "a").collect(), R.named(target, "b").collect()
    want = {(x.a, y.b): SCORERS[score](x.a_name, y.b_name) for x in a for y in b}
    got = {(r.source_id, r.target_id): r.score for r in R.by_fuzzy_name(source, target, cutoff, 20, score).collect()}
    assert got == {k: v for k, v in want.items() if v >= cutoff} and got
    if score == "token_sort" and cutoff == 85.0:
        assert ("a0", "b0") in got  # IBM US: no word of four letters


def test_cascade_and_stages_find_short_and_misspelt_names(spark):
    kind = "id string, name string, ein string, bn string, opencorp string"
    source = spark.createDataFrame([("a", "IBM US", None, None, None), ("b", "Acmee Mediia", None, None, None)], kind)
    target = spark.createDataFrame([("x", "IBM USA", None, None, None), ("y", "Acme Media", None, None, None)], kind)
    assert {(r.source_id, r.target_id) for r in R.cascade(source, target).where("strategy = 'fuzzy'").collect()} >= {("a", "x"), ("b", "y")}
    assert {(r.source_id, r.target_id) for r in R.staged(source, target).where("stage = 'fuzzy'").collect()} >= {("a", "x"), ("b", "y")}


@pytest.mark.parametrize("score", sorted(SCORERS))
def test_no_pair_within_reach_is_left_out(score):
    """Names of few letters, repeated and shared words, odd blanks and very different lengths, against every score."""
    rng = random.Random(score)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    names = [rng.choice([" ", " ", "  ", " "]).join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 12]))) for _ in range(120)] + ["", "a"]
    for cutoff in (50.0, 70.0, 85.0, 95.0):
        kept = set(zip(*(x.tolist() for x in R.reachable(names[:60], names[60:], score, cutoff))))
        assert all((i, j) in kept for i, x in enumerate(names[:60]) for j, y in enumerate(names[60:]) if SCORERS[score](x, y) >= cutoff)


def test_names_out_of_reach_are_not_scored(spark):
    """36 million pairs of names of one length, none of which can reach the cutoff."""
    rows = lambda name, n: spark.range(n).select(F.concat(F.lit(name[0]), "id").alias("id"), F.format_string(f"{name}#%09d", "id").alias("name"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    assert R.by_fuzzy_name(rows("Customer", 18_000), rows("Supplier", 2_000)).count() == 0
    stop.cancel()
    assert len(R.reachable(["CUSTOMER000000123"] * 9, ["SUPPLIER000000123"] * 9, "weighted", 85.0)[0]) == 0


@pytest.mark.parametrize("score", ["ratio", "token_sort", "weighted"])
@pytest.mark.parametrize("top", [1, 3, 1 << 30])
def test_best_scores_are_all_found(score, top):
    """Side by side as one by one; of each name the best, with what ties with them. Names of 64 characters and more occur."""
    rng = random.Random(top)
    names = ["".join(rng.choice("ab é0") for _ in range(rng.choice([3, 9, 17, 63, 64]))) for _ in range(80)] + ["", "a" * 64, "b"]
    for a in (names, [*names[:20], "x" * 70 + "ab"]):
        found = {(i, j): s for i, j, s in zip(*(x.tolist() for x in R.best_scores(a, names[::-1], score, 55.0, top)))}
        for i, x in enumerate(a):
            want = {j: s for j, y in enumerate(names[::-1]) if (s := SCORERS[score](x, y)) >= 55.0}
            least = sorted(want.values(), reverse=True)[: top + 1][-1:] or [0]
            assert {j: s for (k, j), s in found.items() if k == i} == {j: s for j, s in want.items() if s >= least[0]}
