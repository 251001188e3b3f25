"""The search for fillings: bounds, dominance, and packings against brute force and instances with a known answer."""

import collections
import itertools
import random

import numpy as np
import pytest

from orrery.llm import packing


def brute(pieces, capacity):
    """The fewest sequences, by placing piece after piece in every way."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def place(i, used):
        nonlocal best
        if len(used) >= best:
            return
        if i == len(pieces):
            best = len(used)
            return
        for space in {*used}:
            if space + pieces[i] <= capacity:
                own = list(used)
                own[own.index(space)] += pieces[i]
                place(i + 1, own)
        place(i + 1, [*used, pieces[i]])

    place(0, [])
    return best


def test_fewest_sequences():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 50])
        pieces, report = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))], {}
        plan = packing.bin_completion(collections.Counter(pieces), capacity, report=report)
        assert sum(m for _, m in plan) == report["sequences"] == brute(pieces, capacity) >= report["bound"] and report["proven"]


@pytest.mark.parametrize("capacity", [100, 1000, 2048])
def test_perfect_packings_are_found(capacity):
    """Twelve full sequences cut at random: best fit misses most of them."""
    missed = 0
    for seed in range(60):
        rng, counts = random.Random(seed), collections.Counter()
        for _ in range(12):
            cuts = sorted(rng.sample(range(1, capacity), rng.randint(1, 4)))
            counts.update(b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True))
        plan = packing.bin_completion(counts, capacity)
        missed += sum(m for _, m in packing.best_fit(counts, capacity)) > 12
        assert sum(m for _, m in plan) == 12 and all(sum(x * n for x, n in f) <= capacity for f, _ in plan)
        assert sum((collections.Counter({x: n * m for x, n in f}) for f, m in plan), collections.Counter()) == counts
    assert missed > 30


def test_all_undominated_fillings():
    rng = random.Random(4)
    for _ in range(40):
        space, pieces = 30, [rng.randint(3, 30) for _ in range(8)]
        counts = np.bincount(pieces, minlength=31)
        found = {f: w for f, w in packing.Completions(counts, space)(space)}
        every = {tuple(sorted(c, reverse=True)) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= space}
        assert {tuple(x for x, n in f for _ in range(n)) for f in found} <= every
        assert all(space - sum(x * n for x, n in f) == w for f, w in found.items())
        # Each filling that was left out has one that stands for it: its pieces fit into that one's, place by place.
        kept = [[x for x, n in f for _ in range(n)] for f in found]
        for own in every:
            assert any(fits(list(own), slots) for slots in kept)


def fits(pieces, slots):
    if not pieces:
        return True
    first, rest = pieces[0], pieces[1:]
    return any(s >= first and fits(rest, [*slots[:i], s - first, *slots[i + 1 :]]) for i, s in enumerate(slots))


def test_search_ends_by_effort():
    rng = random.Random(1)
    counts, report = collections.Counter(rng.randint(200, 2047) for _ in range(1000)), {}
    plan = packing.bin_completion(counts, 2048, effort=2000, report=report)
    assert not report["proven"] and report["bound"] <= sum(m for _, m in plan) <= sum(m for _, m in packing.best_fit(counts, 2048))
