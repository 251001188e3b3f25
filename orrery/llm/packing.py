"""Packing pieces of documents into sequences: bin completion with branch and bound over a length histogram.

Only a histogram (at most `capacity` counts, whatever the corpus) comes to the driver. There the
packing of lengths is sought; the pieces of each length are then numbered in a distributed way and
the numbers looked up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from orrery.llm.common import slices, small_batches, written
from orrery.llm.tokens import library

#: A filling: (length, how often) from the longest length on. A plan: (filling, number of sequences so filled).
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]
#: Nodes of the search that hold their branches (some hundred kilobytes each).
HELD = 32


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over the histogram: runs of equal sequences are filled together."""
    open_: dict[int, list[tuple[Filling, int]]] = defaultdict(list)  # space left -> fillings
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in open_ if s >= length):
            most = space // length
            while left and open_[space]:
                filling, many = open_[space].pop()
                if whole := min(many, left // most):
                    open_[space - most * length].append(((*filling, (length, most)), whole))
                    left, many = left - whole * most, many - whole
                if many and left and left < most:
                    open_[space - left * length].append(((*filling, (length, left)), 1))
                    left, many = 0, many - 1
                if many:
                    open_[space].append((filling, many))
                    if left < most:
                        break
            if not left:
                break
        most = capacity // length
        if whole := left // most:
            open_[capacity - most * length].append((((length, most),), whole))
        if left % most:
            open_[capacity - left % most * length].append((((length, left % most),), 1))
    return [x for some in open_.values() for x in some]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs. counts: of each length from 0 to capacity.

    For each least length a up to half the capacity: pieces above capacity - a share a sequence with none of length a
    or more, each piece above half the capacity has a sequence of its own, and of the pieces from a to half the capacity what
    does not fit beside the latter needs more.
    """
    number, size = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    a = np.concatenate(([0], np.flatnonzero(counts[: half + 1])))
    before = np.maximum(a - 1, 0)
    large = number[capacity] - number[half]
    beside = (number[capacity - a] - number[half]) * capacity - (size[capacity - a] - size[half])
    more = size[half] - np.where(a > 0, size[before], 0) - beside
    return int((large + np.maximum(0, -(-more // capacity))).max())


class Completions:
    """The undominated fillings of a space, in the order of their waste, longest pieces first.

    A filling is dominated if another one can stand for it: if a piece that is left fits into its waste, or can take
    the place of one, two or three of its pieces. Which sums the shorter lengths can reach is known as bits
    of an integer, so that the enumeration runs into no dead end.
    """

    def __init__(self, counts: np.ndarray, space: int, effort: list[int] | None = None):
        """effort, if given, holds how many more steps may be taken, and is counted down; without any, no filling follows."""
        self.counts, self.space, self.effort = counts, space, effort or [1 << 62]
        own = np.flatnonzero(counts[: space + 1])
        self.lengths, self.have = own[::-1].tolist(), own.tolist()
        self.effort[0] -= len(own)
        self.reach, mask = [1] * (len(own) + 1), (1 << (space + 1)) - 1
        for i in range(len(own) - 1, -1, -1):
            x, bits = self.lengths[i], self.reach[i + 1]
            left, k = min(int(counts[x]), space // x), 1
            while left > 0:
                bits |= bits << (min(k, left) * x) & mask
                left, k = left - k, 2 * k
            self.reach[i] = bits

    def exactly(self, i: int, target: int) -> Iterator[Filling]:
        """Every filling by the lengths from place i on whose sum is the target."""
        if target == 0:
            yield ()
            return
        for j in range(max(i, len(self.have) - bisect_right(self.have, target)), len(self.lengths)):
            self.effort[0] -= 1
            if self.effort[0] < 0 or not self.reach[j] >> target & 1:
                return
            x = self.lengths[j]
            for k in range(min(int(self.counts[x]), target // x), 0, -1):
                if self.reach[j + 1] >> (target - k * x) & 1:
                    for rest in self.exactly(j + 1, target - k * x):
                        yield ((x, k), *rest)

    def replaceable(self, filling: Filling, waste: int) -> bool:
        need = dict(filling)
        pieces = [x for x, n in filling for _ in range(min(n, 3))]
        sums = {0, *pieces, *(a + b for a, b in combinations(pieces, 2)), *(sum(c) for c in combinations(pieces, 3))} if len(pieces) <= 24 else {0, *pieces}
        self.effort[0] -= len(sums)
        for s in sums:
            single = s in need
            for i in range(bisect_left(self.have, s + single), bisect_right(self.have, s + waste)):
                self.effort[0] -= 1
                if self.counts[self.have[i]] > need.get(self.have[i], 0):
                    return True
            if single and any(a + b == s for a, b in combinations(pieces, 2)) and self.counts[s] > need[s]:
                return True
        return False

    def __call__(self, most: int) -> Iterator[tuple[Filling, int]]:
        """Each undominated filling and its waste, up to a waste of `most`."""
        for waste in range(min(most, self.space) + 1):
            if self.reach[0] >> (self.space - waste) & 1:
                for filling in self.exactly(0, self.space - waste):
                    if not self.replaceable(filling, waste):
                        yield filling, waste


def bin_completion(counts: dict[int, int], capacity: int, effort: int = 4_000_000, report: dict | None = None) -> Plan:
    """The packing of the histogram in as few sequences as the search finds.

    Sequences are completed one after another around the longest piece left, by every undominated filling in turn, least waste
    first; equal sequences together, as often as the pieces last, then half as often, and so on down to once. Best fit gives
    the incumbents: of the whole, and of what is left at nodes of the search. A branch is left when the waste so far, or the
    lower bound of what is left, allows no packing better than the incumbent.

    The search ends when the incumbent meets the lower bound or every branch was seen: the packing is then optimal. Since
    the problem is hard, it also ends after so much effort (lengths and sums looked at, some seconds); it may then not be. report, if
    given, gets sequences, bound and proven.
    """
    counts = {x: n for x, n in counts.items() if n}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    start = np.zeros(capacity + 1, np.int64)  # copied at each node
    start[list(counts)] = list(counts.values())
    total, least = sum(x * n for x, n in counts.items()), lower_bound(start, capacity)
    best = best_fit(counts, capacity)
    used, nodes, left_to_do = sum(n for _, n in best), 0, [effort]
    every = max(1, len(counts) // 32)  # best fit is tried at one node of so many

    def branches(left: np.ndarray, waste: int) -> Iterator[tuple[dict[int, int], int, int]]:
        longest = int(np.flatnonzero(left)[-1])
        after = left.copy()
        after[longest] -= 1
        for filling, lost in Completions(after, capacity - longest, left_to_do)((used - 1) * capacity - total - waste):
            need = dict(filling)
            need[longest] = need.get(longest, 0) + 1
            many = min(int(left[x]) // n for x, n in need.items())
            while many:
                yield need, many, lost
                many //= 2

    # A node: what is left, sequences, waste, the plan as a linked list (part, before), branches taken, and the others. Only the last
    # HELD nodes hold their branches; an earlier one goes through them again when the search comes back to it.
    stack = [[start, 0, 0, None, 0, None]] if counts else []
    while stack and used > least and left_to_do[0] > 0:
        left, bins, waste, plan, taken, more = stack[-1]
        if more is None:
            more = stack[-1][5] = islice(branches(left, waste), taken, None)
        if (step := next(more, None)) is None:
            stack.pop()
            continue
        stack[-1][4] += 1
        need, many, lost = step
        own, now, gone = left.copy(), bins + many, waste + lost * many
        for x, n in need.items():
            own[x] -= n * many
        nodes += 1
        left_to_do[0] -= 32  # the bound
        if gone > (used - 1) * capacity - total or now + lower_bound(own, capacity) >= used:
            continue
        trail = ((tuple(sorted(need.items(), reverse=True)), many), plan)
        rest = np.flatnonzero(own)
        if nodes % every == 0 or not rest.size:
            found = best_fit({int(x): int(own[x]) for x in rest}, capacity)
            if (n := now + sum(m for _, m in found)) < used:
                before = trail
                while before is not None:
                    part, before = before
                    found.append(part)
                best, used = found, n
        if rest.size:
            stack.append([own, now, gone, trail, 0, None])
            if len(stack) > HELD:
                stack[-HELD - 1][5] = None
    proven = used <= least or not stack and left_to_do[0] > 0
    if report is not None:
        report.update(sequences=used, bound=least, proven=proven)
    return best


class Places:
    """For the r-th piece of a length: its sequence and its offset there."""

    def __init__(self, plan: Plan):
        rows = defaultdict(list)  # length -> first rank, first sequence, pieces to a sequence, offset
        first, used = 0, defaultdict(int)
        for filling, many in plan:
            offset = 0
            for length, n in filling:
                rows[length].append((used[length], first, n, offset))
                used[length] += n * many
                offset += n * length
            first += many
        self.sequences = first
        self.of = {x: np.array(v, np.int64).T for x, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for x, own in groupby(order.tolist(), key=lambda i: length[i]):
            own = np.array(list(own))
            ranks, firsts, n, offsets = self.of[int(x)]
            at = np.searchsorted(ranks, rank[own], "right") - 1
            inside = rank[own] - ranks[at]
            sequence[own], offset[own] = firsts[at] + inside // n[at], offsets[at] + inside % n[at] * x
        return sequence, offset


def cut_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Whole texts (null: empty) as ids by the tokenizers library, end_id after each; documents of more than
    `capacity` ids are cut. Per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library(path, False, special_as_text), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                whole = ids.tobytes() + end
                rows += [(doc_id, i // capacity, i, min(capacity, len(whole) // 4 - i), whole[4 * i : 4 * (i + capacity)]) for i in range(0, len(whole) // 4, capacity)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048, effort: int = 4_000_000) -> DataFrame:
    """pieces, a table that is read more than once (written(...)), with sequence_id and offset.

    Needs a column length from 1 to capacity. Full pieces are sequences of their own. Pieces of one
    length are interchangeable, so they are numbered within length and one of as many salts as keep
    a salt's share near 50,000 rows; totals of the salts before it then give the rank in the length. A
    length that a third of all pieces have is thus numbered by many tasks.
    """
    spark = pieces.sparkSession
    small_batches(spark)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)
    places = Places([*bin_completion(histogram, capacity, effort), *([(((capacity, 1),), full)] if full else [])])
    salts = max(16, -(-max([full, *histogram.values(), 0]) // 50_000))
    shared = spark.sparkContext.broadcast(places)  # at most 2,047 fillings of at most 63 lengths

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    own = W.partitionBy("length", "_salt")
    numbered = salted.withColumn("_rank", F.row_number().over(own.orderBy("doc_id", "piece")) - 1)
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counted.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = numbered.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            keep = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:keep], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, special_as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents packed into sequences: the written table of pieces with their ids (a piece is read again when a
    sequence is laid out), and the placement of each piece without its ids but with their unsigned crc32.

    Null texts are empty documents of one id, the end; repeated rows are packed as often as they come; a null doc_id is one as
    any other; very long texts are cut, whole; an empty table has an empty answer; other columns are not read.
    """
    pieces = written(cut_documents(docs, path, capacity, end_id, special_as_text), "pieces")
    return pieces, pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
