"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a neighbour graph, its balanced partitioning by recursive spectral bisection with swaps, and a small
network that learns from a vector the partitions of its neighbours. The network then puts every
row of the table into its most probable partition and routes each query to several, whose rows are
compared exactly, in double precision. How many partitions a query needs for the wanted recall is
measured on rows that the network has not learned, unless it could learn all that there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import small_batches, written
from orrery.llm.vectors import Index, Kernel, answer, matrix_of, ready, search_blocks, usable

#: Rows of a block of a partition, on average: larger partitions are cut into blocks.
BLOCK_ROWS = 2048


def neighbours(unit: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k nearest others by cosine, nearest first."""
    out = np.zeros((len(unit), k), np.int64)
    for i in range(0, len(unit), 1024):
        near = unit[i : i + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        few = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[i : i + 1024] = np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, 1), axis=1), 1)
    return out


def bisect(graph: np.ndarray, own: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the rows own, cutting few edges: a smooth vector on the graph by power iteration, split at the median,
    then swaps of the rows that gain most."""
    place = np.full(len(graph), -1)
    place[own] = np.arange(len(own))
    to = place[graph[own]]
    ends = np.nonzero(to >= 0)
    a, b = ends[0], to[ends]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    degree = np.maximum(np.bincount(a, minlength=len(own)), 1)
    x = np.random.default_rng(seed).normal(size=len(own))
    for _ in range(60):
        x = 0.5 * (x + np.bincount(a, x[b], len(own)) / degree)
        x -= np.average(x, weights=degree)
        x /= np.linalg.norm(x) + 1e-300
    side = np.zeros(len(own), bool)
    side[np.argsort(x, kind="stable")[len(own) // 2 :]] = True
    for _ in range(10):
        cross = np.bincount(a, side[a] != side[b], len(own)) * 2 - degree  # edges cut less edges kept
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-cross[left], kind="stable")], right[np.argsort(-cross[right], kind="stable")]
        n = min(len(left), len(right))
        swaps = int((cross[left[:n]] + cross[right[:n]] > 2).sum()) // 2  # half, since neighbours that move together gain nothing
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return own[~side], own[side]


def partition(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row; parts is a power of two, and sizes differ by one at most per split."""
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for n, g in enumerate(groups) for half in bisect(graph, g, n)]
    out = np.zeros(len(graph), np.int64)
    for n, g in enumerate(groups):
        out[g] = n
    return out


class Router:
    """One hidden layer, trained by Adam on cross entropy with the parts of a row's neighbours as soft labels."""

    def __init__(self, unit: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 512, steps: int = 480):
        epochs = max(15, -(-steps * 256 // len(unit)))
        own = partition(graph, parts)
        target = np.zeros((len(unit), parts))
        np.add.at(target, (np.repeat(np.arange(len(unit)), graph.shape[1] + 1), own[np.column_stack((np.arange(len(unit)), graph))].ravel()), 1 / (graph.shape[1] + 1))
        rng = np.random.default_rng(0)
        self.weights = [rng.normal(size=(unit.shape[1], hidden)) * unit.shape[1] ** -0.5 * 3, np.zeros(hidden), rng.normal(size=(hidden, parts)) * hidden**-0.5, np.zeros(parts)]
        m, v, t = [0 * w for w in self.weights], [0 * w for w in self.weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(unit))
            for i in range(0, len(unit), 256):
                some = order[i : i + 256]
                x = unit[some]
                h = np.maximum(x @ self.weights[0] + self.weights[1], 0)
                error = (self._softmax(h @ self.weights[2] + self.weights[3]) - target[some]) / len(some)
                back = (error @ self.weights[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x.T @ back, back.sum(0), h.T @ error, error.sum(0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """The parts of each row, most probable first."""
        return np.argsort(-(np.maximum(unit @ self.weights[0] + self.weights[1], 0) @ self.weights[2]) - self.weights[3], axis=1, kind="stable")


def normed(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Routes:
    """A router for each length of vectors that the sample has enough of; vectors of other lengths have one part."""

    def __init__(self):
        self.of: dict[int, tuple[Router, int, int]] = {}  # length -> router, parts, probes

    def parts(self, vectors: pa.ListArray, many: bool) -> list[list[int]]:
        """Of each vector the parts that it is sought in (many), or that it belongs to."""
        lengths = pc.list_value_length(vectors).to_numpy()
        out: list[list[int]] = [[0]] * len(vectors)
        for n in set(lengths.tolist()).intersection(self.of):
            router, _, probes = self.of[n]
            own = np.flatnonzero(lengths == n)
            order = router.order(normed(matrix_of(vectors.take(pa.array(own)))))
            for i, row in zip(own.tolist(), order[:, : probes if many else 1].tolist(), strict=True):
                out[i] = row
        return out


def fit(known: DataFrame, rows: int, sample: int = 8192, recall: float = 0.95, top: int = 5, rows_per_part: int = 4096) -> Routes:
    """Routers from at most `sample` different vectors, drawn by their hash.

    parts is a power of two: about 32 where the sample has 32 rows for each, more as the table grows by rows_per_part,
    at most sample / 32. A length of which fewer than 64 vectors were drawn has one part, which is all there is to learn.

    probes is the least number of parts in which the wanted share of nearest others is found. If the sample is the whole
    table, its rows are what will be asked and the share is theirs; if not, the router learns
    three quarters of it, and the share is that of the last quarter, which it has not seen.
    """
    drawn = known.select("k1", "vector").orderBy("k1").limit(sample).collect()
    out = Routes()
    lengths = np.array([len(r["vector"]) for r in drawn], np.int64)
    for n in np.unique(lengths).tolist():
        unit = normed(np.array([r["vector"] for r in drawn if len(r["vector"]) == n]))
        learned = len(unit) if len(drawn) == rows else len(unit) * 3 // 4
        parts = 1
        while parts * 64 <= learned and parts * 2 <= max(32, rows // rows_per_part):
            parts *= 2
        if parts == 1:
            continue
        own, new = unit[:learned], unit[learned:]
        graph = neighbours(own, 10)
        router = Router(own, graph, parts)
        homes = router.order(own)[:, 0]
        near, asked = (graph[:, :top], own) if learned == len(unit) else (nearest_places(new, own, top), new)
        ranks = np.argsort(router.order(asked), axis=1)  # of each part for each row
        needed = np.sort(np.take_along_axis(ranks, homes[near], 1).ravel() + 1)
        out.of[n] = router, parts, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return out


def nearest_places(unit: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.argpartition(-(unit[i : i + 1024] @ rows.T), k - 1, axis=1)[:, :k] for i in range(0, len(unit), 1024)])


def exact(keep: int) -> Kernel:
    """Each query's best rows by cosine, ties to the smaller id."""

    def prepare(rows: np.ndarray, least: np.ndarray) -> Index:
        lengths = np.linalg.norm(rows, axis=1)

        def search(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            scores = (queries @ rows.T) / (np.linalg.norm(queries, axis=1)[:, None] * lengths)
            low = np.partition(scores, -keep, axis=1)[:, [-keep]] if len(rows) > keep else -np.inf
            who, place = np.nonzero(scores >= low)
            value = scores[who, place]
            order = np.lexsort((least[place], -value, who))
            who, place, value = who[order], place[order], value[order]
            ok = np.arange(len(who)) - np.searchsorted(who, who, "left") < keep
            return who[ok], place[ok], value[ok]

        return search

    return prepare


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 5, every: int = 50, sample: int = 8192, recall: float = 0.95, report: dict | None = None) -> DataFrame:
    """For rows whose id `every` divides, the `top` nearest others found by cosine: query_id, rank, vec_id, score.

    Every usable row is indexed. Rows that repeat id and vector count once; a row is never its own neighbour; vectors of
    different lengths are not compared. The candidates of a query are all rows of its probed partitions. Partitions
    are cut into blocks of about BLOCK_ROWS rows by a hash, so a partition that most rows fall into is searched by many
    tasks. An empty table has an empty answer. report, if given, gets length -> (parts, probes).
    """
    spark = rows.sparkSession
    small_batches(spark)
    known, asked, different = ready(usable(rows, id_col, vector_col, True), top, every)
    routes = fit(known, known.count(), sample, recall, top)
    if report is not None:
        report.update({n: (parts, probes) for n, (_, parts, probes) in routes.of.items()})
    shared = spark.sparkContext.broadcast(routes)  # at most sample / 32 parts x 512 weights a length

    def route(many: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = shared.value.parts(batch.column("vector"), many)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

        return run

    part = F.concat_ws(":", F.size("vector"), F.col("part"))
    homes = written(known.select("k1", "k2", "vector", "ids").mapInArrow(route(False), "k1 long, k2 long, vector array<double>, ids array<long>, parts array<int>").withColumn("part", F.col("parts")[0]).withColumn("part", part).drop("parts"), "homes")
    sizes = {r["part"]: -(-r["count"] // BLOCK_ROWS) for r in homes.groupBy("part").count().collect()} or {"": 1}  # as many as parts
    blocks = F.create_map(*[x for p, n in sizes.items() for x in (F.lit(p), F.lit(n))])
    name = lambda part, nth: F.concat_ws("/", part, nth)
    placed = homes.select(name(F.col("part"), F.pmod(F.xxhash64("k2", "k1"), blocks[F.col("part")])).alias("block"), "vector", "ids")
    probed = different.select("k1", "k2", "vector").mapInArrow(route(True), "k1 long, k2 long, vector array<double>, parts array<int>").select("k1", "k2", "vector", F.explode("parts").alias("part")).withColumn("part", part)
    there = probed.where(blocks[F.col("part")].isNotNull())
    sent = there.select("k1", "k2", "vector", "part", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)).alias("nth")).select("k1", "k2", "vector", name(F.col("part"), F.col("nth")).alias("block"))
    return answer(asked, search_blocks(placed, sent, exact(top + 1), "double", sum(sizes.values())), top)
