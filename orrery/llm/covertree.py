"""Exact top-k inner products by a dual-tree search on cover trees.

Queries and rows are each put into cover trees. A pair of nodes is left out when no inner product between
them can reach the worst kth score of the queries below: for centres q and r with covering radii s
and t, no product exceeds q.r + s |r| + t |q| + s t. Nodes of one point have radius 0, and the bounds of all of a node's
children with all of another's are one matrix product.

Scores are integers. Where no product of a block reaches 2**53, double precision holds them exactly; beyond it they are
computed in 64-bit integers, and where these could not hold them OverflowError is raised.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orrery.llm.vectors import answer, ready, search_blocks, usable

#: Points below which a node's children are its points.
LEAF, BASE = 24, 1.6
#: Rows of a block, on average; of a tree of it; queries of a tree.
BLOCK_ROWS, TREE_ROWS = 8192, 2048


class Node:
    """A ball: all points are within radius of the centre. Its children are the nodes `kids` and the single points `singles`."""

    __slots__ = ("centre", "radius", "norm", "points", "kids", "singles")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, kids: list[Node], singles: np.ndarray):
        self.centre, self.radius, self.points, self.kids, self.singles = centre, radius, points, kids, singles
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(data: np.ndarray) -> Node:
    """Invariants at each level: children cover their node's points within the level's radius, and their centres are
    further apart than it; a node is the centre of its first child. A child's radius is then taken from its
    points, so a child of one point has radius 0."""
    squares = (data**2).sum(1)
    gaps_of = np.sqrt(np.maximum(squares[:, None] + squares - 2 * (data @ data.T), 0))

    def build(centre: int, own: np.ndarray, away: np.ndarray) -> Node:
        """own: places of points, away: their distances from the centre."""
        radius = float(away.max())
        if len(own) <= LEAF or radius == 0:
            return Node(data[centre], radius, own, [], own)
        level = radius / BASE
        kids, single = [], []
        left, gaps, c = own, away, centre
        while True:
            near = (gaps <= level) | (left == c)
            if near.sum() == 1:
                single.append(c)
            else:
                kids.append(build(c, left[near], gaps[near]))
            left = left[~near]
            if not len(left):
                break
            c = int(left[0])
            gaps = gaps_of[c, left]
        return Node(data[centre], radius, own, kids, np.array(single, np.int64))

    every = np.arange(len(data))
    return build(0, every, gaps_of[0])


class DualTree:
    """Rows in trees of TREE_ROWS; called with queries, it returns query, place of a row and score of each query's `keep` best."""

    def __init__(self, rows: np.ndarray, least: np.ndarray, keep: int):
        self.rows, self.least, self.keep, self.compared = rows, least, keep, 0
        self.norms = np.sqrt((rows**2).sum(1))
        self.trees = []
        for i in range(0, len(rows), TREE_ROWS):
            self.trees.append(self.shifted(cover_tree(rows[i : i + TREE_ROWS]), i))

    def shifted(self, node: Node, by: int) -> Node:
        node.points, node.singles, node.kids = node.points + by, node.singles + by, [self.shifted(k, by) for k in node.kids]
        return node

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.queries, self.lengths = queries, np.sqrt((queries**2).sum(1))
        most = float(self.lengths.max(initial=0) * self.norms.max(initial=0))
        if most >= 2.0**63 * (1 - 1e-9):
            raise OverflowError("inner products that 64-bit integers may not hold")
        self.whole = most >= 2.0**53 * (1 - 1e-9)
        if self.whole:
            self.long = queries.astype(np.int64), self.rows.astype(np.int64)
        worst = np.iinfo(np.int64).min if self.whole else -np.inf
        self.scores = np.full((len(queries), self.keep), worst, np.int64 if self.whole else np.float64)
        self.places = np.full((len(queries), self.keep), -1, np.int64)
        for i in range(0, len(queries), TREE_ROWS):
            asked = self.shifted(cover_tree(queries[i : i + TREE_ROWS]), i)
            for tree in self.trees:
                self.visit(asked, tree)
        who, rank = np.nonzero(self.places >= 0)
        return who, self.places[who, rank], self.scores[who, rank].astype(np.int64)

    @staticmethod
    def bounds(a: np.ndarray, radius_a: np.ndarray, norm_a: np.ndarray, b: np.ndarray, radius_b: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
        """No product of a point of ball a and one of ball b exceeds this, for balls as rows and as columns."""
        far_a, far_b = (radius_a + norm_a)[:, None], radius_b + norm_b
        out = a @ b.T + radius_a[:, None] * norm_b + norm_a[:, None] * radius_b + radius_a[:, None] * radius_b
        return out + 1e-9 * far_a * far_b + 1e-6

    def worst(self, q: Node) -> float:
        return self.scores[q.points, -1].min()

    def visit(self, q: Node, r: Node) -> None:
        """All pairs of children of q and r whose bound can reach the worst score of the queries below. A tie may still win by
        its id, so only what is below that score goes."""
        if len(q.singles) and len(r.singles):
            self.compare(q.singles, r.singles)
        none = np.zeros(0, np.int64)
        if r.kids:
            centres, radii, norms = np.array([k.centre for k in r.kids]), np.array([k.radius for k in r.kids]), np.array([k.norm for k in r.kids])
            if len(q.singles):
                s = q.singles
                high = self.bounds(self.queries[s], np.zeros(len(s)), self.lengths[s], centres, radii, norms)
                for k in np.argsort(-high.max(0)).tolist():
                    some = s[high[:, k] >= self.scores[s, -1]]
                    if len(some):
                        self.visit(Node(q.centre, q.radius, some, [], some), r.kids[k])
            if q.kids:
                high = self.bounds(np.array([k.centre for k in q.kids]), np.array([k.radius for k in q.kids]), np.array([k.norm for k in q.kids]), centres, radii, norms)
                for a, row in zip(q.kids, high, strict=True):
                    for k in np.argsort(-row).tolist():
                        if row[k] >= self.worst(a):
                            self.visit(a, r.kids[k])
        if len(r.singles):
            s = r.singles
            for a in q.kids:
                high = self.bounds(a.centre[None], np.array([a.radius]), np.array([a.norm]), self.rows[s], np.zeros(len(s)), self.norms[s])[0]
                some = s[high >= self.worst(a)]
                if len(some):
                    self.visit(a, Node(r.centre, r.radius, some, [], some))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * len(b)
        scores = self.long[0][a] @ self.long[1][b].T if self.whole else self.queries[a] @ self.rows[b].T
        low = self.scores[a, -1]
        if len(b) > self.keep:
            low = np.maximum(low, np.partition(scores, -self.keep, axis=1)[:, -self.keep])
        i, j = np.nonzero(scores >= low[:, None])
        held = self.places[a]
        hi, hj = np.nonzero(held >= 0)
        who = np.concatenate((i, hi))
        place = np.concatenate((b[j], held[hi, hj]))
        value = np.concatenate((scores[i, j], self.scores[a][hi, hj]))
        order = np.lexsort((self.least[place], -value, who))
        who, place, value = who[order], place[order], value[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        ok = rank < self.keep
        self.scores[a[who[ok]], rank[ok]], self.places[a[who[ok]], rank[ok]] = value[ok], place[ok]


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For rows whose id `every` divides, the `top` largest inner products of floor(scale * component) with others, ties to
    the smaller id: query_id, rank, vec_id, score. Exact.

    Rows that repeat id and vector count once. Every query meets every block of rows with vectors as long as its own, and
    the block's trees prune for it; rows with equal vectors are one point of their tree. An empty table has an empty answer.
    """
    own = usable(rows, id_col, vector_col, False).select("vec_id", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("double")).alias("vector"))
    known, asked, different = ready(own, top, every)
    # One count for each length of vectors; tables of vectors have one length, or few.
    sizes = {r["n"]: -(-r["count"] // BLOCK_ROWS) for r in known.groupBy(F.size("vector").alias("n")).count().collect()} or {0: 1}
    blocks = F.create_map(*[x for n, many in sizes.items() for x in (F.lit(n), F.lit(many))])[F.size("vector")]
    name = lambda nth: F.concat_ws("/", F.size("vector"), nth).alias("block")
    placed = known.select(name(F.pmod(F.xxhash64("k2", "k1"), blocks)), "vector", "ids")
    sent = different.select("k1", "k2", "vector", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("nth")).select("k1", "k2", "vector", name(F.col("nth")))
    return answer(asked, search_blocks(placed, sent, lambda r, least: DualTree(r, least, top + 1), "long", sum(sizes.values())), top)
