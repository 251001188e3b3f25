"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from orrery.operators.pairs import equal_pairs, spread_join
from orrery.plans.tables import written

#: Salts over which a node's edges are dealt.
SALTS = 16
#: Edges of a node, the first in one order, whose pairs are tried first, as twos that others may hold too; the rest is found exactly.
TRIED = 9


def with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u. A hub's edges are dealt by the hash of v: its least is found salt by salt,
    and brought back to the salts that it has edges in, so no task gets all of a hub's edges."""
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    few = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).select("u", "salt", F.min("m").over(W.partitionBy("u")).alias("m"))
    return dealt.join(few, ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge names; the component is its least node.

    Each round links all larger neighbours of a node, then all smaller ones, to the least; edges that say
    the same are merged, so their number never grows beyond the first round's. Every round is written, so its
    lineage is short. Edges with a null end and loops say nothing. Rounds grow with the logarithm of the component's size.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    star = written(both.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = sign(star)
    for _ in range(rounds if state[0] else 0):
        around = with_least(star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = around.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # large holds (u, v) with v < u: the least of them takes the others and u.
        low = with_least(large)
        small = low.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        star = written(small.distinct(), "edges")
        if (now := sign(star)) == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("the components did not settle")
    roots = star.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def sharing_components(edges: DataFrame, ready: bool = False) -> DataFrame:
    """(node, component) of every src that shares two dst or more with another, over all such pairs, without making all pairs.

    Who holds the same two dst shares them: pairs among each src's first TRIED in one order of all dst are such twos, and join most
    that belong together, also where few hold the same two (neighbours alone seldom meet there). What is left is exact: a pair of different components shares two dst that both lie in more than one component, and
    at each of them one of the pair is outside the component that has most of this dst. So only these meet the rest of a dst, or the
    pairs of dst of each src are made, whichever gives fewer pairs. ready: the edges are a written table that holds none twice.
    """
    own = edges.select(F.col("src").alias("v"), "dst").where("v IS NOT NULL AND dst IS NOT NULL")
    own = own if ready else written(own.distinct(), "edges")

    def stars(twos: DataFrame) -> DataFrame:
        return with_least(twos.select("u", "v")).where("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst")).distinct()

    order = W.partitionBy("v").orderBy(F.xxhash64("dst"), "dst")
    few = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TRIED)
    few = few.withColumn("before", F.collect_list("dst").over(order.rowsBetween(-TRIED, -1))).select("v", "dst", F.explode("before").alias("f"))
    twos = written(few.select("v", F.struct("f", "dst").alias("u")), "twos")
    held = twos.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1")
    joined = twos.join(held, "u").where("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst"))
    first = written(connected_components(written(joined.distinct(), "links")), "components")
    named = written(own.join(first.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v")), "named")
    shares = named.groupBy("dst", "component").agg(F.count("*").cast("decimal(38,0)").alias("n")).groupBy("dst")
    mixed = written(shares.agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("rows"), F.max("n").alias("largest")).where("rows > largest"), "mixed")
    rows, by_dst = mixed.agg(F.sum("rows"), F.sum(F.col("rows") * (F.col("rows") - F.col("largest")))).first()
    if not rows:
        return first
    open_ = named.join(mixed.select("dst", "most"), "dst")
    several = open_.groupBy("v").agg(F.count("*").cast("decimal(38,0)").alias("n")).where("n > 1")
    if by_dst > rows and (several.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) <= by_dst:
        own_pairs = equal_pairs(open_.join(several.select("v"), "v", "left_semi"), ["v", "component"], "dst")
        links = stars(own_pairs.select(F.struct("a", "b").alias("u"), F.col("component").alias("v")).distinct())
    else:
        outside = open_.where("component <> most").select("dst", F.col("v").alias("w"), F.col("component").alias("other"))
        pairs = spread_join(open_, outside, ["dst"], "v").where("component <> other AND (component = most OR w < v)")
        pairs = pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), F.least("component", "other").alias("src"), F.greatest("component", "other").alias("dst"))
        links = pairs.groupBy("a", "b", "src", "dst").count().where("count > 1").select("src", "dst").distinct()
    # Links between components, named by their least node, whose least is that of all their nodes.
    more = written(connected_components(links).toDF("component", "least"), "components")
    alone = more.join(first.select("component").distinct(), "component", "left_anti").toDF("node", "component")
    return first.join(more, "component", "left").select("node", F.coalesce("least", "component").alias("component")).union(alone)
