"""Graph reads over edges (src, dst, ...) and nodes (id, ...): neighbours, shared parties, interlocks, statistics.

FUNDED_BY runs from the recipient (src) to the funder (dst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.pairs import equal_pairs


def adjacent(edges: DataFrame, node: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """The edges at a node, with `other` and `direction`; by direction in, out or both."""
    if types:
        edges = edges.where(F.col("rel_type").isin(types))
    out = edges.where(F.col("src") == node).withColumn("other", F.col("dst")).withColumn("direction", F.lit("out"))
    into = edges.where(F.col("dst") == node).withColumn("other", F.col("src")).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def valid_at(day: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Validity of [start, end) at a day; a null bound is open."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) > day))


def top_partners(edges: DataFrame, nodes: DataFrame, node: str, side: str, n: int, least: float | None = None) -> DataFrame:
    """The parties on the other side of a node's edges by amount: id, name, amount, fiscal_year. side is the node's own column."""
    other = "src" if side == "dst" else "dst"
    own = edges.where(F.col(side) == node)
    if least is not None:
        own = own.where(F.col("amount") >= least)
    best = own.orderBy(F.desc("amount"), other, "fiscal_year").limit(n)
    return best.join(nodes.select(F.col("id").alias(other), "name"), other, "left").select(F.col(other).alias("id"), "name", "amount", "fiscal_year")


def shared_funders(edges: DataFrame, recipients: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Funders of at least `least` of the recipients (a table of ids; all, if none): funder, recipients (sorted), n_recipients,
    total, years (sorted)."""
    own = edges if recipients is None else edges.join(recipients.select(F.col("id").alias("src")), "src", "left_semi")
    grouped = own.groupBy("dst").agg(
        F.array_sort(F.collect_set("src")).alias("recipients"), F.sum("amount").alias("total"), F.array_sort(F.collect_set("fiscal_year")).alias("years")
    )
    return grouped.where(F.size("recipients") >= least).select(F.col("dst").alias("funder"), "recipients", F.size("recipients").alias("n_recipients"), "total", "years")


def funder_concentration(edges: DataFrame, recipients: DataFrame, least: int = 2) -> DataFrame:
    """shared_funders() with concentration: the share of all a funder gives that goes to the recipients (0 if it gives nothing)."""
    shared = shared_funders(edges, recipients, least)
    every = edges.groupBy(F.col("dst").alias("funder")).agg(F.sum("amount").alias("given"))
    share = F.when(F.col("given") > 0, F.col("total").cast("double") / F.col("given").cast("double")).otherwise(0.0)
    return shared.join(every, "funder").withColumn("concentration", share)


def recipient_pairs(edges: DataFrame, least: int) -> DataFrame:
    """Pairs of recipients (a < b) that share at least `least` funders.

    Pairs of one funder's n recipients number n*n/2, which the result demands; a hub's recipients meet block by block, in
    many tasks.
    """
    distinct = edges.select("src", "dst").distinct()
    return equal_pairs(distinct, ["dst"], "src").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def shared_directors(edges: DataFrame, boards: DataFrame | None, least: int) -> DataFrame:
    """People on at least `least` of the boards: person, boards (sorted), n_boards."""
    own = edges if boards is None else edges.join(boards.select(F.col("id").alias("dst")), "dst", "left_semi")
    return own.groupBy(F.col("src").alias("person")).agg(F.array_sort(F.collect_set("dst")).alias("boards")).where(F.size("boards") >= least).withColumn("n_boards", F.size("boards"))


def board_interlocks(edges: DataFrame, org: str) -> DataFrame:
    """Other organisations of an organisation's directors: other, people (sorted), n_people."""
    people = edges.where(F.col("dst") == org).select("src")
    others = edges.join(people, "src", "left_semi").where(F.col("dst") != org)
    return others.groupBy(F.col("dst").alias("other")).agg(F.array_sort(F.collect_set("src")).alias("people")).withColumn("n_people", F.size("people"))


def entity_stats(nodes: DataFrame, funded: DataFrame, directors: DataFrame) -> DataFrame:
    """Per node: different edges out and in, funders, recipients, directors. Each branch is aggregated before it is joined."""
    out = funded.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.count_distinct("dst").alias("n_funders"))
    into = funded.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.count_distinct("src").alias("n_recipients"))
    seats = directors.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_directors"))
    joined = nodes.select("id").join(out, "id", "left").join(into, "id", "left").join(seats, "id", "left")
    return joined.na.fill(0)


def network_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density and mean degree of the undirected simple graph."""
    simple = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    degree = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    return degree.agg(F.count("*").alias("n_nodes"), (F.sum("count") / 2).cast("long").alias("n_edges")).select(
        "n_nodes", "n_edges", (2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).alias("density"), (2 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree")
    )


def search_entities(nodes: DataFrame, q: str, jurisdiction: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """Names that contain q in any case; by confidence, then name; a page of them."""
    out = nodes.where(F.lower("name").contains(q.lower()))
    if jurisdiction:
        out = out.where(F.lower("jurisdiction") == jurisdiction.lower())
    return out.orderBy(F.desc("confidence"), "name", "id").offset(skip).limit(limit)


def autocomplete(nodes: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Names that start with q first (rank 0), then those that hold it; by confidence (0.5 if unknown) and name. None for one letter."""
    low = F.lower("name")
    out = nodes.where(low.contains(q.lower())).where(F.lit(len(q) >= 2))
    rank = F.when(low.startswith(q.lower()), 0).otherwise(1)
    return out.select("id", "name", rank.alias("rank"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")).orderBy("rank", F.desc("confidence"), "name", "id").limit(min(limit, 25))


def registry_search(registry: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Scored search by name and code: exact code 100, name prefix 90, all words 70, substring 60; best first."""
    low, want = F.lower("name"), q.lower()
    words = [w for w in want.split() if w]
    every = F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    score = F.when(F.lower("id") == want, 100).when(low.startswith(want), 90).when(every, 70).when(low.contains(want), 60)
    return registry.withColumn("score", score).where(F.col("score").isNotNull()).orderBy(F.desc("score"), "name", "id").limit(limit)
