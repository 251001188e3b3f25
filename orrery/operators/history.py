"""The graph in time: snapshots, differences, changes, timelines, patterns of change. Validity is [valid_from, valid_to)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.graph import valid_at


def snapshot(edges: DataFrame, day: str) -> DataFrame:
    return edges.where(valid_at(day))


def degrees_at(edges: DataFrame, day: str) -> DataFrame:
    """Per node with valid edges at the day: n_out and n_in."""
    ends = snapshot(edges, day).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.out").alias("n_out"), F.sum(1 - F.col("e.out")).alias("n_in"))


def diff(edges: DataFrame, first: str, second: str, value: str = "amount") -> DataFrame:
    """Edges by (src, dst) that are added, removed or modified (another sum of the value) between two days."""

    def at(day: str, name: str) -> DataFrame:
        return snapshot(edges, day).groupBy("src", "dst").agg(F.sum(value).alias(name))

    both = at(first, "before").join(at(second, "after"), ["src", "dst"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def changes_since(edges: DataFrame, node: str, day: str) -> DataFrame:
    """A node's edges that changed since the day: added, removed or (touched otherwise) modified, latest first."""
    own = edges.where((F.col("src") == node) | (F.col("dst") == node))
    since = F.lit(day).cast("date")
    change = F.when(F.col("valid_from") >= since, "added").when(F.col("valid_to") >= since, "removed").when(F.col("updated_at") >= since, "modified")
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    return own.select(other.alias("other"), change.alias("change"), F.coalesce("valid_from", "updated_at").alias("changed_at")).where(F.col("change").isNotNull()).orderBy(F.desc("changed_at"), "other")


def timeline(edges: DataFrame, today: str) -> DataFrame:
    """Per pair (src, dst): n_periods, first, last, total_days (an open end counts to today; overlaps count twice), active."""
    end = F.coalesce("valid_to", F.lit(today).cast("date"))
    return edges.groupBy("src", "dst").agg(
        F.count("*").alias("n_periods"), F.min("valid_from").alias("first"), F.max(end).alias("last"), F.sum(F.datediff(end, F.col("valid_from"))).alias("total_days"),
        F.bool_or(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(today).cast("date"))).alias("active"),
    )


def entity_history(edges: DataFrame, node: str, start: str, end: str, days: int = 30) -> DataFrame:
    """Every so many days from start to end, how many of a node's edges are valid: day, n."""
    spark = edges.sparkSession
    first = F.lit(start).cast("date")
    points = spark.range(1).select(F.posexplode(F.sequence(first, F.lit(end).cast("date"), F.expr(f"INTERVAL {days} DAYS"))).alias("k", "day"))
    own = edges.where((F.col("src") == node) | (F.col("dst") == node))
    # An edge counts at the points from the first at or after its start to the last before its end.
    after = lambda day: F.ceil(F.datediff(F.col(day), first) / days).cast("int")
    last = F.floor(F.datediff(F.lit(end).cast("date"), first) / days).cast("int")
    spans = own.select(F.greatest(F.lit(0), F.coalesce(after("valid_from"), F.lit(0))).alias("a"), F.least(last, F.coalesce(after("valid_to") - 1, last)).alias("b")).where("a <= b")
    counts = spans.select(F.explode(F.sequence("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return points.join(counts, "k", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def cochange(edges: DataFrame, least: int = 2) -> DataFrame:
    """Per month of valid_from: different sources, and targets that at least `least` sources gained; months with as many sources."""
    monthly = edges.withColumn("month", F.date_format("valid_from", "yyyy-MM"))
    targets = monthly.groupBy("month", "dst").agg(F.count_distinct("src").alias("n")).groupBy("month").agg(F.sum((F.col("n") >= least).cast("long")).alias("n_shared_targets"))
    sources = monthly.groupBy("month").agg(F.count_distinct("src").alias("n_sources")).where(F.col("n_sources") >= least)
    return sources.join(targets, "month")
