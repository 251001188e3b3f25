"""Research leads: filters, priorities, the queue and its statistics, deduplication. A queue is a table; changes rewrite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ACTIVE = ["pending", "in_progress"]


def follows(lead_type: Column, confidence: Column, amount: Column, types: list[str], least: float, least_amount: float) -> Column:
    return lead_type.isin(types) & (confidence >= least) & (amount.isNull() | (amount >= least_amount))


def amount_priority(amount: Column) -> Column:
    return F.when(amount > 100_000, 1).when(amount > 10_000, 2).otherwise(3)


def stake_priority(percent: Column) -> Column:
    return F.when(percent > 50, 1).when(percent > 10, 2).otherwise(3)


def boosted(priority: Column, boost: Column | int) -> Column:
    """Priority 1 (best) to 5, raised by the boost."""
    return F.greatest(F.lit(1), F.least(F.lit(5), priority - boost))


def enqueue(queue: DataFrame, leads: DataFrame) -> DataFrame:
    """Leads that no active lead of the queue has (session_id, target, target_type), each once, best first."""
    keys = ["session_id", "target", "target_type"]
    once = leads.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("priority", F.desc("confidence"), "lead_id"))).where("r = 1").drop("r")
    return once.join(queue.where(F.col("status").isin(ACTIVE)).select(*keys).distinct(), keys, "left_anti")


def dequeue(queue: DataFrame, n: int) -> DataFrame:
    return queue.where(F.col("status") == "pending").orderBy("priority", F.desc("confidence"), "created_at", "lead_id").limit(n)


def skip(queue: DataFrame, depth: int, least: float) -> DataFrame:
    """Pending leads too deep or too uncertain become skipped, with the reason."""
    reason = F.when(F.col("depth") > depth, "depth").when(F.col("confidence") < least, "confidence")
    hit = (F.col("status") == "pending") & reason.isNotNull()
    return queue.withColumn("skip_reason", F.when(hit, reason)).withColumn("status", F.when(hit, "skipped").otherwise(F.col("status")))


def changed(queue: DataFrame, commands: DataFrame) -> DataFrame:
    """The queue after commands (lead_id, action, priority, result, at), of each lead the latest: complete and fail settle a lead with
    its result, skip with the result as reason, requeue makes it pending again (with a priority, if it has one), set_priority
    (1 to 5) changes pending leads only."""
    last = commands.groupBy("lead_id").agg(F.max_by(F.struct("action", "priority", "result", "at"), "at").alias("c"))
    rows = queue.join(last, "lead_id", "left")
    action = F.coalesce("c.action", F.lit(""))
    ends = action.isin("complete", "fail", "skip")
    status = F.when(action == "complete", "completed").when(action == "fail", "failed").when(action == "skip", "skipped").when(action == "requeue", "pending").otherwise(F.col("status"))
    asked = F.col("c.priority").between(1, 5) & ((action == "requeue") | ((action == "set_priority") & (F.col("status") == "pending")))
    result = F.when(action.isin("complete", "fail"), F.col("c.result")).when(action != "requeue", F.col("result"))
    reason = F.when(action == "skip", F.col("c.result")).when(action != "requeue", F.col("skip_reason"))
    at = F.when(ends, F.col("c.at")).when(action != "requeue", F.col("processed_at"))
    out = {"status": status, "priority": F.when(asked, F.col("c.priority")).otherwise(F.col("priority")), "result": result, "skip_reason": reason, "processed_at": at}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in queue.columns])


def target_of(bn: Column, ein: Column, name: Column) -> tuple[Column, Column]:
    """Identifier and its kind: a BN, else an EIN, else the name."""
    return F.coalesce(bn, ein, name), F.when(bn.isNotNull(), "bn").when(ein.isNotNull(), "ein").otherwise("name")


def cross_border(nodes: DataFrame, edges: DataFrame, home: str = "US", abroad: str = "CA", least: float = 0.5) -> DataFrame:
    """Leads over the border for every node (id, name, bn, ein, jurisdiction): source_id, target, target_type, priority (always 1),
    confidence (the edge's, else 0.8), flow.

    A node at home, or of no jurisdiction, leads to those abroad that it has an edge to; one from elsewhere to those at
    home at either end of its edges. Edges (src, dst, confidence) below `least` are left out.
    """
    place = F.upper(F.coalesce("jurisdiction", F.lit("")))
    of = lambda p, c: nodes.select(F.col("id").alias(c), *[F.struct("name", "bn", "ein", place.alias("place")).alias(p)])
    sure = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= least)).select("src", "dst", "confidence")
    met = sure.join(of("a", "src"), "src").join(of("b", "dst"), "dst")
    at_home = lambda p: (F.col(f"{p}.place") == "") | (F.col(f"{p}.place") == home) | F.col(f"{p}.place").startswith(home + "-")

    def lead(own: str, other: str, keep: Column) -> DataFrame:
        target, kind = target_of(F.col(f"{other}.bn"), F.col(f"{other}.ein"), F.col(f"{other}.name"))
        flow = F.concat(F.col(f"{own}.place"), F.lit(">"), F.col(f"{other}.place"))
        return met.where(keep & F.col(f"{other}.name").isNotNull()).select(F.col("src" if own == "a" else "dst").alias("source_id"), target.alias("target"), kind.alias("target_type"), F.lit(1).alias("priority"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), flow.alias("flow"))

    out = lead("a", "b", at_home("a") & F.col("b.place").startswith(abroad))
    return out.unionByName(lead("a", "b", ~at_home("a") & F.col("b.place").startswith(home))).unionByName(lead("b", "a", ~at_home("b") & F.col("a.place").startswith(home)))


def stats(queue: DataFrame) -> DataFrame:
    """Counts by status, and by priority of the pending ones, with mean confidence: one pass by grouping sets."""
    rows = queue.select("status", F.when(F.col("status") == "pending", F.col("priority")).alias("priority"), "confidence")
    return rows.rollup("status", "priority").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.grouping_id().alias("g")).where("g < 3 AND NOT (g = 0 AND priority IS NULL)").drop("g")


def merge_extracted(leads: DataFrame, least: float = 0.5) -> DataFrame:
    """Extracted leads (value, method, confidence) by lower-case trimmed value: the surest, +0.05 (at most 1) and method hybrid if
    several methods agree."""
    g = leads.withColumn("key", F.lower(F.trim("value"))).groupBy("key").agg(F.max("confidence").alias("c"), F.count_distinct("method").alias("n"), F.max_by("method", "confidence").alias("m"))
    c = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col("c") + 0.05)).otherwise(F.col("c"))
    return g.select("key", F.when(F.col("n") > 1, "hybrid").otherwise(F.col("m")).alias("method"), c.alias("confidence")).where(F.col("confidence") >= least)
