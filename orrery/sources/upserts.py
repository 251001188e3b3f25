"""Sinks: keyed rewrites of nodes and edges, incremental loads, run tracking. There is no table format with MERGE here, so an
upsert is the union of old and new, one row to a key, written as a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.names import digits, normalise_bn, organisation


def node_key() -> Column:
    """EIN, else BN, else id, else name."""
    return F.coalesce(
        F.when(F.length(digits(F.col("ein"))) == 9, F.concat(F.lit("ein:"), digits(F.col("ein")))), F.concat(F.lit("bn:"), normalise_bn(F.col("bn"))), F.concat(F.lit("id:"), "id"), F.concat(F.lit("name:"), organisation(F.col("name")))
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Per key the latest value that is not null of each other column, by version; of equal versions the new table's."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.col(version), F.col("_new"))
    rest = [c for c in old.columns if c not in keys]
    return every.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest])


def upsert_undirected(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """upsert() of edges whose ends have no order."""

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("_a", F.least("src", "dst")).withColumn("dst", F.greatest("src", "dst")).withColumn("src", F.col("_a")).drop("_a")

    return upsert(ordered(old), ordered(new), ["src", "dst"], version)


def merged_props(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's values count where both have a key."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def changed_records(new: DataFrame, known: DataFrame, hash_columns: list[str]) -> DataFrame:
    """New records whose name and hash are not known yet, with record_hash."""
    value = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in hash_columns]))
    return new.withColumn("record_hash", value).join(known.select("name", "record_hash").distinct(), ["name", "record_hash"], "left_anti")


def since(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows after the high-water mark; all without one."""
    return rows if mark is None else rows.where(F.col(column) > F.lit(mark))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; nulls last."""
    own = W.partitionBy(key).orderBy(F.desc_nulls_last(at))
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def source_health(runs: DataFrame, now: Column, stale_hours: int = 168) -> DataFrame:
    """Runs (source, completed_at, status) -> per source its last run's status and health: never_run, stale, healthy or unknown."""
    last = runs.groupBy("source").agg(F.max("completed_at").alias("completed_at"), F.max_by("status", F.struct(F.col("completed_at").isNotNull(), "completed_at")).alias("status"))
    hours = F.expr("timestampdiff(HOUR, completed_at, now_)")
    health = F.when(F.col("completed_at").isNull(), "never_run").when(hours > stale_hours, "stale").when(F.col("status") == "completed", "healthy").otherwise("unknown")
    return last.withColumn("now_", now).withColumn("health", health).drop("now_")


def ingest_counts(outcomes: DataFrame) -> DataFrame:
    """Outcomes (source, outcome) -> records, created, updated, duplicates, errors, status: failed if nothing but errors, partial with some."""
    n = lambda v: F.sum((F.col("outcome") == v).cast("long"))
    g = outcomes.groupBy("source").agg(F.count("*").alias("records"), n("created").alias("created"), n("updated").alias("updated"), n("duplicate").alias("duplicates"), n("error").alias("errors"))
    return g.withColumn("status", F.when(F.col("errors") == 0, "completed").when(F.col("errors") < F.col("records"), "partial").otherwise("failed"))
