"""Quality of records and of detections: one-pass conditional aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Least value that passes, by dimension.
THRESHOLDS = {"completeness": 0.95, "consistency": 0.98, "uniqueness": 0.90, "timeliness": 0.95, "accuracy": 0.99}
HISTOGRAM = [(0.45, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0)]


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the share of the fields' values that are not null (1 for no rows)."""
    filled = sum((F.sum(F.col(f).isNotNull().cast("long")) for f in fields), F.lit(0))
    return rows.agg(share(filled, F.count("*") * len(fields), 1.0).alias("value"))


def consistency(rows: DataFrame, field: str, pattern: str) -> DataFrame:
    """One row: the share of the values that are not null and match."""
    return rows.agg(share(F.sum(F.col(field).cast("string").rlike(pattern).cast("long")), F.count(field), 1.0).alias("value"))


def uniqueness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: 1 - duplicates / rows by the keys; nulls are equal to each other."""
    groups = rows.groupBy(*keys).count()
    return groups.agg((1 - share(F.sum(F.col("count") - 1), F.sum("count"), 0.0)).alias("value"))


def accuracy(rows: DataFrame, field: str, valid: Column) -> DataFrame:
    """One row: the share of the values that are not null and pass; a null verdict fails."""
    return rows.agg(share(F.sum((F.col(field).isNotNull() & F.coalesce(valid, F.lit(False))).cast("long")), F.count(field), 1.0).alias("value"))


def freshness(updated: Column, now: Column, days: float = 7) -> Column:
    """1 for new, 0 at twice the window's age: max(0, 1 - age / (2 * window)); 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.datediff(now, updated) / (2.0 * days)), F.lit(0.0))


def report(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per dimension: value, threshold, passed."""
    out = None
    for name, frame in parts.items():
        own = frame.select(F.lit(name).alias("dimension"), "value", F.lit(THRESHOLDS[name]).alias("threshold"), (F.col("value") >= THRESHOLDS[name]).alias("passed"))
        out = own if out is None else out.unionByName(own)
    return out


def confusion(rows: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the rates from them (0 where nothing divides), in all or by groups."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    g = rows.groupBy(*(by or [])).agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(~truth & ~guess).alias("tn"), n(truth & ~guess).alias("fn"))
    c = F.col
    zero = lambda a, b: share(a, b, 0.0)
    g = g.withColumn("recall", zero(c("tp"), c("tp") + c("fn"))).withColumn("precision", zero(c("tp"), c("tp") + c("fp")))
    g = g.withColumn("f1", zero(2 * c("precision") * c("recall"), c("precision") + c("recall"))).withColumn("fpr", zero(c("fp"), c("fp") + c("tn"))).withColumn("fnr", zero(c("fn"), c("fn") + c("tp")))
    return g.withColumn("accuracy", zero(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn"))).withColumn("specificity", zero(c("tn"), c("tn") + c("fp")))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts in the fixed bins [a, b), the last with its end; empty bins have 0."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(f"{a:.2f}-{b:.2f}", a) for a, b in HISTOGRAM], "bin string, lo double")
    v, label = F.col(value), None
    for a, b in HISTOGRAM:
        hit = (v >= a) & ((v <= b) if b == 1.0 else (v < b))
        label = F.when(hit, f"{a:.2f}-{b:.2f}") if label is None else label.when(hit, f"{a:.2f}-{b:.2f}")
    counts = rows.select(label.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def signal_performance(cases: DataFrame) -> DataFrame:
    """Cases (positive, found, missed: arrays) -> per signal: n_found, in_tp, in_fp, n_missed, detection_rate."""
    found = cases.select("positive", F.explode("found").alias("signal"), F.lit(1).alias("hit"))
    missed = cases.select("positive", F.explode("missed").alias("signal"), F.lit(0).alias("hit"))
    g = found.unionByName(missed).groupBy("signal").agg(
        F.sum(F.col("hit").cast("long")).alias("n_found"), F.sum((F.col("positive") & (F.col("hit") == 1)).cast("long")).alias("in_tp"),
        F.sum((~F.col("positive") & (F.col("hit") == 1)).cast("long")).alias("in_fp"), F.sum((1 - F.col("hit")).cast("long")).alias("n_missed"),
    )
    return g.withColumn("detection_rate", share(F.col("in_tp"), F.col("in_tp") + F.col("n_missed"), 0.0))


def trend(runs: DataFrame, value: str, drop: float = 0.05, last: int = 30) -> DataFrame:
    """Runs (run_at, value) in order, the last so many: with the change to the run before and whether it is a regression."""
    order = W.orderBy("run_at")
    few = runs.orderBy(F.desc("run_at")).limit(last)
    delta = F.col(value) - F.lag(value).over(order)
    return few.withColumn("delta", delta).withColumn("regression", F.coalesce(F.col("delta") < -drop, F.lit(False)))


def run_summary(runs: DataFrame, value: str) -> DataFrame:
    return runs.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.max_by(value, "run_at").alias("latest"))


def golden_check(cases: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Golden cases (label positive or negative, score, required, found: arrays, least, most) with detected and passed."""
    detected = F.col("score") >= threshold
    missing = F.array_except("required", "found")
    bounds = (F.col("least").isNull() | (F.col("score") >= F.col("least"))) & (F.col("most").isNull() | (F.col("score") <= F.col("most")))
    passed = F.when(F.col("label") == "positive", detected & (F.size(missing) == 0) & bounds).otherwise(~detected)
    return cases.withColumn("detected", detected).withColumn("missing", missing).withColumn("passed", passed)


def synthetic_events(spark, kind: str, entities: int, per_entity: int, seed: int = 1) -> DataFrame:
    """Events (entity_id, us) of a pattern from 2024-01-01 on: `burst` within 30 minutes, `news` within 60, `noise` over a week."""
    spread = {"burst": 1_800, "news": 3_600, "noise": 604_800}[kind] * 1_000_000
    rows = spark.range(entities * per_entity).withColumn("entity_id", F.col("id") % entities)
    at = F.lit(1_704_067_200_000_000).cast("long") + F.floor(F.rand(seed) * spread).cast("long")
    return rows.select("entity_id", at.alias("us"))
