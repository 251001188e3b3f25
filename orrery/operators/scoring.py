"""The composite score: independent signals, reduced where they correlate, that no single signal can push over the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Per signal its category, base weight and cap; factors of correlated pairs; thresholds.
SIGNALS = {
    "funding_concentration": ("financial", 0.20, 0.35),
    "shared_funder": ("financial", 0.18, 0.30),
    "board_overlap": ("governance", 0.22, 0.35),
    "personnel_interlock": ("governance", 0.15, 0.25),
    "temporal_coordination": ("temporal", 0.18, 0.30),
    "infrastructure_sharing": ("infrastructure", 0.20, 0.35),
    "ownership_chain": ("ownership", 0.25, 0.35),
    "content_similarity": ("content", 0.12, 0.20),
    "behavioral_pattern": ("temporal", 0.15, 0.25),
}
CORRELATED = {("funding_concentration", "shared_funder"): 0.5, ("board_overlap", "personnel_interlock"): 0.6, ("temporal_coordination", "behavioral_pattern"): 0.7}
FLAG, LEAST_SIGNALS, LEAST_CATEGORIES = 0.45, 2, 2


def looked_up(key: Column, place: int) -> Column:
    return F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v[place]))])[key]


def contributions(signals: DataFrame) -> DataFrame:
    """Signals (group_id, ord, signal_type, strength, confidence, evidence_count) -> per group and type: raw, adjusted, category.

    The last signal of a type counts. Whenever a type appears after a type that it correlates with, its share
    is multiplied by their factor.
    """
    raw = F.least(looked_up(F.col("signal_type"), 1) * F.col("strength") * F.col("confidence"), looked_up(F.col("signal_type"), 2))
    last = signals.withColumn("raw", raw).groupBy("group_id", "signal_type").agg(F.max_by("raw", "ord").alias("raw"))
    first = signals.groupBy("group_id", F.col("signal_type").alias("_other")).agg(F.min("ord").alias("_first"))
    both = {**CORRELATED, **{(b, a): f for (a, b), f in CORRELATED.items()}}
    factors = F.create_map(*[x for (a, b), f in both.items() for x in (F.lit(f"{a}>{b}"), F.lit(f))])
    met = signals.select("group_id", "ord", "signal_type").join(first, "group_id").withColumn("factor", factors[F.concat_ws(">", "_other", "signal_type")])
    factor = met.where((F.col("_first") < F.col("ord")) & F.col("factor").isNotNull()).groupBy("group_id", "signal_type").agg(F.product("factor").alias("factor"))
    out = last.join(factor, ["group_id", "signal_type"], "left")
    return out.select("group_id", "signal_type", looked_up(F.col("signal_type"), 0).alias("category"), "raw", (F.col("raw") * F.coalesce("factor", F.lit(1.0))).alias("adjusted"))


def composite(signals: DataFrame) -> DataFrame:
    """Per group: raw, adjusted (at most 1), n_signals, n_categories, valid and flagged."""
    sums = contributions(signals).groupBy("group_id").agg(F.sum("raw").alias("raw"), F.least(F.lit(1.0), F.sum("adjusted")).alias("adjusted"), F.count_distinct("category").alias("n_categories"))
    counts = signals.groupBy("group_id").agg(F.count("*").alias("n_signals"))
    valid = (F.col("n_signals") >= LEAST_SIGNALS) & (F.col("n_categories") >= LEAST_CATEGORIES)
    return counts.join(sums, "group_id").withColumn("valid", valid).withColumn("flagged", valid & (F.round("adjusted", 9) >= FLAG))


def categories(signals: DataFrame) -> DataFrame:
    return contributions(signals).groupBy("group_id", "category").agg(F.sum("adjusted").alias("score"))


def confidence_band(base: Column, evidence: Column, strength: Column, completeness: Column) -> tuple[Column, Column, Column]:
    """Point, lower and upper bound: more evidence narrows the band and raises the point, with falling returns."""
    point = base * F.least(F.lit(1.0), 0.5 + 0.1 * F.ln(1 + evidence)) * (0.7 + 0.3 * strength) * (0.5 + 0.5 * completeness)
    point = F.least(F.lit(0.95), F.greatest(F.lit(0.05), point))
    margin = 0.15 + F.greatest(F.lit(0.02), 0.2 - 0.02 * evidence) + 0.1 * (1 - completeness)
    return tuple(F.bround(x, 3) for x in (point, F.greatest(F.lit(0.0), point - margin), F.least(F.lit(1.0), point + margin)))


def composite_band(bands: DataFrame, key: str, penalty: float = 0.2) -> DataFrame:
    """Bands (point, lower, upper) of a group as one: the mean weighted by itself, lowered for likely correlation, within the
    outermost bounds drawn in as far as the points disagree."""
    g = bands.groupBy(key).agg(F.count("*").alias("n"), F.sum("point").alias("s"), F.sum(F.col("point") * F.col("point")).alias("q"), F.min("lower").alias("lo"), F.max("upper").alias("hi"), (F.max("point") - F.min("point")).alias("spread"))
    point = F.when(F.col("s") > 0, F.col("q") / F.col("s") * (1 - penalty * (1 - 1 / F.col("n")))).otherwise(0.0)
    draw = 1 - (0.5 + 0.5 * (1 - F.col("spread")))
    g = g.withColumn("p", point)
    some = F.col("s") > 0
    return g.select(
        key, F.bround("p", 3).alias("point"),
        F.when(some, F.bround(F.col("lo") + (F.col("p") - F.col("lo")) * draw, 3)).otherwise(0.0).alias("lower"),
        F.when(some, F.bround(F.col("hi") - (F.col("hi") - F.col("p")) * draw, 3)).otherwise(0.0).alias("upper"),
    )


def safety_check() -> list[str]:
    """Signals whose weight or cap alone would reach the flag: none may."""
    return [name for name, (_, weight, cap) in SIGNALS.items() if max(weight, cap) >= FLAG]


def assemble(temporal: DataFrame, funding: DataFrame, infra: DataFrame) -> DataFrame:
    """Detectors' results (group_id, ...) as signals in a fixed order: temporal (score, confidence), shared funders (n_shared,
    concentration), infrastructure (top, confidence)."""
    t = temporal.select("group_id", F.lit(1).alias("ord"), F.lit("temporal_coordination").alias("signal_type"), F.col("score").alias("strength"), "confidence", F.lit(1).alias("evidence_count"))
    strength = F.least(F.lit(1.0), 0.2 * F.col("n_shared") + 0.5 * F.col("concentration"))
    f = funding.select("group_id", F.lit(2).alias("ord"), F.lit("shared_funder").alias("signal_type"), strength.alias("strength"), F.lit(0.9).alias("confidence"), F.col("n_shared").cast("int").alias("evidence_count"))
    i = infra.select("group_id", F.lit(3).alias("ord"), F.lit("infrastructure_sharing").alias("signal_type"), F.least(F.lit(1.0), F.col("top") / 10).alias("strength"), "confidence", F.lit(1).alias("evidence_count"))
    return t.unionByName(f).unionByName(i)


def ranked(findings: DataFrame, n: int) -> DataFrame:
    return findings.withColumn("rank", F.row_number().over(W.partitionBy("flagged").orderBy(F.desc("adjusted"), "group_id"))).where(F.col("rank") <= n)
