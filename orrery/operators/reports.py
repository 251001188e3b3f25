"""Case reports: ranked findings, ads, cross-border edges, evidence, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Weights of relationship types in rankings, 1.0 for others.
TYPE_WEIGHTS = {"FUNDED_BY": 1.5, "OWNS": 1.3, "SPONSORED_BY": 1.2, "DIRECTOR_OF": 1.0, "EMPLOYED_BY": 0.8, "SHARED_INFRA": 0.7}


def entity_rank(depth: Column, confidence: Column, relationships: Column) -> Column:
    return 1.0 / (depth + 1) * confidence * (1 + 0.1 * relationships)


def relationship_rank(rel_type: Column, amount: Column, confidence: Column) -> Column:
    weight = F.coalesce(F.create_map(*[x for k, v in TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[rel_type], F.lit(1.0))
    return confidence * (F.log1p(F.coalesce(amount, F.lit(0.0))) + 1) * weight


def cross_border(edges: DataFrame, nodes: DataFrame, first: str, second: str) -> DataFrame:
    """Edges between two jurisdictions, turned so that the first's end comes first: first_id, second_id, rel_type."""
    place = nodes.select("id", "jurisdiction")
    a = place.select(F.col("id").alias("src"), F.col("jurisdiction").alias("ja"))
    b = place.select(F.col("id").alias("dst"), F.col("jurisdiction").alias("jb"))
    both = edges.join(a, "src").join(b, "dst")
    there, back = (F.col("ja") == first) & (F.col("jb") == second), (F.col("ja") == second) & (F.col("jb") == first)
    return both.where(there | back).select(F.when(there, F.col("src")).otherwise(F.col("dst")).alias("first_id"), F.when(there, F.col("dst")).otherwise(F.col("src")).alias("second_id"), "rel_type").distinct()


def top_words(texts: DataFrame, column: str, stop: list[str], n: int = 10, least: int = 2) -> DataFrame:
    """Words of more than three letters or digits that occur twice or more, the most frequent: word, n."""
    words = texts.select(F.explode(F.split(F.lower(column), r"\s+")).alias("w")).select(F.regexp_replace("w", r"[^\p{L}\p{N}]", "").alias("word"))
    kept = words.where((F.char_length("word") > 3) & ~F.col("word").isin(stop))
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(n)


def ad_summary(ads: DataFrame) -> DataFrame:
    """One row: sums of the bounds, different sponsors and platforms, first and last day."""
    return ads.agg(F.count("*").alias("n_ads"), F.sum("spend_low").alias("spend_low"), F.sum("spend_high").alias("spend_high"), F.count_distinct("sponsor").alias("n_sponsors"), F.count_distinct("platform").alias("n_platforms"), F.min("day").alias("first"), F.max("day").alias("last"))


def ad_groups(ads: DataFrame, n: int = 10) -> DataFrame:
    """Leads from ads that have something in common: a sponsor (0.85), a region in three or more (0.5): kind, value, confidence,
    n_ads, the five least ad ids. Least ids are ranked, never collected whole."""

    def group(kind: str, column: str, least: int, confidence: float) -> DataFrame:
        own = W.partitionBy(column).orderBy("ad_id")
        few = ads.where(F.col(column).isNotNull()).select(column, "ad_id").withColumn("r", F.row_number().over(own)).where("r <= 5")
        first = few.groupBy(column).agg(F.array_sort(F.collect_list("ad_id")).alias("first_ads"))
        sizes = ads.groupBy(column).agg(F.count("*").alias("n_ads")).where(F.col("n_ads") >= least)
        return sizes.join(first, column).select(F.lit(kind).alias("kind"), F.col(column).alias("value"), F.lit(confidence).alias("confidence"), "n_ads", "first_ads")

    every = group("sponsor", "sponsor", 1, 0.85).unionByName(group("region", "region", 3, 0.5))
    return every.orderBy(F.desc("confidence"), F.desc("n_ads"), "value").limit(n)


def evidence_index(parts: list[DataFrame]) -> DataFrame:
    """Evidence (evidence_id, used_by) of several parts, the first part that names it wins: evidence_id, part, used_by."""
    every = None
    for i, frame in enumerate(parts):
        own = frame.select("evidence_id", F.lit(i).alias("part"), "used_by")
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("evidence_id").agg(F.min(F.struct("part", "used_by")).alias("x"))
    return best.select("evidence_id", "x.part", "x.used_by")


def concentration_severity(c: Column) -> Column:
    return F.when(c >= 0.8, "critical").when(c >= 0.6, "high").when(c >= 0.4, "medium").otherwise("low")


def overlap_severity(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low")


def report_confidence(strength: Column, evidence: Column) -> tuple[Column, Column, Column]:
    base = F.least(F.lit(0.95), 0.6 * strength + 0.1 * evidence)
    margin = F.greatest(F.lit(0.05), 0.15 - 0.02 * evidence)
    return base, F.greatest(F.lit(0.0), base - margin), F.least(F.lit(1.0), base + margin)


def explanation(kind: Column, score: Column) -> Column:
    band = F.when(score >= 0.7, "strong").when(score >= 0.5, "moderate").otherwise("limited")
    return F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(": "), band, F.lit(" indication (score "), F.format_number(score, 2), F.lit(")"))


def to_markdown(rows: DataFrame, title: str) -> DataFrame:
    """One line of text per row, under a heading: order, line."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, f"# {title}"), (1, " | ".join(rows.columns)), (2, " | ".join("---" for _ in rows.columns))], "ord int, line string")
    return head.unionByName(rows.select(F.lit(3).alias("ord"), cells.alias("line")))


PRIORITY = ["critical", "high", "medium", "low"]


def by_priority(tasks: DataFrame) -> DataFrame:
    """Tasks from critical to low, the oldest first."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("priority"))
    return tasks.orderBy(rank, "created_at", "id")


def entity_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that nodes refer to (evidence_refs), newest first: id, evidence_id, retrieved_at."""
    refs = nodes.select("id", F.explode("evidence_refs").alias("evidence_id")).distinct()
    return refs.join(evidence, "evidence_id").select("id", "evidence_id", "retrieved_at").orderBy(F.desc("retrieved_at"), "evidence_id", "id")


def unknowns(entities: DataFrame, flags: list[str]) -> DataFrame:
    """Entities whose tracing some flag calls incomplete; a null flag says nothing."""
    hit = None
    for f in flags:
        own = F.coalesce(F.col(f), F.lit(False))
        hit = own if hit is None else hit | own
    return entities.where(hit)


def health_checks(metrics: DataFrame, recall: float = 0.85, fpr: float = 0.05) -> DataFrame:
    """One row of metrics (recall, fpr, precision, f1, n) as checks: name, value, target, status."""
    wanted = [("recall", recall, F.col("recall") >= recall), ("fpr", fpr, F.col("fpr") <= fpr), ("precision", 0.8, F.col("precision") >= 0.8), ("f1", 0.8, F.col("f1") >= 0.8), ("sample", 10.0, F.col("n") >= 10)]
    checks = F.array(*[F.struct(F.lit(k).alias("name"), F.col("n" if k == "sample" else k).cast("double").alias("value"), F.lit(float(t)).alias("target"), F.when(ok, "pass").otherwise("fail").alias("status")) for k, t, ok in wanted])
    return metrics.select(F.explode(checks).alias("c")).select("c.*")


def first_leads(parts: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """Leads (value) of several kinds and confidences in order: each lower-case value once, from the first part that has it."""
    every = None
    for i, (frame, kind, confidence) in enumerate(parts):
        own = frame.where(F.col("value").isNotNull()).select(F.lower("value").alias("key"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("key").agg(F.min(F.struct("ord", "kind", "confidence")).alias("x"))
    return best.select("key", "x.kind", "x.confidence")
