"""Duplicates and their review: groups of one entity, best matches by name, decisions on tasks and matches, and what follows from them.
Decisions are rows; the state of a task or match is the table joined with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions import names as N
from orrery.functions.similarity import scorer
from orrery.operators import resolution as R
from orrery.operators.components import connected_components


def same_city(a: Column, b: Column) -> Column:
    """Letters alone, in any case: equal, or alike by 90 of 100. Null with a null."""
    x, y = (F.regexp_replace(F.upper(c), "[^A-Z]", "") for c in (a, b))
    return F.when(x == y, True).otherwise(scorer("ratio")(x, y) >= 90)


def stars(rows: DataFrame, key: Column) -> DataFrame:
    """(src, dst): links from the least id of a key to its others."""
    keyed = rows.select("id", key.alias("key")).where(F.length("key") > 0)
    first = keyed.groupBy("key").agg(F.min("id").alias("src"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key").where("id <> src").select("src", F.col("id").alias("dst"))


def duplicate_groups(rows: DataFrame, cutoff: float | None = 95.0) -> DataFrame:
    """Rows (id, name, ein, bn) that are one entity, by an equal number, an equal normalised name, or names that score the cutoff
    (none: not compared): id, group (its least id). Groups do not depend on any order: they are the components of all links."""
    links = stars(rows, N.digits(F.col("ein"))).union(stars(rows, N.normalise_bn(F.col("bn")))).union(stars(rows, N.organisation(F.col("name"))))
    if cutoff is not None:
        each = rows.select(N.organisation(F.col("name")).alias("name"), "id").where(F.length("name") > 0).groupBy("name").agg(F.min("id").alias("id"))
        links = links.union(R.by_fuzzy_name(each, each, cutoff, 1 << 30, "token_sort").select("source_id", "target_id"))
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group"))


def best_by_name(source: DataFrame, target: DataFrame, least: float = 0.85) -> DataFrame:
    """Per source its best target: source_id, target_id, confidence. An equal company name gives 1; else the best score of common words,
    if it is `least` or more; ties to the smaller id."""
    exact = R.by_exact_name(source, target, N.company).groupBy("source_id").agg(F.min("target_id").alias("target_id")).withColumn("confidence", F.lit(1.0))
    rest = source.join(exact.select(F.col("source_id").alias("id")), "id", "left_anti")
    alike = R.by_fuzzy_name(rest, target, 100 * least, 1, "token_set", N.company).select("source_id", "target_id", (F.col("score") / 100).alias("confidence"))
    return exact.unionByName(alike)


def vendor_matches(vendors: DataFrame, organisations: DataFrame, registry: DataFrame, least: float = 70.0, abroad: float = 75.0) -> DataFrame:
    """Vendors (id, name) with their organisation: the best known one of a score of `least`; for what is left the best of the registry
    (id, name), of a score of `abroad`: vendor_id, match_id, found_in, confidence."""
    known = R.by_fuzzy_name(vendors, organisations, least, 1).select(F.col("source_id").alias("vendor_id"), F.col("target_id").alias("match_id"), F.lit("known").alias("found_in"), F.least(F.lit(0.95), 0.5 + 0.4 * F.col("score") / 100).alias("confidence"))
    rest = vendors.join(known.select(F.col("vendor_id").alias("id")), "id", "left_anti")
    other = R.by_fuzzy_name(rest, registry, abroad, 1).select(F.col("source_id").alias("vendor_id"), F.col("target_id").alias("match_id"), F.lit("registry").alias("found_in"), (F.col("score") / 100).alias("confidence"))
    return known.unionByName(other)


def at_first(at: str, ties: list[str]) -> Column:
    """An order by time whose ties go to the larger of further columns; null where the time is null, so such rows are never taken."""
    return F.when(F.col(at).isNotNull(), F.struct(at, *ties))


def reviewed(tasks: DataFrame, decisions: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Tasks (id, status) with the latest decision (task_id, resolution, reviewer, decided_at) on each: same_entity approves, different
    rejects, merge_left and merge_right merge, skip skips, and anything else rejects. Of decisions of one time that counts whose
    columns `ties` are larger, then whose resolution and reviewer are: no result depends on the order of rows."""
    order = at_first("decided_at", [*ties, "resolution", "reviewer"])
    last = decisions.groupBy(F.col("task_id").alias("id")).agg(F.max_by(F.struct("resolution", "reviewer"), order).alias("d"), F.max("decided_at").alias("reviewed_at"))
    status = F.when(F.col("d.resolution") == "same_entity", "approved").when(F.col("d.resolution").isin("merge_left", "merge_right"), "merged").when(F.col("d.resolution") == "skip", "skipped").otherwise("rejected")
    joined = tasks.join(last, "id", "left")
    return joined.withColumn("status", F.when(F.col("d").isNotNull(), status).otherwise(F.col("status"))).withColumn("resolution", F.col("d.resolution")).withColumn("reviewed_by", F.col("d.reviewer")).drop("d")


def merges(tasks: DataFrame) -> DataFrame:
    """(kept, gone) of reviewed tasks (source_id, candidate_id) that merge: left keeps the source, right the candidate."""
    left = F.col("resolution") == "merge_left"
    return tasks.where(F.col("status") == "merged").select(F.when(left, F.col("source_id")).otherwise(F.col("candidate_id")).alias("kept"), F.when(left, F.col("candidate_id")).otherwise(F.col("source_id")).alias("gone"))


VERDICTS = {"approve": "approved", "reject": "rejected", "defer": "deferred"}


def judged(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matches (id, status) after verdicts (match_id, verdict, reviewer, at): the first on a pending match counts, whatever comes later
    finds it settled."""
    first = verdicts.where(F.col("verdict").isin(list(VERDICTS))).groupBy(F.col("match_id").alias("id")).agg(F.min_by(F.struct("verdict", "reviewer"), "at").alias("v"), F.min("at").alias("reviewed_at"))
    became = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])[F.col("v.verdict")]
    hit = (F.col("status") == "pending") & F.col("v").isNotNull()
    joined = matches.join(first, "id", "left")
    return joined.withColumn("reviewed_by", F.when(hit, F.col("v.reviewer"))).withColumn("reviewed_at", F.when(hit, F.col("reviewed_at"))).withColumn("status", F.when(hit, became).otherwise(F.col("status"))).drop("v")


def same_as(matches: DataFrame) -> DataFrame:
    """SAME_AS edges of approved matches (source_id, target_id, confidence, reviewed_by), one for each pair."""
    own = matches.where(F.col("status") == "approved").groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return own.agg(F.max("confidence").alias("confidence"), F.max_by("reviewed_by", "reviewed_at").alias("approved_by")).withColumn("rel_type", F.lit("SAME_AS"))


def cross_reference_action(confidence: Column) -> Column:
    """merged from 0.95, reviewed from 0.85, else apart."""
    return F.when(confidence >= 0.95, "auto").when(confidence >= 0.85, "review").otherwise("none")
