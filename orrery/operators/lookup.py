"""Finding entities: search over names, aliases and identifiers, quick look-ups, leads to entities, sources by what they know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.names import squeeze


def names_hold(q: str) -> Column:
    """Whether a node's name, page name or some alias holds q, in any case."""
    want = F.lit(q.lower())
    held = lambda c: F.coalesce(F.contains(F.lower(c), want), F.lit(False))
    return held(F.col("name")) | held(F.col("page_name")) | F.coalesce(F.exists("aliases", held), F.lit(False))


def search(nodes: DataFrame, q: str, types: list[str] | None = None, jurisdiction: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """Nodes (id, name, page_name, aliases, ein, bn, ad_id, entity_type, jurisdiction, confidence) that hold q in a name or
    alias, or have it as a number: the surest first, then by name; a page of them, each with the total of all that were found."""
    hit = names_hold(q)
    for number in ("ein", "bn", "ad_id"):
        hit |= F.coalesce(F.col(number) == q, F.lit(False))
    found = nodes.where(hit)
    if types:
        found = found.where(F.col("entity_type").isin(types))
    if jurisdiction:
        found = found.where(F.lower("jurisdiction") == jurisdiction.lower())
    total = found.agg(F.count("*")).scalar()
    return found.orderBy(F.desc("confidence"), "name", "id").offset(skip).limit(limit).withColumn("total", total)


def quick(nodes: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Nodes whose name or alias holds q: the one of that name first, then the shortest names."""
    exact = F.when(F.lower("name") == q.lower(), 0).otherwise(1)
    return nodes.where(names_hold(q)).orderBy(exact, F.length("name"), "name", "id").limit(limit)


#: Kinds of identifiers -> the numbers of an entity that may hold them. Any other kind is a name.
NUMBERS = {"entity_id": ["id"], "ein": ["ein"], "bn": ["bn"], "cik": ["sec_cik", "cik"], "sedar_profile": ["sedar_profile"], "meta_page_id": ["meta_page_id"]}


def entities_of_leads(leads: DataFrame, entities: DataFrame) -> DataFrame:
    """Leads (lead_id, identifier, kind) with their entity (id, name and the columns of NUMBERS): lead_id, entity_id, name.

    By number where the kind is one (of several entities the least id); else by name: the same, the same but for a full stop at
    its end, or one that starts so, in any case; the same name first, then the shortest, then the least id. All by equi-joins:
    for names that start so, an entity's prefixes are keys.
    """
    known = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("identifier")) for kind, columns in NUMBERS.items() for c in columns if c in entities.columns])
    numbers = entities.select("id", "name", F.explode(known).alias("k")).select(F.col("k.kind").alias("kind"), F.col("k.identifier").alias("identifier"), "id", "name").where("identifier IS NOT NULL")
    plain = leads.select("lead_id", "kind", F.col("identifier").cast("string").alias("identifier"))
    by_number = plain.join(numbers, ["kind", "identifier"]).groupBy("lead_id").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("entity_id"))

    wanted = plain.where(~F.col("kind").isin(list(NUMBERS))).select("lead_id", F.lower("identifier").alias("exact"), F.lower(F.rtrim(F.trim("identifier"), F.lit(".,;:"))).alias("start")).where(F.length("exact") > 0)
    low = F.lower("name")
    bare = F.rtrim(F.trim(low), F.lit("."))
    starts = F.transform(F.sequence(F.lit(0), F.length(low)), lambda n: F.left(low, n))
    keys = entities.where("name IS NOT NULL").select("id", "name", F.explode(F.array_distinct(F.concat(starts, F.array(bare)))).alias("start"))
    own = F.col("exact") == F.lower("name")
    best = F.struct(F.when(own, 0).otherwise(1).alias("o"), F.length("name").alias("n"), F.col("id").alias("entity_id"), "name")
    found = wanted.join(keys, "start").select("lead_id", best.alias("x"))
    # The same name, where the trimmed one is no start of it.
    same = wanted.join(entities.select("id", "name", low.alias("exact")), "exact").select("lead_id", best.alias("x"))
    by_name = found.unionByName(same).groupBy("lead_id").agg(F.min("x").alias("x")).select("lead_id", "x.name", "x.entity_id")
    return by_number.unionByName(by_name).select("lead_id", "entity_id", "name")


def sources_for(sources: DataFrame, identifier: str | None = None, lead_type: str | None = None, jurisdiction: str | None = None) -> DataFrame:
    """Sources (name, identifiers, lead_types, jurisdictions: arrays) that take an identifier, give leads of a type, and cover a
    jurisdiction ('*' covers all), by name."""
    if identifier:
        sources = sources.where(F.array_contains("identifiers", identifier))
    if lead_type:
        sources = sources.where(F.array_contains("lead_types", lead_type))
    if jurisdiction:
        sources = sources.where(F.arrays_overlap("jurisdictions", F.array(F.lit("*"), F.lit(jurisdiction))))
    return sources.orderBy("name")


def registry_scores(registry: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Scored search of a registry (id, code, name, other_name): exact code 100, the name starts so 90, another name does 85, all words
    in the name 70, in another 65, the name holds it 60, another does 55; the best first."""
    want = q.lower()
    words = F.filter(F.split(squeeze(F.lit(want)), " "), lambda w: F.length(w) > 0)
    low, other = F.lower("name"), F.lower("other_name")
    every = lambda c: (F.size(words) > 0) & F.forall(words, lambda w: F.contains(c, w))
    score = F.when(F.lower("code") == want, 100).when(low.startswith(want), 90).when(other.startswith(want), 85).when(every(low), 70).when(every(other), 65).when(low.contains(want), 60).when(other.contains(want), 55)
    return registry.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "name", "id").limit(limit)


def page_after(rows: DataFrame, value: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """A page of rows by falling value, then key, after the last row (value, key) of the page before: with has_more, and the
    cursor of the row from which the next page goes on."""
    if after is not None:
        v, k = (F.lit(x) for x in after)
        rows = rows.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(key) > k)))
    page = rows.orderBy(F.desc(value), key).limit(limit + 1)
    numbered = page.withColumn("_r", F.row_number().over(W.orderBy(F.desc(value), key)))  # limit + 1 rows
    more = numbered.agg(F.count("*") > limit).scalar()
    return numbered.where(F.col("_r") <= limit).drop("_r").withColumn("has_more", more).withColumn("cursor", F.base64(F.concat_ws("|", F.col(value).cast("decimal(18,2)").cast("string"), F.col(key).cast("string")).cast("binary")))


def ads_of(ads: DataFrame, sponsored_by: DataFrame, entities: DataFrame) -> DataFrame:
    """Ads (ad_id, ...) that entities (id, name) sponsor, by edges (src: ad, dst: sponsor): the ads' columns and sponsor_name."""
    own = sponsored_by.join(entities.select(F.col("id").alias("dst"), F.col("name").alias("sponsor_name")), "dst").select(F.col("src").alias("ad_id"), "sponsor_name")
    return ads.join(own, "ad_id")
