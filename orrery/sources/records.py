"""Source records to nodes and edges. FUNDED_BY runs from recipient to funder everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions import names as N
from orrery.functions.text import number

OWNERSHIP = [r"(\d{1,3}(?:\.\d+)?)\s*%", r"(\d{1,3}(?:\.\d+)?)\s+per\s*cent"]
SHARES = [r"([\d,]{4,})\s+(?:common\s+)?shares"]


def is_board(title: Column) -> Column:
    """A missing title, or one with director, trustee or board."""
    return title.isNull() | title.rlike("(?i)director|trustee|board")


def filing_edges(filings: DataFrame) -> DataFrame:
    """Filings (ein, name, tax_year, officers, grants) -> rel_type, src, dst, fiscal_year, amount, confidence.

    Officers sit on the board (is_board) or are employed. A recipient is its EIN, else name and country if foreign, else
    name; 1.0 by identifier, 0.8 by name.
    """
    org = F.concat(F.lit("EIN:"), N.digits(F.col("ein")))
    officers = filings.select(org.alias("dst"), "tax_year", F.explode("officers").alias("o")).select(
        F.when(is_board(F.col("o.title")), "DIRECTOR_OF").otherwise("EMPLOYED_BY").alias("rel_type"), F.concat(F.lit("P:"), N.squeeze(F.upper("o.name"))).alias("src"), "dst",
        F.col("tax_year").alias("fiscal_year"), F.lit(None).cast("double").alias("amount"), F.lit(1.0).alias("confidence"),
    )
    g = filings.select(org.alias("dst"), "tax_year", F.explode("grants").alias("g"))
    known, foreign = F.length(N.digits(F.coalesce("g.ein", F.lit("")))) == 9, F.coalesce(F.col("g.country"), F.lit("US")) != "US"
    name = N.organisation(F.col("g.name"))
    recipient = F.when(known, F.concat(F.lit("EIN:"), N.digits(F.col("g.ein")))).when(foreign, F.concat_ws(":", F.lit("ORG"), "g.country", name)).otherwise(F.concat(F.lit("ORG:"), name))
    grants = g.select(F.lit("FUNDED_BY").alias("rel_type"), recipient.alias("src"), "dst", F.col("tax_year").alias("fiscal_year"), F.col("g.amount").alias("amount"), F.when(known, 1.0).otherwise(0.8).alias("confidence"))
    return officers.unionByName(grants)


def charity_star(charities: DataFrame, financials: DataFrame, donees: DataFrame) -> DataFrame:
    """Charities by BN with their last financial year and their donees; sides without rows are null or empty."""
    last = financials.groupBy("bn").agg(F.max_by("revenue", "fiscal_end").alias("revenue"), F.max("fiscal_end").alias("fiscal_end"))
    gifts = donees.groupBy("bn").agg(F.array_sort(F.collect_list(F.struct("donee", "amount"))).alias("donees"))
    empty = F.array().cast(gifts.schema["donees"].dataType)
    return charities.join(last, "bn", "left").join(gifts, "bn", "left").withColumn("donees", F.coalesce("donees", empty)).withColumn("jurisdiction", F.concat(F.lit("CA-"), "province"))


def submission_filings(submissions: DataFrame) -> DataFrame:
    """Parallel arrays of recent filings as rows: cik, accession, form, filed; is_ownership for 13D and 13G."""
    r = "filings.recent."
    zipped = F.arrays_zip(F.col(r + "accessionNumber").alias("a"), F.col(r + "form").alias("f"), F.col(r + "filingDate").alias("d"))
    rows = submissions.select("cik", F.explode(zipped).alias("z")).select("cik", F.col("z.a").alias("accession"), F.col("z.f").alias("form"), F.to_date("z.d").alias("filed"))
    return rows.withColumn("is_ownership", F.col("form").rlike(r"^SC(HEDULE)? 13[DG]"))


def first_number(text: Column, patterns: list[str]) -> Column:
    """The number of the first pattern that matches."""
    return F.coalesce(*[number(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit(""))) for p in patterns])


def early_warning(reports: DataFrame) -> DataFrame:
    """Reports (id, text) -> percent, shares, issuer, acquirer, and confidence, lowered for what is missing: 0.8 without percent, 0.9
    without shares, 0.7 without acquirer."""
    name = r"([A-Z][\w&.,' -]+?)"
    found = reports.select(
        "id", first_number(F.col("text"), OWNERSHIP).alias("percent"), first_number(F.col("text"), SHARES).alias("shares"),
        F.nullif(F.regexp_extract("text", rf"(?m)(?:[Ii]ssuer|shares of)[:\s]+{name}(?:[.;\n]|$)", 1), F.lit("")).alias("issuer"),
        F.nullif(F.regexp_extract("text", rf"(?m)(?:[Aa]cquiror|[Aa]cquirer)[:\s]+{name}(?:[.;\n]|$)", 1), F.lit("")).alias("acquirer"),
    )
    low = lambda c, x: F.when(F.col(c).isNull(), x).otherwise(1.0)
    return found.withColumn("confidence", low("percent", 0.8) * low("shares", 0.9) * low("acquirer", 0.7))


def ad_edges(ads: DataFrame) -> DataFrame:
    """Ads -> SPONSORED_BY from page to sponsor: the amount is the middle of the spend's bounds, or the bound that there is."""
    lo, hi = number(F.col("spend.lower_bound")), number(F.col("spend.upper_bound"))
    amount = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(F.coalesce(lo, hi))
    return ads.where(F.col("funding_entity").isNotNull()).select(
        F.lit("SPONSORED_BY").alias("rel_type"), F.concat(F.lit("PAGE:"), "page_id").alias("src"), F.concat(F.lit("ORG:"), N.organisation(F.col("funding_entity"))).alias("dst"),
        amount.alias("amount"), F.to_date(F.try_to_timestamp("ad_delivery_start_time")).alias("valid_from"),
    )


def registrations(main: DataFrame, children: DataFrame) -> DataFrame:
    """Lobbying registrations with their subjects, an empty list for none."""
    grouped = children.groupBy("reg_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return main.join(grouped, "reg_id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def targeted(rows: DataFrame, columns: list[str], patterns: list[str]) -> DataFrame:
    """Rows of which some column contains some pattern, in any case."""
    wanted = F.array(*[F.lit(p.lower()) for p in patterns])
    hit = None
    for c in columns:
        own = F.coalesce(_contains_any(F.col(c), wanted), F.lit(False))
        hit = own if hit is None else hit | own
    return rows.where(hit)


def _contains_any(value: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda p: F.contains(F.lower(value), p))


# A power-map's relationship categories, and the words of a register's positions, as types of edges.
CATEGORIES = {1: "EMPLOYED_BY", 3: "EMPLOYED_BY", 5: "FUNDED_BY", 6: "FUNDED_BY", 7: "FUNDED_BY", 10: "OWNS", 11: "OWNS"}
POSITIONS = [(["director", "board", "trustee", "governor"], "DIRECTOR_OF"), (["owner", "shareholder", "member", "partner"], "OWNS")]
#: Extensions of an organisation, the first that it has gives its type.
EXTENSIONS = [
    (["nonprofit", "philanthropy"], "nonprofit"), (["politicalfundraising", "politicalparty", "governmentbody"], "political_org"), (["business", "publiccompany", "privatecompany", "lobbyingfirm"], "corporation"),
    (["school", "university"], "unknown"), (["mediaorganization", "newspaper", "industrygroup", "lawfirm"], "corporation"),
]
EXECUTIVE = ["ceo", "cfo", "coo", "cto", "cio", "cmo", "cpo", "cso", "chief", "president", "vice president", "vp", "director", "managing director", "executive", "partner", "principal", "founder", "owner", "general manager", "head of", "svp", "evp"]
BOARD = ["board member", "board director", "board of directors", "chairman", "chairwoman", "chairperson", "chair", "non-executive director", "independent director", "advisory board", "trustee"]


def category_type(category: Column, is_board: Column) -> Column:
    """The edge type of a power-map category; null for those without one."""
    mapped = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])[category]
    return F.when((category == 1) & F.coalesce(is_board, F.lit(False)), "DIRECTOR_OF").otherwise(mapped)


def organisation_type(extensions: Column) -> Column:
    low, out = F.transform(extensions, F.lower), None
    for names, kind in EXTENSIONS:
        hit = F.arrays_overlap(low, F.array(*map(F.lit, names)))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def powermap_edges(relationships: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """Relationships (rel_id, from_id, to_id, category, is_board) with both ends in ids (source_id, id), of a category that has a
    type, and not known yet (rel_id): rel_id, rel_type, src, dst. Money is turned to run from recipient to funder."""
    a = ids.select(F.col("source_id").alias("from_id"), F.col("id").alias("a"))
    b = ids.select(F.col("source_id").alias("to_id"), F.col("id").alias("b"))
    kind = category_type(F.col("category"), F.col("is_board"))
    rows = relationships.dropDuplicates(["rel_id"]).withColumn("rel_type", kind).where(F.col("rel_type").isNotNull()).join(a, "from_id").join(b, "to_id").join(known.select("rel_id"), "rel_id", "left_anti")
    money = F.col("rel_type") == "FUNDED_BY"
    return rows.select("rel_id", "rel_type", F.when(money, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(money, F.col("a")).otherwise(F.col("b")).alias("dst"))


def position_type(position: Column) -> Column:
    """DIRECTOR_OF, OWNS or EMPLOYED_BY by the words of a position."""
    out = None
    for words, kind in POSITIONS:
        hit = F.coalesce(_contains_any(position, F.array(*map(F.lit, words))), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("EMPLOYED_BY")


def title_flags(title: Column) -> tuple[Column, Column]:
    """Whether a title sounds like an executive's, and like a board member's."""
    return tuple(F.coalesce(_contains_any(title, F.array(*map(F.lit, words))), F.lit(False)) for words in (EXECUTIVE, BOARD))


def current_child(children: Column) -> Column:
    """Of repeated elements (structs with _current) the one marked current, else null."""
    return F.get(F.filter(children, lambda x: x["_current"] == "true"), 0)


def source_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many nodes have each external id in their JSON."""
    return nodes.agg(*[F.count(F.get_json_object("external_ids", f"$.{k}")).alias(k) for k in keys])


def target_companies(registry: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Names from a registry (name, profile, country): profiles that start with 0, and Canadian names with one of the words;
    each once, in order, as many as the limit."""
    first = registry.where(F.col("profile").startswith("0")).select("name")
    second = registry.where((F.col("country") == "CA") & F.coalesce(_contains_any(F.col("name"), F.array(*[F.lit(w.lower()) for w in words])), F.lit(False))).select("name")
    return first.union(second).distinct().orderBy("name").limit(limit)
