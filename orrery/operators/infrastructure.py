"""Technical infrastructure: tags in pages, profiles of domains, and domains that share parts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.pairs import equal_pairs

# Patterns of tags, of content systems (the first that hits counts), registrars and addresses; weights.
TAGS = {
    "analytics": r"(UA-\d{4,10}-\d{1,4}|G-[A-Z0-9]{10,})",
    "gtm": r"(GTM-[A-Z0-9]{6,})",
    "pixel": r"fbq\s*\(\s*['\"]init['\"]\s*,\s*['\"](\d{15,})['\"]",
    "adsense": r"(ca-pub-\d{16})",
}
CMS = {
    "wp-content|wp-includes": "WordPress", r"drupal\.js": "Drupal", "Joomla!": "Joomla", r"ghost\.io": "Ghost", r"squarespace\.com": "Squarespace",
    r"wix\.com": "Wix", r"shopify\.com": "Shopify", r"webflow\.com": "Webflow",
}
REGISTRARS = {
    "godaddy": "GoDaddy", "namecheap": "Namecheap", "cloudflare": "Cloudflare", r"google\s*(domains|llc)": "Google Domains", r"network\s*solutions": "Network Solutions", "tucows": "Tucows",
    "gandi": "Gandi", "porkbun": "Porkbun", "hostinger": "Hostinger", "ionos|1&1": "IONOS", "ovh": "OVH",
}
ADDRESSES = {r"^104\.1[6-9]\.": "Cloudflare", r"^104\.2[0-7]\.": "Cloudflare", r"^13\.[0-9]+\.": "Amazon AWS", r"^52\.[0-9]+\.": "Amazon AWS", r"^35\.[0-9]+\.": "Google Cloud", r"^34\.[0-9]+\.": "Google Cloud"}
WEIGHTS = {
    "registrar": 0.5, "nameserver": 1.5, "ip": 3.0, "asn": 0.5, "hosting": 0.3, "cdn": 0.2, "analytics": 4.0, "gtm": 4.5, "pixel": 3.5, "adsense": 5.0, "ssl_issuer": 0.3, "cms": 0.2, "san": 4.0,
}


def tags(html: Column, kind: str) -> Column:
    """The different tags of a kind in a page, in any case, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)" + TAGS[kind]), F.lit(1)))


def first_match(value: Column, patterns: dict[str, str], other: Column | None = None) -> Column:
    out = None
    for pattern, name in patterns.items():
        hit = value.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(None) if other is None else other)


def cms(html: Column) -> Column:
    return first_match(html, CMS)


def registrar(name: Column) -> Column:
    """The registrar's usual name, or what is given, trimmed."""
    return first_match(name, REGISTRARS, F.trim(name))


def nameserver(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\.$", "")


def provider(ip: Column) -> Column:
    return first_match(ip, ADDRESSES)


def certificate(issuer: Column, names: Column) -> Column:
    return F.substring(F.sha2(F.concat(issuer, F.lit(":"), F.array_join(F.array_sort(names), ",")), 256), 1, 16)


def page_tags(pages: DataFrame) -> DataFrame:
    """(domain, html) -> domain, kind, value: each tag and the content system."""
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    kinds = F.array(*[F.transform(tags(F.col("html"), k), named(k)) for k in TAGS])
    system = F.when(cms(F.col("html")).isNotNull(), F.array(F.struct(F.lit("cms").alias("kind"), cms(F.col("html")).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    return pages.select("domain", F.explode(F.concat(F.flatten(kinds), system)).alias("t")).select("domain", "t.kind", "t.value").distinct()


def profile_signals(profiles: DataFrame) -> DataFrame:
    """Profiles (domain, registrar, nameservers, ips, asns, issuer, sans; arrays but for registrar and issuer) -> domain, kind, value.
    A domain's own names do not count among its certificate's."""
    one = lambda kind, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), c.alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    many = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    own = F.array(F.col("domain"), F.concat(F.lit("www."), "domain"))
    every = F.concat(
        one("registrar", registrar(F.col("registrar"))), many("nameserver", F.transform("nameservers", nameserver)), many("ip", F.col("ips")), many("asn", F.col("asns")), one("ssl_issuer", F.col("issuer")), many("san", F.array_except("sans", own))
    )
    return profiles.select("domain", F.explode(every).alias("t")).select("domain", "t.kind", "t.value").distinct()


#: Kinds that a domain has one value of at most. A registrar's or issuer's domains are many and say little of each other.
SINGLE = ("registrar", "ssl_issuer", "cms")


def shared(signals: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of domains (a < b) with the kinds and values that they share, of a score of `least` or more: score = sum of weights,
    confidence = score / 10 (at most 1), signals (sorted).

    Pairs meet by (kind, value), block by block where many domains have it. If the kinds that a domain has but one
    value of cannot reach `least` together, they bring no pair together, and are only looked up for pairs that others brought.
    """
    late = SINGLE if sum(WEIGHTS[k] for k in SINGLE) < least else ()
    one = signals.select("domain", "kind", "value").where(~F.col("kind").isin(*late)) if late else signals.select("domain", "kind", "value")
    pairs = equal_pairs(one, ["kind", "value"], "domain")
    if late:
        own = signals.where(F.col("kind").isin(*late)).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("own"))
        met = pairs.select("a", "b").distinct()
        of = lambda end: own.select(F.col("domain").alias(end), F.col("own").alias(f"of_{end}"))
        known = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.explode(F.map_filter("of_a", lambda k, v: F.col("of_b")[k] == v)).alias("kind", "value"))
        pairs = pairs.select("a", "b", "kind", "value").unionByName(known)
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])[F.col("kind")]
    scored = pairs.groupBy("a", "b").agg(F.sum(weight).alias("score"), F.array_sort(F.collect_list(F.concat_ws("=", "kind", "value"))).alias("signals"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return scored.where(F.col("score") >= least).withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 10))


def infra_edges(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """SHARED_INFRA edges of pairs of enough confidence, with a category: analytics, hosting, certificate or infrastructure."""
    has = lambda *kinds: F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))
    category = F.when(has("analytics", "gtm", "pixel", "adsense"), "analytics").when(has("ip", "hosting", "asn"), "hosting").when(has("san", "ssl_issuer"), "certificate").otherwise("infrastructure")
    return pairs.where(F.col("confidence") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SHARED_INFRA").alias("rel_type"), "confidence", category.alias("category"))


# networks' owners and what they sell.
NETWORKS = {
    "AS13335": ("Cloudflare", "cdn"), "AS16509": ("Amazon AWS", "hosting"), "AS15169": ("Google Cloud", "hosting"), "AS8075": ("Microsoft Azure", "hosting"), "AS20940": ("Akamai", "cdn"), "AS54113": ("Fastly", "cdn"),
    "AS14061": ("DigitalOcean", "hosting"), "AS63949": ("Linode/Akamai", "hosting"), "AS20473": ("Vultr", "hosting"), "AS26496": ("GoDaddy", "hosting"), "AS16276": ("OVH", "hosting"), "AS24940": ("Hetzner", "hosting"),
    "AS397998": ("Vercel", "hosting"), "AS209242": ("Netlify", "hosting"),
}


def network(asn: Column) -> tuple[Column, Column]:
    """Owner and kind (cdn or hosting) of a network, or null."""
    return tuple(F.create_map(*[x for k, v in NETWORKS.items() for x in (F.lit(k), F.lit(v[i]))])[asn] for i in (0, 1))


def strongest_kind(kinds: Column) -> Column:
    """The first kind of a weight of three or more, else null."""
    strong = F.array(*[F.lit(k) for k, w in WEIGHTS.items() if w >= 3])
    return F.get(F.filter(kinds, lambda k: F.array_contains(strong, k)), 0)


# What pages are built with.
TECHNOLOGIES = {
    "React": r"react\.production|__REACT_DEVTOOLS", "Vue.js": r"vue\.js|__VUE__", "Angular": r"ng-app|angular\.js", "jQuery": r"jquery\.js|jquery\.min\.js", "Next.js": r"_next/static|__NEXT_DATA__",
    "Cloudflare": r"cloudflareinsights|cf-ray",
}


def technologies(html: Column) -> Column:
    """All that a page is built with, in the order above; none for a null."""
    found = [F.when(F.coalesce(html.rlike("(?i)" + pattern), F.lit(False)), F.lit(name)) for name, pattern in TECHNOLOGIES.items()]
    return F.array_compact(F.array(*found))
