"""Names and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The suffixes that each normaliser removes, in its order.
ORG_SUFFIXES = [
    r"\bInc\.?$", r"\bIncorporated$", r"\bLtd\.?$", r"\bLimited$", r"\bLLC$", r"\bL\.?L\.?C\.?$", r"\bLLP$", r"\bL\.?L\.?P\.?$", r"\bCorp\.?$", r"\bCorporation$", r"\bFoundation$",
    r"\bAssociation$", r"\bAssoc\.?$", r"\bCo\.?$", r"\bCompany$", r"\bPC$", r"\bPLC$", r"\bPLLC$", r"\bPA$", r"\bP\.?A\.?$", r"\bNA$", r"\bN\.?A\.?$",
]
SPONSOR_SUFFIXES = [
    "inc", "inc.", "incorporated", "corp", "corp.", "corporation", "ltd", "ltd.", "limited", "llc", "l.l.c.", "llp", "l.l.p.", "co", "co.", "company", "foundation", "trust",
    "association", "society", "institute", "pac", "super pac",
]
REGISTRY_SUFFIXES = [r"\binc\.?\b", r"\bltd\.?\b", r"\blimited\b", r"\bcorp\.?\b", r"\bcorporation\b", r"\bcompany\b", r"\bco\.?\b", r"\bltée\b", r"\bincorporated\b", r"\bllc\b", r"\bplc\b"]
COMPANY_SUFFIXES = [
    r"\s+INC\.?$", r"\s+INCORPORATED$", r"\s+CORP\.?$", r"\s+CORPORATION$", r"\s+LTD\.?$", r"\s+LIMITED$", r"\s+LLC\.?$", r"\s+L\.?L\.?C\.?$", r"\s+LLP\.?$", r"\s+L\.?L\.?P\.?$",
    r"\s+CO\.?$", r"\s+COMPANY$", r"\s+PLC\.?$", r"\s+LP\.?$", r"\s+L\.?P\.?$", r"\s+HOLDINGS?$", r"\s+GROUP$", r"\s+TRUST$", r"\s+FUND$", r"\s+ENTERPRISES?$",
]


def squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def organisation(name: Column) -> Column:
    """Upper case; a suffix at the end goes, in the list's order; letters, digits and single blanks stay. What a removed suffix
    leaves ends in a blank, so a second suffix stays unless nothing stands between."""
    out = F.upper(F.coalesce(name, F.lit("")))
    for suffix in ORG_SUFFIXES:
        out = F.regexp_replace(out, "(?i)" + suffix, "")
    return squeeze(F.regexp_replace(out, r"[^A-Z0-9\s]", ""))


def sponsor(name: Column) -> Column:
    """Lower case; each suffix after a blank, with a comma before that, goes from the end, in the list's order."""
    out = F.trim(F.lower(name))
    for suffix in SPONSOR_SUFFIXES:
        out = F.trim(F.regexp_replace(out, rf",? \Q{suffix}\E$", ""))
    return out


def registry(name: Column) -> Column:
    """Lower case; suffixes go wherever they stand; punctuation becomes a blank."""
    out = F.lower(name)
    for suffix in REGISTRY_SUFFIXES:
        out = F.regexp_replace(out, "(?U)" + suffix, "")
    return squeeze(F.regexp_replace(out, r"(?U)[^\w\s]", " "))


def company(name: Column) -> Column:
    """Upper case; a suffix after a blank goes from the end, in the list's order; punctuation becomes a blank."""
    out = F.upper(F.coalesce(name, F.lit("")))
    for suffix in COMPANY_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    return squeeze(F.regexp_replace(out, r"(?U)[^\w\s]", " "))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def format_ein(value: Column) -> Column:
    """12-3456789 from nine digits, however they are written; others stay."""
    clean = digits(value)
    return F.when(F.length(clean) == 9, F.concat_ws("-", F.substring(clean, 1, 2), F.substring(clean, 3, 7))).otherwise(value)


def normalise_bn(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), r"[\s-]", "")


def valid_ein(value: Column) -> Column:
    return value.rlike(r"^\d{2}-\d{7}$")


def valid_bn(value: Column) -> Column:
    return value.rlike(r"^\d{9}RR\d{4}$")


def postal_code(value: Column) -> Column:
    """A1A 1A1, or null."""
    clean = F.regexp_replace(F.upper(value), r"[\s-]", "")
    return F.when(clean.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"), F.concat_ws(" ", F.left(clean, F.lit(3)), F.right(clean, F.lit(3))))


def postal_boost(a: Column, b: Column) -> Column:
    """0.1 for equal codes, 0.05 for the same first three characters, else (or null) 0."""
    x, y = (F.regexp_replace(F.upper(c), r"[\s-]", "") for c in (a, b))
    known = (F.coalesce(F.length(x), F.lit(0)) > 0) & (F.coalesce(F.length(y), F.lit(0)) > 0)
    return F.when(known & (x == y), 0.1).when(known & (F.left(x, F.lit(3)) == F.left(y, F.lit(3))), 0.05).otherwise(0.0)


def surrogate_id(*parts: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8))


def record_hash(*parts: Column) -> Column:
    """md5 of the parts, nulls as empty, joined by bars."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def name_variations(name: Column) -> Column:
    """Different ways to search for a name, in order: as it is, without punctuation, without suffix, both, each word
    capitalised and joined, lower case and joined, the first three words of more than two letters."""
    plain = squeeze(F.regexp_replace(name, r"[^\w\s]", " "))
    bare = squeeze(F.regexp_replace(name, r"(?i),?\s+(inc|ltd|llc|corp|co|limited|corporation|foundation)\.?$", ""))
    both = squeeze(F.regexp_replace(bare, r"[^\w\s]", " "))
    pascal = F.regexp_replace(F.initcap(both), " ", "")
    three = F.array_join(F.slice(F.filter(F.split(both, " "), lambda w: F.length(w) > 2), 1, 3), " ")
    return F.filter(F.array_distinct(F.array(name, plain, bare, both, pascal, F.lower(pascal), three)), lambda x: F.length(x) > 0)
