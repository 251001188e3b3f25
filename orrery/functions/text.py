"""Text: neutral language, identifiers and organisations in running text, kinds of text, plain text of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Pattern and neutral wording, applied in this order to text in any case.
NEUTRAL = [
    (r"\bcoordinat(ed|ing|ion)\b", "concurrent"), (r"\bcollusion\b", "overlap in activities"), (r"\b(dark|shadow|hidden)\s+network\b", "relationship pattern"), (r"\bscheme\b", "arrangement"),
    (r"\bshell\s+compan(y|ies)\b", "limited-activity entity"), (r"\bfront\s+group\b", "affiliated organization"), (r"\bpuppet\s+(organization|outlet|entity)\b", r"associated $1"),
    (r"\b(money\s+)?launder(ing|ed)\b", "fund flow pattern"), (r"\bastroturf(ing)?\b", "organized campaign activity"), (r"\bpropaganda\b", "messaging"), (r"\bmanipulat(ion|ing|ed)\b", "influence"),
    (r"\bdeceiv(e|ing|ed)\b", "present"), (r"\b(hid(e|den|ing)|conceal(ed|ing)?)\b", "not publicly disclosed"), (r"\bsecret(ly)?\b", "undisclosed"), (r"\bexpos(e|ed|ing)\b", "document"),
    (r"\bcorrupt(ion|ed)?\b", "concerning pattern"), (r"\billegal(ly)?\b", "potentially non-compliant"), (r"\bcriminal\b", "requiring legal review"),
]


def neutral(text: Column) -> Column:
    for pattern, words in NEUTRAL:
        text = F.regexp_replace(text, "(?i)" + pattern, words)
    return text


def accusations(text: Column) -> Column:
    """How many accusing wordings a text holds."""
    return sum((F.regexp_count(text, F.lit("(?i)" + p)) for p, _ in NEUTRAL), F.lit(0))


def qualified(text: Column, confidence: Column) -> Column:
    """A hedge by confidence before the text: one of three per band, chosen by the text's hash, so it never changes."""
    bands = {  # fixed values
        0.8: ["Based on strong evidence,", "Documentation shows that", "Records show that"], 0.5: ["Available data suggests that", "It appears that", "Evidence indicates that"],
        0.0: ["Limited data may suggest that", "Preliminary analysis indicates that", "It is possible that"],
    }
    pick = F.pmod(F.xxhash64(text), F.lit(3)).cast("int") + 1
    out = None
    for least, hedges in bands.items():
        words = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, hedges)), pick), text)
        out = F.when(confidence >= least, words) if out is None else out.when(confidence >= least, words)
    return out


# Patterns and wording that soften absolute claims, in this order.
ABSOLUTE = [
    (r"\bdefinitely\b", "likely"), (r"\bcertainly\b", "appears to"), (r"\bproves?\b", "suggests"), (r"\bconfirms?\b", "is consistent with"), (r"\bdemonstrates?\b", "indicates"), (r"\bestablishes?\b", "suggests"),
    (r"\bundeniably\b", ""), (r"\bclearly\b", ""), (r"\bobviously\b", ""), (r"\bwithout\s+doubt\b", ""), (r"\bwithout\s+question\b", ""),
]


def softened(text: Column) -> Column:
    for pattern, words in ABSOLUTE:
        text = F.regexp_replace(text, "(?i)" + pattern, words)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_EIN = re.compile(r"\b\d{2}-\d{7}\b")
_BN = re.compile(r"\b\d{9}[A-Z]{2}\d{4}\b", re.I)
_DOMAIN = re.compile(r"(?<![@/\w.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|org|net|ca|info|news|media|co|io|gov|edu|example)\b", re.I)
_URL = re.compile(r"https?://\S+", re.I)
_ORG = re.compile(r"(?:[A-Z][\w&'-]*\s+){1,6}(?:Inc|Incorporated|Corp|Corporation|Ltd|Limited|LLC|LLP|Co|Company|Foundation|Trust|Association|Society|Institute|Committee|Fund|Organization|Organisation)\b\.?")
#: Mail services, whose domains say nothing about a sender.
WEBMAIL = frozenset("gmail.com yahoo.com hotmail.com outlook.com icloud.com aol.com protonmail.com".split())


def find_entities(text: str) -> list[tuple[str, str, float, int, int, str]]:
    """(kind, value, confidence, start, end, context of 50 characters to each side), each value once per place."""
    found = [("ein", m, 1.0) for m in _EIN.finditer(text)] + [("bn", m, 1.0) for m in _BN.finditer(text)] + [("organization", m, 0.85) for m in _ORG.finditer(text)]
    inside = [m.span() for m in _URL.finditer(text)]
    found += [("domain", m, 0.8) for m in _DOMAIN.finditer(text) if m[0].lower() not in WEBMAIL and not any(a <= m.start() < b for a, b in inside)]
    seen, out = set(), []
    for kind, m, confidence in sorted(found, key=lambda x: x[1].start()):
        if (key := (m[0].lower(), m.start())) not in seen:
            seen.add(key)
            out.append((kind, m[0], confidence, m.start(), m.end(), text[max(0, m.start() - 50) : m.end() + 50]))
    return out


def entities(text: Column) -> Column:
    """find_entities() of each text, as an array of structs, in Arrow batches."""
    names = ("kind", "value", "confidence", "start", "stop", "context")

    @F.pandas_udf("array<struct<kind:string,value:string,confidence:double,start:int,stop:int,context:string>>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, x, strict=True)) for x in find_entities(t or "")] for t in texts])

    return apply(text)


def text_kind(text: Column) -> Column:
    """linkedin, email, news, press_release or unknown, by the first 500 characters."""
    head = F.lower(F.substring(text, 1, 500))
    return (
        F.when(head.contains("linkedin"), "linkedin").when(head.startswith("from:") | F.substring(head, 1, 200).contains("subject:"), "email")
        .when(head.contains("reuters") | head.contains("associated press") | head.contains("ap news"), "news").when(head.contains("for immediate release"), "press_release").otherwise("unknown")
    )


def text_valid(text: Column) -> Column:
    size = F.char_length(F.trim(text))
    return (size >= 10) & (size <= 100_000)


def plain_text(html: Column) -> Column:
    """Text of a page without scripts, styles, menus, headers and footers, tags; white space as one blank."""
    for tag in ("script", "style", "nav", "footer", "header"):
        html = F.regexp_replace(html, f"(?is)<{tag}\\b.*?</{tag}\\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


def host(url: Column) -> Column:
    """The host of an http or https address, or null."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^https?://([^/:?#\s]+)", 1), F.lit(""))


def handle(url: Column, network: str) -> Column:
    pattern = {"twitter": r"(?i)(?:twitter|x)\.com/@?([A-Za-z0-9_]{1,15})", "youtube": r"(?i)youtube\.com/(?:@|c/|channel/|user/)([\w-]+)"}[network]
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def number(text: Column) -> Column:
    """A number from text with commas, currency or percent signs; null if it is none."""
    return F.regexp_replace(text, r"[,$%\s]", "").try_cast("double")


def date_of(text: Column, *formats: str) -> Column:
    """The first of the formats that fits, else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in (formats or ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "yyyyMMdd"))])


# Words in a registry's raw type and status, the first that is contained counts.
CORP_TYPES = [
    (["nonprofit", "non-profit", "obnl", "sans but lucratif"], "NONPROFIT"), (["not-for-profit", "not for profit"], "NOT_FOR_PROFIT"), (["cooperative", "coopérative", "co-op", "coop"], "COOPERATIVE"), (["society", "société"], "SOCIETY"),
    (["agricultural"], "AGRICULTURAL"), (["religious"], "RELIGIOUS"), (["unlimited"], "UNLIMITED_LIABILITY"), (["professional"], "PROFESSIONAL"), (["extraprovincial", "extra-provincial"], "EXTRAPROVINCIAL"),
    (["community contribution"], "COMMUNITY_CONTRIBUTION"), (["benefit"], "BENEFIT_COMPANY"), (["business", "corporation", "company", "inc", "ltd"], "FOR_PROFIT"),
]
STATUSES = [
    (["inactive"], "INACTIVE"), (["active", "immatriculée"], "ACTIVE"), (["struck", "cancelled"], "STRUCK"), (["dissolved", "radiée"], "DISSOLVED"), (["amalgamated", "fusionnée"], "AMALGAMATED"),
    (["continued out", "continuée"], "CONTINUED_OUT"), (["continued in"], "CONTINUED_IN"), (["revoked", "révoquée"], "REVOKED"), (["suspended"], "SUSPENDED"),
]


def keyword(text: Column, table: list[tuple[list[str], str]]) -> Column:
    out = None
    for words, name in table:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNKNOWN")


def corp_type(text: Column) -> Column:
    return keyword(text, CORP_TYPES)


def corp_status(text: Column, literal: bool = False) -> Column:
    """literal keeps the known slip by which "inactive" counts as active."""
    return keyword(text, [STATUSES[1], STATUSES[0], *STATUSES[2:]] if literal else STATUSES)
