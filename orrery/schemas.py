"""Canonical schemas, with the checks that their fields must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions import names as N

NODES = "id string, name string, entity_type string, jurisdiction string, confidence double, ein string, bn string, aliases array<string>, props map<string,string>, updated_at timestamp"
EDGES = "id string, rel_type string, src string, dst string, valid_from date, valid_to date, fiscal_year int, amount decimal(28,4), confidence double, evidence_refs array<string>, props map<string,string>"
EVENTS = "id string, event_type string, occurred_at timestamp, entity_ids array<string>, description string, properties string, evidence_ref string"
EVIDENCE = "id string, evidence_type string, source_url string, retrieved_at timestamp, extractor string, extraction_confidence double, content_hash string"
FILING = "ein string, name string, tax_year int, state string, officers array<struct<name:string,title:string>>, grants array<struct<name:string,ein:string,country:string,amount:double>>"
CHARITY = "bn string, name string, city string, province string, postal_code string"
AD = "id string, page_id string, page_name string, funding_entity string, ad_creation_time string, ad_delivery_start_time string, ad_creative_bodies array<string>, spend struct<lower_bound:string,upper_bound:string>, impressions struct<lower_bound:string,upper_bound:string>"
CORPORATION = "number string, name string, status string, bn string, province string"
LOBBYING = "reg_id string, client string, firm string, start string"
SUBMISSION = "cik string, name string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>>>"

ENTITY_TYPES = ["PERSON", "ORGANIZATION", "OUTLET", "DOMAIN", "PLATFORM_ACCOUNT", "SPONSOR", "VENDOR"]
REL_TYPES = ["FUNDED_BY", "DIRECTOR_OF", "EMPLOYED_BY", "SPONSORED_BY", "OWNS", "CITED", "AMPLIFIED", "SHARED_INFRA"]


def node_faults() -> Column:
    """The names of the checks that a node fails."""
    checks = {
        "entity_type": F.col("entity_type").isin(ENTITY_TYPES), "confidence": F.col("confidence").between(0, 1), "ein": F.col("ein").isNull() | N.valid_ein(F.col("ein")), "bn": F.col("bn").isNull() | N.valid_bn(F.col("bn")),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]), lambda x: x.isNotNull())


def checked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without faults, and those with, and their faults."""
    marked = nodes.withColumn("faults", node_faults())
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)
