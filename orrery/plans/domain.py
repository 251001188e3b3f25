"""The domain's nodes, edges and events as projections of the generic tables, and the same as SQL common tables.

Recipients are customers, funders and boards are suppliers, people are parts, grants are line items. Amounts
stay decimal until they leave a query, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per grant line: src (recipient), dst (funder), fiscal_year, amount, shipped, day."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    heads = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    amount = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.year("o_orderdate").alias("fiscal_year"),
        amount.alias("amount"), F.to_date("l_shipdate").alias("shipped"), F.col("o_orderdate").alias("ordered"),
    )


def funded_by(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """FUNDED_BY: src (recipient), dst (funder), fiscal_year, amount, valid_from, valid_to. One edge a year."""
    rows = grants(spark, sf_dir)
    if year is not None:
        rows = rows.where((F.col("ordered") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("ordered") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return rows.groupBy("src", "dst", "fiscal_year").agg(F.sum("amount").alias("amount"), F.min("shipped").alias("valid_from"), F.max("shipped").alias("valid_to"))


def director_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIRECTOR_OF: src (person), dst (organisation)."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst")).distinct()


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients and funders: id, name, entity_type, jurisdiction, confidence."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("jurisdiction"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("balance"))
    every = customers.unionByName(suppliers)
    confidence = F.when(F.col("balance") > 5000, 0.9).when(F.col("balance") > 0, 0.7).otherwise(0.4)
    return every.join(F.broadcast(nation), "n_nationkey").select("id", "name", F.lit("ORGANIZATION").alias("entity_type"), "jurisdiction", confidence.alias("confidence"))


def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, ts, event_type, value, k (from the properties)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


# The same as SQL.
GRANTS = """grants AS (
  SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_orderdate AS ordered,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS amount, CAST(l_shipdate AS DATE) AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FUNDED = GRANTS + """, funded AS (
  SELECT src, dst, fiscal_year, sum(amount) AS amount, min(shipped) AS valid_from, max(shipped) AS valid_to
  FROM grants GROUP BY src, dst, fiscal_year)"""
DIRECTORS = "directors AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem)"
ORGS = """orgs AS (
  SELECT id, name, r_name AS jurisdiction, CAST(CASE WHEN balance > 5000 THEN 0.9 WHEN balance > 0 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence FROM (
    SELECT 'C' || c_custkey AS id, c_name AS name, c_nationkey AS n, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'S' || s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier) o
  JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EVENTS = "ev AS (SELECT event_id, user_id AS entity_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
