"""A ledger over the driver's tables, for the queries and, word for word, for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signed movements. Nations are a dimension of fixed size; customers join by key, as Spark sees fit."""
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(F.broadcast(nations), customers["c_nationkey"] == nations["n_nationkey"])
    key, nation = F.col("o_orderkey"), F.col("n_nationkey")
    abroad = nation != 0
    cents = F.when(F.col("o_orderstatus") == "P", 1).otherwise(-1) * F.round(F.col("o_totalprice") * 100).cast("bigint")
    priced = abroad & (key % 5 != 0)
    rate = F.lit(1.0) + nation / 10.0
    return joined.select(
        key.alias("id"), F.col("c_mktsegment").alias("account"), F.to_date("o_orderdate").alias("posted_on"), cents.alias("amount_cents"), F.col("c_name").alias("merchant"),
        F.when(key % 11 == 0, "Uncategorized").otherwise(F.col("o_orderpriority")).alias("category"), F.concat(F.lit("SQ *"), F.col("c_name"), F.lit(" #"), key.cast("string")).alias("raw_description"),
        F.when(abroad, F.col("n_name")).alias("country"), (key % 37 == 0).alias("is_fee"), F.when(priced, F.concat(F.lit("C"), nation.cast("string"))).alias("original_currency"),
        F.when(priced, rate).alias("fx_rate"), F.when(priced, F.round(F.abs(cents) * rate).cast("bigint")).alias("original_amount_cents"), nation.alias("scope"),
    )


LEDGER = """ledger AS (
  SELECT o_orderkey AS id, c_mktsegment AS account, CAST(o_orderdate AS DATE) AS posted_on,
    (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END) * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
    c_name AS merchant, CASE WHEN o_orderkey % 11 = 0 THEN 'Uncategorized' ELSE o_orderpriority END AS category,
    'SQ *' || c_name || ' #' || CAST(o_orderkey AS VARCHAR) AS raw_description,
    CASE WHEN n_nationkey <> 0 THEN n_name END AS country, o_orderkey % 37 = 0 AS is_fee,
    CASE WHEN n_nationkey <> 0 AND o_orderkey % 5 <> 0 THEN 'C' || CAST(n_nationkey AS VARCHAR) END AS original_currency,
    CASE WHEN n_nationkey <> 0 AND o_orderkey % 5 <> 0 THEN 1.0::DOUBLE + n_nationkey / 10.0::DOUBLE END AS fx_rate,
    CASE WHEN n_nationkey <> 0 AND o_orderkey % 5 <> 0 THEN CAST(round(abs((CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END) * CAST(round(o_totalprice * 100) AS BIGINT)) * (1.0::DOUBLE + n_nationkey / 10.0::DOUBLE)) AS BIGINT) END AS original_amount_cents,
    n_nationkey AS scope
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series for the recurring queries: merchant is user and type, cents the value's."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("merchant"), F.to_date("ts").alias("day"), F.col("event_id").alias("ord"),
        (-F.round(F.col("value") * 100).cast("bigint") - 1).alias("cents"), F.col("event_type").alias("category"),
    )


SERIES = """series AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) || '-' || event_type AS merchant, CAST(ts AS DATE) AS day, event_id AS ord, -CAST(round(value * 100) AS BIGINT) - 1 AS cents, event_type AS category FROM events
)"""
