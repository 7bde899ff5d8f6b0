"""Driver tables and the deterministic "dirty" view used to exercise quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` plus deterministic defects: nulls, bad numbers, day-first date text,
    yes/no flags, x50 outliers, a constant and an empty column, and 2 % duplicate rows.
    The defects are keyed on ``o_orderkey`` so the SQL oracle can build the same view.
    """
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    d = o.select(
        "*",
        F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(price).alias("price_null"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(price.cast("decimal(18,2)").cast("string")).alias("price_text"),
        F.when(k % 17 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date_text"),
        F.when(k % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("flag_text"),
        F.when(k % 97 == 0, price * 50).otherwise(price).alias("price_outlier"),
        F.lit("US").alias("constant_col"),
        F.lit(None).cast("string").alias("empty_col"),
    )
    return d.unionByName(d.where(k % 50 == 0))


DIRTY_ORDERS_SQL = """(
  WITH base AS (
    SELECT *,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price_null,
      CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_text,
      CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_text,
      CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag_text,
      CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price_outlier,
      'US' AS constant_col,
      CAST(NULL AS VARCHAR) AS empty_col
    FROM orders)
  SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0
)"""
