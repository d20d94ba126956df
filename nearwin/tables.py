"""The driver tables in the shapes that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwin.spec import FeatureSpec

ORDERS = FeatureSpec(("price", "day"), ("priority",), "label")
PARTS = FeatureSpec(("p_size",), ("p_brand", "p_type"), "p_retailprice", "p_partkey")
DIMS = 64

#: The same shapes for the oracle.
ORDERS_SQL = "SELECT o_orderkey AS id, o_totalprice AS price, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, o_orderpriority AS priority, o_orderstatus AS label, o_custkey AS cust FROM orders"
GAPPED_SQL = "SELECT id, CASE WHEN id % 7 <> 0 THEN price END AS price, CASE WHEN id % 5 <> 0 THEN day END AS day, CASE WHEN id % 11 <> 0 THEN priority END AS priority, label FROM o"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), day.alias("day"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("cust"))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing values by rule."""
    return orders(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("price")).alias("price"), F.when(F.col("id") % 5 != 0, F.col("day")).alias("day"), F.when(F.col("id") % 11 != 0, F.col("priority")).alias("priority"), "label")


def asked(df: DataFrame, key: str = "id") -> DataFrame:
    """The query set: every row whose key is divisible by 100."""
    return df.filter(F.col(key) % 100 == 0)
