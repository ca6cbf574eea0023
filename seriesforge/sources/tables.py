"""Sample tables made of the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import NAME_LABEL, label_key, label_map


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def events_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: labels event_type and user_id, and region for even users only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    region = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("r"), F.col("user_id") % 3))
    labels = label_map(**{NAME_LABEL: "events_value", "event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string"), "region": region})
    return e.select("event_id", labels.alias("labels"), _ms("ts").alias("ts_ms"), "value", F.lit(0).alias("block_ord"))


def keyed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("label_key", label_key(F.col("labels")))


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem quantities: labels returnflag and linestatus; times repeat, so (orderkey, linenumber) is the arrival order."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    labels = label_map(**{NAME_LABEL: "line_quantity", "returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")})
    return x.select(labels.alias("labels"), _ms("l_shipdate").alias("ts_ms"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(0).alias("block_ord"))


def orders_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: labels orderstatus and orderpriority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    labels = label_map(**{NAME_LABEL: "order_price", "orderstatus": F.col("o_orderstatus"), "orderpriority": F.col("o_orderpriority")})
    return o.select(labels.alias("labels"), _ms("o_orderdate").alias("ts_ms"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("block_ord"))
