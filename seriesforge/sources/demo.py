"""Deterministic demo samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import NAME_LABEL, label_map


def demo_samples(spark: SparkSession, n_series: int, n_samples: int) -> DataFrame:
    """Series s has service svc-(s % 5) and instance pod-s; sample i is at i * 15000 with s * 1000 + i."""
    # one range of both indices: no cross join
    i = spark.range(n_series * n_samples).select((F.col("id") / n_samples).cast("long").alias("s"), (F.col("id") % n_samples).alias("i"))
    labels = label_map(**{NAME_LABEL: "http_requests_total", "service": F.concat(F.lit("svc-"), F.col("s") % 5), "instance": F.concat(F.lit("pod-"), F.col("s"))})
    return i.select(labels.alias("labels"), (F.col("i") * 15000).alias("ts_ms"), (F.col("s") * 1000 + F.col("i")).cast("double").alias("value"))
