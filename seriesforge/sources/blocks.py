"""Immutable blocks as Parquet: samples clustered by series and time, partitioned by two hours, with a series table and meta.json."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.functions.labels import block_id, canonical, fingerprint, intervals_overlap, label_key
from seriesforge.operators.matchers import Matcher, filter_series
from seriesforge.operators.selectors import BLOCK_MS, time_range

#: Samples of a chunk.
CHUNK = 120


def block_meta(samples: DataFrame, window_ms: int | None = None) -> DataFrame:
    """id, min_ts, max_ts, series_count, sample_count of all samples, or of each time window."""
    keys = [] if window_ms is None else [(F.col("ts_ms") - F.col("ts_ms") % window_ms).alias("block_start")]
    g = samples.groupBy(*keys).agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count_distinct("label_key").alias("series_count"), F.count("*").alias("sample_count"))
    return g.select(block_id(F.col("min_ts"), F.col("max_ts")).alias("id"), *([] if window_ms is None else ["block_start"]), "min_ts", "max_ts", "series_count", "sample_count")


def validate_meta(id: str, min_ts: int, max_ts: int, series_count: int, sample_count: int) -> None:
    if not id:
        raise ValueError("block id is empty")
    if min_ts > max_ts:
        raise ValueError("min_ts is after max_ts")
    if series_count < 0 or sample_count < 0:
        raise ValueError("counts are negative")


def chunk_index(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """label_key, chunk_no, min_ts, max_ts, sample_count: runs of ``size`` samples of each series in time."""
    order = Window.partitionBy("label_key").orderBy("ts_ms")
    numbered = samples.withColumn("chunk_no", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    return numbered.groupBy("label_key", "chunk_no").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("sample_count"))


def prune_chunks(chunks: DataFrame, start: int, end: int) -> DataFrame:
    return chunks.where(intervals_overlap(F.col("min_ts"), F.col("max_ts"), start, end))


def duplicate_times(samples: DataFrame) -> DataFrame:
    """Times that a series of one block has several times; a block must have none."""
    return samples.groupBy("label_key", "ts_ms").agg(F.count("*").alias("n")).where("n > 1")


def write_block(samples: DataFrame, path: str, check: bool = True, part: str = "", more: dict | None = None, stored: bool = False) -> dict:
    """Write ``samples(labels, ts_ms, value)`` as a block, replacing what is there; the meta data, with ``more`` added.

    part, such as ``block=3``, puts the block beside others under one path.  The meta data are written last.
    stored: the samples lie in files, so they are read twice instead of held with their label sets.
    Raises on an empty block, on repeated times of a series, and where label sets share a series id.
    """
    spark = samples.sparkSession
    where = {name: f"{path}/{name}/{part}".rstrip("/") for name in ("samples", "series", "chunks", "meta")}
    rows = samples.select(label_key(F.col("labels")).alias("label_key"), "ts_ms", "value")
    k = F.col("label_key")
    # what is sorted is held, as a sort reads its input twice
    rows = rows if stored else rows.persist()
    series = rows.select(k).distinct().select(fingerprint(k).alias("series_id"), k, canonical(k).alias("canonical"), F.map_from_entries(k).alias("labels")).persist()
    numbered = rows.join(series.select("label_key", "series_id"), "label_key").select("series_id", "ts_ms", "value", (F.col("ts_ms") - F.col("ts_ms") % BLOCK_MS).alias("block_start"))
    numbered = numbered.persist() if stored else numbered
    try:
        if rows.isEmpty():
            raise ValueError("an empty block")
        series.orderBy("series_id").write.mode("overwrite").parquet(where["series"])
        if check and not series.groupBy("series_id").count().where("count > 1").isEmpty():
            raise ValueError("label sets share a series id")
        numbered.repartitionByRange("block_start", "series_id").sortWithinPartitions("block_start", "series_id", "ts_ms").write.mode("overwrite").partitionBy("block_start").option("compression", "zstd").parquet(where["samples"])
        n_series = series.count()
    finally:
        numbered.unpersist()
        series.unpersist()
        rows.unpersist()
    # each window of a series is a chunk; a time held twice shows as fewer distinct times than samples
    chunks = _chunks(spark.read.schema(_SAMPLES).parquet(where["samples"])).persist()
    try:
        chunks.orderBy("series_id", "block_start").write.mode("overwrite").parquet(where["chunks"])
        if check and not chunks.where("distinct_times < sample_count").isEmpty():
            raise ValueError("a series has a time twice")
        found = chunks.agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.lit(n_series).cast("long").alias("series_count"), F.sum("sample_count").alias("sample_count"))
        meta = found.select(block_id(F.col("min_ts"), F.col("max_ts")).alias("id"), *found.columns).first()
    finally:
        chunks.unpersist()
    validate_meta(*meta)
    out = {**meta.asDict(), **(more or {})}
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(where["meta"])
    return out


_SAMPLES = "series_id long, ts_ms long, value double, block_start long"
#: Ids up to which matched series are sent to the scan as a filter.
MAX_IDS = 1000


def _chunks(stored: DataFrame) -> DataFrame:
    return stored.groupBy("series_id", "block_start").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("sample_count"), F.count_distinct("ts_ms").alias("distinct_times"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, min_ts long, max_ts long, series_count long, sample_count long"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/meta")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/series")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """series_id, block_start, min_ts, max_ts, sample_count: what the block says of each series' chunk of a window."""
    return spark.read.parquet(f"{path}/chunks").drop("distinct_times")


def entry(spark: SparkSession, path: str, series_id: int) -> DataFrame:
    """Labels and chunks of one series; no row for an unknown id."""
    chunks = read_chunks(spark, path).where(F.col("series_id") == series_id)
    return read_series(spark, path).where(F.col("series_id") == series_id).join(chunks, "series_id").select("series_id", "canonical", "min_ts", "max_ts", "sample_count").orderBy("min_ts")


def check_chunks(spark: SparkSession, path: str) -> None:
    """Raise where chunks and stored samples disagree."""
    own = _chunks(spark.read.schema(_SAMPLES).parquet(f"{path}/samples")).drop("distinct_times")
    said = read_chunks(spark, path)
    if not own.exceptAll(said.select(own.columns)).isEmpty() or not said.select(own.columns).exceptAll(own).isEmpty():
        raise ValueError("chunk data do not match the samples")


def read_block(spark: SparkSession, path: str, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None, parts: int = 0) -> DataFrame:
    """Samples of a block with labels.

    Matchers and a time range are resolved on series and chunks first: up to
    ``MAX_IDS`` ids of series that have a chunk in the range become a filter of the scan, which
    row groups sorted by id are pruned by; more are joined.  parts: how many blocks
    lie under the path, each a partition ``block``.
    """
    schema = _SAMPLES + (", block int" if parts else "")
    samples, series, chunks = spark.read.schema(schema).parquet(f"{path}/samples"), read_series(spark, path), read_chunks(spark, path)
    if parts:
        samples, series, chunks = (df.where(F.col("block") < parts) for df in (samples, series, chunks))
    matchers = list(matchers)
    if matchers:
        series = filter_series(series, matchers)
    if start is not None:
        samples = time_range(samples, start, end)
        series = series.join(prune_chunks(chunks, start, end).select("series_id", *(["block"] if parts else [])).distinct(), ["series_id", *(["block"] if parts else [])], "left_semi")
    if matchers or start is not None:
        ids = [r[0] for r in series.select("series_id").distinct().limit(MAX_IDS + 1).collect()]
        if len(ids) <= MAX_IDS:
            samples = samples.where(F.col("series_id").isin(ids)) if ids else samples.where(F.lit(False))
    keys = ["series_id", *(["block"] if parts else [])]
    return samples.join(series.select(*keys, "label_key", "labels"), keys)
