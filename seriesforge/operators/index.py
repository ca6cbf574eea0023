"""The inverted index: series, postings, and set operations on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import canonical, fingerprint, label_key, valid_labels


def series_table(samples: DataFrame) -> DataFrame:
    """Distinct series: series_id, label_key, canonical, labels.  Fingerprints are computed once a series."""
    keys = samples.select(label_key(F.col("labels")).alias("label_key")).distinct()
    k = F.col("label_key")
    return keys.select(fingerprint(k).alias("series_id"), k, canonical(k).alias("canonical"), F.map_from_entries(k).alias("labels"))


def check_labels(samples: DataFrame) -> DataFrame:
    """The samples; running it fails on an invalid label set or a negative time."""
    ok = valid_labels(F.col("labels")) & (F.col("ts_ms") >= 0)
    return samples.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid labels or negative time")).cast("boolean")))


def colliding(series: DataFrame) -> DataFrame:
    """Fingerprints that several label sets share; storage by id alone would merge them."""
    return series.groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1")


def postings(series: DataFrame) -> DataFrame:
    """(label, label_value, series_id) for each label of each series."""
    return series.select(F.explode("labels").alias("label", "label_value"), "series_id")


def posting_list(series: DataFrame, label: str, value: str) -> DataFrame:
    """Ids of the series with a label of a value; the filter stands before the explode."""
    return series.where(F.try_element_at("labels", F.lit(label)) == value).select("series_id").distinct()


def posting_arrays(series: DataFrame) -> DataFrame:
    """label, label_value and ids, the rising array of all their series; for lists that fit a row."""
    return postings(series).groupBy("label", "label_value").agg(F.array_sort(F.collect_set("series_id")).alias("ids"))


def posting_ids(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """A posting list of given ids, which have to rise."""
    if any(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True)):
        raise ValueError("ids do not rise")
    return spark.createDataFrame([(i,) for i in ids], "series_id long")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def exact_match(series: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Series with all the labels given; none given: all."""
    for k, v in labels.items():
        series = series.where(F.coalesce(F.try_element_at("labels", F.lit(k)) == v, F.lit(False)))
    return series


def select_exact(samples: DataFrame, series: DataFrame, labels: dict[str, str], start: int, end: int) -> DataFrame:
    """Samples of exactly matching series, by a semi-join with the index: on ids where samples have them, else on sorted labels."""
    key = "series_id" if "series_id" in samples.columns else "label_key"
    wanted = exact_match(series, labels).select(key)
    return samples.where(F.col("ts_ms").between(start, end)).join(wanted, key, "left_semi")


def labels_of(series: DataFrame, series_id: int) -> DataFrame:
    return series.where(F.col("series_id") == series_id).select("labels")
