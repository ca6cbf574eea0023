"""Range and instant selectors, counter rates, and grouped results over samples.

Samples are rows ``(labels map, ts_ms long, value double, block_ord int)``; a
series is known by its sorted labels (``label_key``), added where missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.labels import fingerprint, label_key, label_or_blank
from seriesforge.operators.matchers import Matcher, filter_series

#: Width of the time partitions of stored blocks.
BLOCK_MS = 7_200_000


def union_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """All samples of blocks, duplicates included; ``block_ord`` is the block's place in the list."""
    if not blocks:
        raise ValueError("no blocks")
    out = blocks[0].withColumn("block_ord", F.lit(0))
    for i, b in enumerate(blocks[1:], 1):
        out = out.unionByName(b.withColumn("block_ord", F.lit(i)))
    return out


def time_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Samples from start to end, both included; partitions of stored blocks are pruned as well."""
    out = df.where(F.col("ts_ms").between(start, end))
    if "block_start" in df.columns:
        out = out.where(F.col("block_start").between(start - start % BLOCK_MS, end))
    return out


def select(samples: DataFrame, matchers: Iterable[Matcher], start: int, end: int) -> DataFrame:
    """Samples of the matching series in a time range, with ``label_key``; unordered."""
    out = time_range(filter_series(samples, matchers), start, end)
    return out if "label_key" in out.columns else out.withColumn("label_key", label_key(F.col("labels")))


def range_select(samples: DataFrame, matchers: Iterable[Matcher], start: int, end: int) -> DataFrame:
    """The range selector: samples by series (signed id, then labels), time and block order; blocks are not deduplicated."""
    out = select(samples, matchers, start, end)
    if "series_id" not in out.columns:
        # once a series, not once a sample
        ids = out.select("label_key").distinct().select("label_key", fingerprint(F.col("label_key")).alias("series_id"))
        out = out.join(ids, "label_key", "left").select(*out.columns, "series_id")
    return out.orderBy("series_id", "label_key", "ts_ms", "block_ord")


def instant_select(samples: DataFrame, matchers: Iterable[Matcher], ts: int) -> DataFrame:
    """Each series' last sample at ts or before, however old; of equal times the later block's."""
    last = F.max(F.struct("ts_ms", "block_ord", "value")).alias("x")
    return select(samples, matchers, 0, ts).groupBy("label_key").agg(last).select("label_key", "x.ts_ms", "x.value")


def counter_rates(samples: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Increase per second of each series of two samples or more; a fall is a reset and counts from zero.

    ``by`` columns are constant in a series and are kept.  No elapsed time gives 0.
    One exchange by series serves the window and the aggregation.
    """
    order = Window.partitionBy("label_key").orderBy("ts_ms", "block_ord")
    before = F.lag("value").over(order)
    steps = samples.withColumn("_step", F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")).otherwise(0.0))
    elapsed = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    kept = [F.first(c).alias(c) for c in by]
    return (
        steps.groupBy("label_key").agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum("_step"), elapsed), F.lit(0.0)).alias("rate"), *kept)
        .where("n >= 2")
    )


def rate_sum_by(samples: DataFrame, matchers: Iterable[Matcher], label: str, start: int, end: int) -> DataFrame:
    """Sum of counter rates by a label, blank where missing; series of one sample are left out."""
    picked = select(samples, matchers, start, end).withColumn(label, label_or_blank(F.col("labels"), label))
    return counter_rates(picked, [label]).groupBy(label).agg(F.sum("rate").alias("rate"))


def avg_by(samples: DataFrame, matchers: Iterable[Matcher], label: str, start: int, end: int) -> DataFrame:
    """Mean of all samples by a label, blank where missing."""
    picked = time_range(filter_series(samples, matchers), start, end)
    return picked.groupBy(label_or_blank(F.col("labels"), label).alias(label)).agg(F.avg("value").alias("avg_value"))
