"""Compaction: one sample for each series and time out of overlapping blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.labels import label_key
from seriesforge.operators.selectors import union_blocks
from seriesforge.sources.blocks import write_block


def _compact(blocks: Sequence[DataFrame], pick) -> DataFrame:
    rows = union_blocks(blocks)
    if "label_key" not in rows.columns:
        rows = rows.withColumn("label_key", label_key(F.col("labels")))
    # min_by and max_by combine before the exchange, a window would not
    best = rows.groupBy("label_key", "ts_ms").agg(pick("value", "block_ord").alias("value"))
    return best.select(F.map_from_entries("label_key").alias("labels"), "label_key", "ts_ms", "value")


def vertical(blocks: Sequence[DataFrame]) -> DataFrame:
    """Replicas: the first block that has a series' time wins."""
    return _compact(blocks, F.min_by)


def horizontal(blocks: Sequence[DataFrame]) -> DataFrame:
    """Successive blocks: the last block that has a series' time wins."""
    return _compact(blocks, F.max_by)


def to_block(inputs: Sequence[DataFrame], path: str, mode: str = "vertical") -> dict:
    """Compact blocks, oldest first, into a block at path; its meta data.  The inputs stay; no samples raise."""
    if mode not in ("vertical", "horizontal"):
        raise ValueError("mode is vertical or horizontal")
    return write_block({"vertical": vertical, "horizontal": horizontal}[mode](inputs), path)
