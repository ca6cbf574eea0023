"""Connected components by alternating large-star and small-star joins; no links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seriesforge.llm._spark import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` to ``(node long, root long)``, root the smallest node reachable.

    Loops and repeated edges are harmless; nulls are ignored; no edges give no
    rows.  Each round is written to the shared folder.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e, seen = _kept(scratch, "cc0", e.distinct())
    for i in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(f"large{i}", large.distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e, now = _kept(scratch, f"cc{i}", small)
        scratch.drop(f"large{i}", f"cc{i - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.unionByName(e.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _kept(scratch: Scratch, name: str, e: DataFrame) -> tuple[DataFrame, dict]:
    """Write the edges; with them their digest, taken while writing."""
    seen = Observation()
    x = F.xxhash64("u", "v")
    e = scratch.keep(name, e.observe(seen, F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.sum(x.cast("decimal(38,0)")).alias("s")))
    return e, seen.get
