"""What ingestion accepts: times that rise within a series, and series within a tenant's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a tenant that are ranked apart first.
SALTS = 32


class CardinalityLimitExceeded(Exception):
    """A tenant has as many series as its budget allows."""


#: Samples above which a series is cut, and arrival numbers of one stretch of it, which one task looks at.
STRETCH = 1 << 16


def monotonic(samples: DataFrame, order: str = "seq", stretch: int = STRETCH, counting: str | None = None) -> DataFrame:
    """Samples with ``accepted``: later than all samples of the series that arrived before.

    The highest earlier time equals the highest accepted one, so a running maximum is
    enough.  A series of more than ``stretch`` samples is cut into stretches of arrival numbers: their maxima
    run over one row each, and samples are compared inside a stretch, so a series of any length is dealt to
    many tasks.  Other series stay whole, so that numbers with wide gaps, such as times, make no stretches of one sample.
    ``counting`` is a boolean column: samples without it are never accepted and hold back no others.
    Of one arrival number, samples arrive by time and then by value, so the result hangs on the rows alone and not on
    how they were dealt to tasks; samples without a number arrive last.
    """
    keys = ["label_key", "_stretch"]
    time = F.col("ts_ms") if counting is None else F.when(F.col(counting), F.col("ts_ms"))
    at = F.coalesce(F.floor(F.col(order) / stretch), F.lit(1 << 62))
    # at most one series for every stretch of samples
    long = F.broadcast(samples.groupBy("label_key").agg(F.count("*").alias("_n")).where(F.col("_n") > stretch).select("label_key", F.lit(True).alias("_long")))
    rows = samples.join(long, "label_key", "left").withColumn("_stretch", F.when(F.col("_long"), at).otherwise(0)).drop("_long")
    cut = samples.join(long, "label_key").select("label_key", at.alias("_stretch"), time.alias("_t"))
    earlier = Window.partitionBy("label_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys).agg(F.max("_t").alias("_own")).select(*keys, F.max("_own").over(earlier).alias("_before"))
    # the window's order serves the join too
    arrival = [F.asc_nulls_last(order), *(c for c in ("ts_ms", "value") if c in samples.columns and c != order)]
    inside = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_inside", F.max(time).over(inside)).join(tops, keys, "left")
    top = F.greatest("_inside", "_before")
    accepted = (time >= 0) & (top.isNull() | (time > top))
    return joined.withColumn("accepted", accepted if counting is None else F.when(F.col(counting), accepted).otherwise(False)).drop("_stretch", "_inside", "_before")


def active_series(samples: DataFrame) -> DataFrame:
    """Distinct series of each tenant, exactly."""
    return samples.groupBy("tenant").agg(F.count_distinct("label_key").alias("active_series"))


def tenant_gate(samples: DataFrame, budgets: DataFrame | None, default: int | None, order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """Samples with ``admitted``: their series is among the tenant's first ones, as many as its budget, in arrival order.

    A ``default`` of None sets tenants without a budget of their own no limit.
    ``known(tenant, label_key)`` are series admitted before; they stay admitted
    and use up the budget.  Ranks run over distinct series, one row each: first in
    ``SALTS`` parts of a tenant, then over those within the budget there, so a task
    ranks that many times the budget at most.
    """
    if default is not None and default < 1:
        raise ValueError("a budget is 1 or more")
    if default is None and budgets is None:
        # as below, a sample of no tenant or series is not admitted
        return samples.withColumn("admitted", F.col("tenant").isNotNull() & F.col("label_key").isNotNull())
    first = samples.groupBy("tenant", "label_key").agg(F.min(order).alias("_first"))
    if known is not None:
        old = known.select("tenant", "label_key", F.lit(True).alias("_old"))
        used = known.groupBy("tenant").agg(F.count("*").alias("_used"))
        first = first.join(old, ["tenant", "label_key"], "left").join(used, "tenant", "left")
    else:
        first = first.withColumn("_old", F.lit(None).cast("boolean")).withColumn("_used", F.lit(0).cast("long"))
    if budgets is not None:
        first = first.join(budgets.select("tenant", "max_active_series"), "tenant", "left")
    else:
        first = first.withColumn("max_active_series", F.lit(None).cast("int"))
    limit = F.coalesce(F.col("max_active_series").cast("long"), F.lit(default).cast("long")) - F.coalesce("_used", F.lit(0))
    new = first.where("_old is null").select("tenant", "label_key", "_first", limit.alias("_limit"), F.pmod(F.xxhash64("label_key"), F.lit(SALTS)).alias("_salt"))
    unlimited = new.where("_limit is null").select("tenant", "label_key")
    new = new.where("_limit is not null")
    for by in (["tenant", "_salt"], ["tenant"]):
        new = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).where("_rank <= _limit").drop("_rank")
    admitted = new.select("tenant", "label_key")
    if default is None:
        admitted = admitted.unionByName(unlimited)
    if known is not None:
        admitted = admitted.unionByName(known.select("tenant", "label_key").distinct())
    found = admitted.withColumn("admitted", F.lit(True))
    return samples.join(found, ["tenant", "label_key"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def abort_after_rejection(gated: DataFrame, body: str = "body", order: str = "seq") -> DataFrame:
    """Admitted samples of each body up to its first rejected one, as an ingest that fails there leaves them."""
    w = Window.partitionBy(body).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gated.withColumn("_ok", F.min("admitted").over(w)).where("_ok").drop("_ok")
