"""Streaming ingestion of text lines: parse, gate by tenant, keep rising times, append to a samples table.

Each micro-batch runs the batch operators against the tables that earlier
batches left (admitted series, last times), so a restart from the checkpoint goes on
where it stopped.  Every batch writes folders named by its number; a batch that
runs again after a failure overwrites its own and reads those of smaller numbers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from seriesforge.functions.labels import label_key
from seriesforge.operators.ingestion import monotonic, tenant_gate
from seriesforge.sources.exposition import parse_lines
from seriesforge.sources.log import Log

_KEY = "array<struct<key:string,value:string>>"


class Ingest:
    """The tables of one ingestion under ``path``: samples, rejected lines, and the state (admitted series, latest times).

    ``budget`` bounds the series of each tenant that ``budgets`` does not name; None sets no bound.
    """

    def __init__(self, spark: SparkSession, path: str, budget: int | None = None, budgets: DataFrame | None = None, merge_after: int = 16):
        self.spark, self.path, self.budget, self.budgets, self.merge_after = spark, path.rstrip("/"), budget, budgets, merge_after
        self._logs = {
            name: Log(spark, f"{self.path}/{name}", schema)
            for name, schema in (
                ("samples", "tenant string, labels map<string,string>, ts_ms long, value double"), ("series", f"tenant string, label_key {_KEY}"),
                ("last", f"label_key {_KEY}, last_ts long"), ("rejected", "tenant string, line string, error string"),
                ("parsed", f"seq long, tenant string, line string, label_key {_KEY}, ts_ms long, value double, error string"),
                ("checked", f"tenant string, line string, label_key {_KEY}, ts_ms long, value double, admitted boolean, accepted boolean"),
            )
        }

    def samples(self, before: int | None = None) -> DataFrame:
        return self._logs["samples"].read(before)

    def series(self, before: int | None = None) -> DataFrame:
        return self._logs["series"].read(before)

    def rejected(self, before: int | None = None) -> DataFrame:
        return self._logs["rejected"].read(before)

    def last_times(self, before: int | None = None) -> DataFrame:
        return self._logs["last"].read(before).groupBy("label_key").agg(F.max("last_ts").alias("last_ts"))

    def ingest_batch(self, lines: DataFrame, batch: int) -> None:
        """One batch of ``lines(seq, tenant, line)``; bad lines go to the rejected table.

        The batch is parsed and checked once; the state before it is read from its last
        full form on, and written as a full one every ``merge_after`` batches.
        """
        parsed, checked = self._logs["parsed"], self._logs["checked"]
        old, before = self.series(batch), self.last_times(batch)
        try:
            # in files, as rows of lines and label sets fill the memory of executors
            parsed.write(batch, parse_lines(lines).select(F.col("seq").cast("long").alias("seq"), "tenant", "line", label_key(F.col("labels")).alias("label_key"), "ts_ms", "value", "error"))
            rows = parsed.read(batch + 1, batch)
            gated = tenant_gate(rows.where("error is null").drop("error"), self.budgets, self.budget, known=old).withColumn("line", F.when(~F.col("admitted"), F.col("line")))
            earlier = before.select("label_key", F.col("last_ts").alias("ts_ms"), F.lit(-(1 << 62)).alias("seq"), F.lit(True).alias("admitted"))
            found = monotonic(gated.unionByName(earlier, allowMissingColumns=True), counting="admitted").where("tenant is not null")
            checked.write(batch, found.select("tenant", "line", "label_key", "ts_ms", "value", "admitted", "accepted"))
            every = checked.read(batch + 1, batch)
            accepted = every.where("accepted")
            self._logs["samples"].write(batch, accepted.select("tenant", F.map_from_entries("label_key").alias("labels"), "ts_ms", "value"))
            new = every.where("admitted").select("tenant", "label_key").distinct().join(old, ["tenant", "label_key"], "left_anti")
            times = accepted.groupBy("label_key").agg(F.max("ts_ms").alias("last_ts"))
            full = self._logs["series"].deltas(batch) >= self.merge_after
            self._logs["series"].write(batch, old.unionByName(new) if full else new, full)
            self._logs["last"].write(batch, before.unionByName(times).groupBy("label_key").agg(F.max("last_ts").alias("last_ts")) if full else times, full)
            refused = every.where("not admitted").select("tenant", "line", F.lit("series budget").alias("error"))
            self._logs["rejected"].write(batch, rows.where("error is not null").select("tenant", "line", "error").unionByName(refused))
        finally:
            checked.drop(batch)
            parsed.drop(batch)

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Ingest a streaming ``lines(seq, tenant, line)``."""
        return lines.writeStream.foreachBatch(lambda df, i: self.ingest_batch(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_rates(samples: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by tumbling event-time window on a stream (an extension): samples later than ``late`` are dropped."""
    timed = samples.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
