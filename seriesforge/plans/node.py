"""A node: ingestion into a head, flushing to blocks, and queries over the blocks.

Under ``path`` lie the head and the state of ingestion (tenants' series, latest
times), each as a log of numbered parts, and the blocks, as partitions of one
table of samples and one of series.  An append counts once its part of the head is whole,
a block once its meta data are; whatever was left unfinished is written again.  So a node
opened on an existing path goes on where the last one stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import fingerprint, label_key, valid_labels
from seriesforge.operators import compaction, selectors
from seriesforge.operators.ingestion import CardinalityLimitExceeded, monotonic, tenant_gate
from seriesforge.operators.matchers import Matcher
from seriesforge.sources import blocks
from seriesforge.sources.exposition import parse_body
from seriesforge.sources.log import Log

_KEY = "array<struct<key:string,value:string>>"
_HEAD = f"tenant string, seq long, labels map<string,string>, label_key {_KEY}, ts_ms long, value double"
_CHECKED = f"tenant string, seq long, label_key {_KEY}, ts_ms long, value double, admitted boolean, accepted boolean"
#: Parts of a state after which it is written as one.
MERGE_AFTER = 16


class Node:
    """Queries see flushed blocks only, and a flush writes what no flush before has.

    ``budget`` bounds the series of each tenant that ``budgets`` does not name; None sets no bound.
    """

    def __init__(self, spark: SparkSession, path: str, budget: int | None = None, budgets: DataFrame | None = None):
        self.spark, self.path, self.budget, self.budgets = spark, path.rstrip("/"), budget, budgets
        self._head = Log(spark, f"{self.path}/head", _HEAD)
        self._series = Log(spark, f"{self.path}/series", f"tenant string, label_key {_KEY}")
        self._times = Log(spark, f"{self.path}/times", f"label_key {_KEY}, ts_ms long")
        self._checked = Log(spark, f"{self.path}/checked", _CHECKED)
        self._closed = False
        self._next = self._head.next()
        self.metas = self._committed()

    def _committed(self) -> list[dict]:
        p, fs = Log(self.spark, f"{self.path}/blocks/meta", "")._fs()
        numbers = sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(p)) if fs.exists(p) else []
        whole = [n for n in numbers if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"block={n}/_SUCCESS"))]
        rows = {r["block"]: r["value"] for r in self.spark.read.text(f"{self.path}/blocks/meta").collect()} if whole else {}
        return [json.loads(rows[n]) for n in whole]

    def _open(self) -> None:
        if self._closed:
            raise ValueError("the node is closed")

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> Node:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def head(self, first: int = 0) -> DataFrame:
        """Samples appended since the append of number ``first``."""
        return self._head.read(self._next, first)

    def known_series(self) -> DataFrame:
        """tenant, label_key of all series let in."""
        return self._series.read(self._next)

    def latest(self) -> DataFrame:
        """label_key, ts_ms: the latest time of each series of the head."""
        return self._times.read(self._next).groupBy("label_key").agg(F.max("ts_ms").alias("ts_ms"))

    def read(self, start: int, end: int, labels: dict[str, str]) -> DataFrame:
        """The head's samples of one series by time; none for an unknown one."""
        wanted = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in labels.items()]))
        return self.head().where((F.col("label_key") == label_key(wanted)) & F.col("ts_ms").between(start, end)).orderBy("ts_ms")

    def read_all(self, labels: dict[str, str]) -> DataFrame:
        return self.read(-(1 << 63), (1 << 63) - 1, labels)

    def read_id(self, series_id: int, start: int = -(1 << 63), end: int = (1 << 63) - 1) -> DataFrame:
        """The head's samples of a series by its id; none for an unknown one.  Fingerprints are computed once a series, not once a sample."""
        # collected, as Spark would infer the condition on fingerprints for the samples too
        found = self.known_series().select("label_key").where(fingerprint(F.col("label_key")) == series_id).distinct().collect()
        wanted, head = self.spark.createDataFrame(found, f"label_key {_KEY}"), self.head()
        return head.where(F.col("ts_ms").between(start, end)).join(F.broadcast(wanted), "label_key", "left_semi").select(*head.columns).orderBy("ts_ms")

    def series_count(self) -> int:
        return self.known_series().select("label_key").distinct().count()

    def get_or_create(self, labels: dict[str, str], tenant: str = "default") -> int:
        """The id of a series, let in for the tenant if it is new."""
        self._open()
        one = self.spark.createDataFrame([(0, labels, None, None)], "seq long, labels map<string,string>, ts_ms long, value double")
        if not one.where(valid_labels(F.col("labels"))).count():
            raise ValueError("invalid labels")
        gated = self._gated(one, tenant)
        row = gated.select(fingerprint(F.col("label_key")).alias("id"), "admitted").first()
        if not row["admitted"]:
            raise CardinalityLimitExceeded(tenant)
        self._commit(gated.limit(0).drop("admitted"), gated.select("tenant", "label_key"))
        return row["id"]

    def append_by_id(self, samples: DataFrame, strict: bool = True) -> int:
        """Append ``samples(seq, series_id, ts_ms, value)`` to known series; an unknown id raises."""
        self._open()
        series = self.known_series().select(F.col("tenant").alias("_tenant"), "label_key", fingerprint(F.col("label_key")).alias("series_id"))
        rows = samples.join(series.dropDuplicates(["series_id"]), "series_id", "left").persist()
        try:
            if not rows.where("label_key is null").isEmpty():
                raise KeyError("an unknown series id")
            tenants = [r["_tenant"] for r in rows.select("_tenant").distinct().collect()]
            return sum(self.append(rows.where(F.col("_tenant") == t).withColumn("labels", F.map_from_entries("label_key")), t, strict) for t in tenants)
        finally:
            rows.unpersist()

    def _gated(self, samples: DataFrame, tenant: str) -> DataFrame:
        if not tenant.strip():
            raise ValueError("tenant is blank")
        rows = samples.select(F.lit(tenant).alias("tenant"), F.col("seq").cast("long").alias("seq"), "labels", label_key(F.col("labels")).alias("label_key"), "ts_ms", "value")
        return tenant_gate(rows, self.budgets, self.budget, known=self.known_series())

    def _commit(self, accepted: DataFrame, admitted: DataFrame) -> None:
        """Write the state of one append and then its samples, which make it count."""
        n = self._next
        new = admitted.distinct().join(self.known_series(), ["tenant", "label_key"], "left_anti")
        times = accepted.groupBy("label_key").agg(F.max("ts_ms").alias("ts_ms"))
        if self._series.deltas(n) >= MERGE_AFTER:
            self._series.write(n, self.known_series().unionByName(new), full=True)
            self._times.write(n, self.latest().unionByName(times).groupBy("label_key").agg(F.max("ts_ms").alias("ts_ms")), full=True)
        else:
            self._series.write(n, new)
            self._times.write(n, times)
        self._head.write(n, accepted.select("tenant", "seq", "labels", "label_key", "ts_ms", "value"))
        self._next = n + 1

    def append(self, samples: DataFrame, tenant: str = "default", strict: bool = True) -> int:
        """Append ``samples(seq, labels, ts_ms, value)``; how many were accepted.

        strict stops at the first sample, by seq, of a series beyond the budget or of
        a time that does not rise: those before it are kept and the error raises.  Else
        such samples are left out.  The cost follows the batch and the number of series, not the head.
        """
        self._open()
        gated = self._gated(samples, tenant)
        # the latest time of each series in the head arrives before all new samples
        before = self.latest().withColumn("seq", F.lit(-(1 << 62))).withColumn("admitted", F.lit(True))
        # label sets are sorted and stored once, as keys; in files, as rows of label sets fill the memory of executors
        checked = monotonic(gated.drop("labels").unionByName(before, allowMissingColumns=True), counting="admitted").where("tenant is not null")
        n = self._next
        self._checked.write(n, checked.select("tenant", "seq", "label_key", "ts_ms", "value", "admitted", "accepted"))
        checked = self._checked.read(n + 1, n)
        try:
            stop = None
            if strict:
                stop = checked.where("not accepted").agg(F.min(F.struct("seq", "admitted")).alias("x")).first()["x"]
            kept = checked if stop is None else checked.where(F.col("seq") <= stop["seq"])
            accepted = kept.where("accepted").withColumn("labels", F.map_from_entries("label_key"))
            self._commit(accepted, kept.where("admitted").select("tenant", "label_key"))
            count = accepted.count()
        finally:
            self._checked.drop(n)
        if stop is not None:
            if stop["admitted"]:
                raise ValueError("a time does not rise within its series")
            raise CardinalityLimitExceeded(tenant)
        return count

    def ingest(self, body: str, tenant: str = "default", strict: bool = True) -> int:
        """Append a text body; a bad line fails all of it, other errors keep the lines before."""
        return self.append(parse_body(self.spark, body), tenant, strict)

    def flush(self) -> dict:
        """Write unflushed samples as a block that queries read."""
        self._open()
        n = len(self.metas)
        meta = blocks.write_block(self.head(self.metas[-1]["upto"] if n else 0), f"{self.path}/blocks", part=f"block={n}", more={"upto": self._next}, stored=True)
        self.metas.append(meta)
        return meta

    def compact(self, mode: str = "vertical") -> dict:
        """All blocks merged into one at ``path``/compacted; the blocks stay."""
        self._open()
        return compaction.to_block([self.samples().where(F.col("block_ord") == i) for i in range(len(self.metas))], f"{self.path}/compacted", mode)

    def samples(self, matchers: Iterable[Matcher] = (), start: int = 0, end: int = (1 << 63) - 1) -> DataFrame:
        """Samples of all blocks in one scan, with ``block_ord``; matched ids and the time range reach the files."""
        if not self.metas:
            raise ValueError("no blocks")
        out = blocks.read_block(self.spark, f"{self.path}/blocks", matchers, start, end, parts=len(self.metas))
        return out.withColumnRenamed("block", "block_ord")

    def range(self, matchers: Iterable[Matcher], start: int, end: int) -> DataFrame:
        matchers = list(matchers)
        return selectors.range_select(self.samples(matchers, start, end), matchers, start, end)

    def instant(self, matchers: Iterable[Matcher], ts: int) -> DataFrame:
        matchers = list(matchers)
        return selectors.instant_select(self.samples(matchers, 0, ts), matchers, ts)

    def rate_sum_by(self, matchers: Iterable[Matcher], label: str, start: int, end: int) -> DataFrame:
        matchers = list(matchers)
        return selectors.rate_sum_by(self.samples(matchers, start, end), matchers, label, start, end)

    def avg_by(self, matchers: Iterable[Matcher], label: str, start: int, end: int) -> DataFrame:
        matchers = list(matchers)
        return selectors.avg_by(self.samples(matchers, start, end), matchers, label, start, end)
