"""Registered queries over stored tables: blocks, nodes, logs, text files and streams, and their SQL for DuckDB.

Each writes whole tables to a folder of its own in the shared storage and reads
back what the operators find there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.functions.labels import canonical, fingerprint
from seriesforge.operators import compaction, index, ingestion, selectors
from seriesforge.operators.matchers import eq, neq, regex
from seriesforge.plans.catalog import _BLOCKS, _CANON, _EVENTS, _STEPS, _TENANTS, END, START, _events, _keyed_labels, _label, _shown, _tenants, _two_blocks, query
from seriesforge.plans.node import Node
from seriesforge.sources import blocks, tables
from seriesforge.sources.exposition import parse_lines, read_text
from seriesforge.sources.log import Log
from seriesforge.streaming.ingest import Ingest

#: 2024-01-16, in ms: what is later arrives second.
CUT = 1705363200000
_TEXT = "'__name__=events_value;event_type=' || event_type || ';' || CASE WHEN region IS NULL THEN '' ELSE 'region=' || region || ';' END || 'user_id=' || user_id || ';'"


def _fnv(text: str) -> str:
    """SQL of the signed FNV-1a fingerprint of an ASCII text."""
    h = (
        f"list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::BIGINT, 1))::HUGEINT), "
        "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    )
    return f"(CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN {h} - 18446744073709551616::HUGEINT ELSE {h} END)::BIGINT"


_IDS = f"{_EVENTS}, n AS (SELECT DISTINCT event_type, user_id, region, {_CANON} AS canonical, {_TEXT} AS t FROM s), ids AS (SELECT event_type, user_id, region, canonical, {_fnv('t')} AS series_id FROM n)"


def _folder(spark: SparkSession, name: str) -> str:
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("labels", "ts_ms", "value")


def _block(spark, sf_dir) -> str:
    path = _folder(spark, "block")
    blocks.write_block(_plain(_events(spark, sf_dir)), path)
    return path


@query(f"{_IDS} SELECT canonical, series_id FROM ids")
def fingerprints(spark, sf_dir):
    """FNV-1a fingerprints of all series."""
    return index.series_table(_events(spark, sf_dir)).select("canonical", "series_id")


@query(f"{_IDS} SELECT i.series_id, s.event_type, s.user_id, ts_ms, value, dense_rank() OVER (ORDER BY i.series_id) AS series_pos, row_number() OVER (PARTITION BY i.series_id ORDER BY ts_ms) AS pos FROM s JOIN ids i ON s.event_type = i.event_type AND s.user_id = i.user_id WHERE s.event_type <> 'click' AND ts_ms BETWEEN {START} AND {END}")
def range_ordered(spark, sf_dir):
    """The range selector's order: series by signed id, samples by time; places are read off the sorted output."""
    out = selectors.range_select(_events(spark, sf_dir), [neq("event_type", "click")], START, END)
    # sorted partitions are numbered in order, so ids rise as the rows stand; written, since another run may cut partitions elsewhere
    path = _folder(spark, "ordered")
    out.select("series_id", _label("event_type"), _label("user_id"), "ts_ms", "value", F.monotonically_increasing_id().alias("row")).write.parquet(path)
    stood = spark.read.parquet(path)
    # a series counts in the partition where it begins: only the partitions' counts, one row each, meet in one task
    firsts = stood.groupBy("series_id").agg(F.min("row").alias("first")).withColumn("part", F.shiftright("first", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = firsts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    there = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    numbered = firsts.withColumn("there", there).join(F.broadcast(before), "part").select("series_id", (F.col("before") + F.col("there")).cast("long").alias("series_pos"))
    pos = F.row_number().over(Window.partitionBy("series_id").orderBy("row")).cast("long").alias("pos")
    return stood.select("series_id", "event_type", "user_id", "ts_ms", "value", pos).join(numbered, "series_id").select("series_id", "event_type", "user_id", "ts_ms", "value", "series_pos", "pos")


@query(f"{_EVENTS} SELECT 'block-' || lpad(CAST(min(ts_ms) AS VARCHAR), 13, '0') || '-' || lpad(CAST(max(ts_ms) AS VARCHAR), 13, '0') AS id, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT (event_type, user_id)) AS series_count, count(*) AS sample_count FROM s")
def block_read_meta(spark, sf_dir):
    """The meta data of a written block, read back with a fixed schema."""
    return blocks.read_meta(spark, _block(spark, sf_dir))


@query(f"{_EVENTS} SELECT event_type, user_id, region, ts_ms, value FROM s WHERE ts_ms BETWEEN {START} AND {START + 86400000}")
def block_scan(spark, sf_dir):
    """All series of a block within a time range: partitions and series without a chunk there are not read."""
    return _shown(blocks.read_block(spark, _block(spark, sf_dir), (), START, START + 86400000), "event_type", "user_id", "region")


@query(f"{_EVENTS} SELECT event_type, user_id, region, ts_ms, value FROM s WHERE user_id = '42' AND ts_ms BETWEEN {START} AND {END}")
def block_select(spark, sf_dir):
    """Matched series of a block: their ids become a filter of the scan."""
    return _shown(blocks.read_block(spark, _block(spark, sf_dir), [eq("user_id", "42")], START, END), "event_type", "user_id", "region")


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms - ts_ms % 7200000 AS block_start, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS sample_count FROM s GROUP BY ALL")
def block_chunks(spark, sf_dir):
    """The chunks of a written block, checked against its samples."""
    path = _block(spark, sf_dir)
    blocks.check_chunks(spark, path)
    named = blocks.read_chunks(spark, path).join(blocks.read_series(spark, path).select("series_id", "label_key"), "series_id").drop("series_id")
    return _keyed_labels(named, "event_type", "user_id")


@query(f"{_EVENTS} SELECT {_CANON} AS canonical, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS sample_count FROM s WHERE event_type = 'click' AND user_id = '7' GROUP BY event_type, user_id, region, ts_ms - ts_ms % 7200000")
def block_entry(spark, sf_dir):
    """Labels and chunks of one series of a block, looked up by its id."""
    wanted = spark.range(1).select(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("__name__", "events_value"), ("event_type", "click"), ("user_id", "7"))]).alias("k"))
    found = wanted.select(fingerprint(F.col("k")).alias("id")).first()["id"]
    return blocks.entry(spark, _block(spark, sf_dir), found).drop("series_id")


def _compacted(order: str) -> str:
    return f"{_BLOCKS} SELECT event_type, user_id, ts_ms, value FROM b QUALIFY row_number() OVER (PARTITION BY event_type, user_id, ts_ms ORDER BY ord {order}) = 1"


def _compact(spark, sf_dir, mode: str) -> tuple[str, dict]:
    inputs = []
    for b in _two_blocks(spark, sf_dir):
        inputs.append(_folder(spark, "block"))
        blocks.write_block(_plain(b), inputs[-1])
    path = _folder(spark, "compacted")
    return path, compaction.to_block([blocks.read_block(spark, p) for p in inputs], path, mode)


@query(_compacted("ASC"))
def compact_to_block(spark, sf_dir):
    """Two stored blocks compacted into a third, whose first input wins, and read back."""
    return _shown(blocks.read_block(spark, _compact(spark, sf_dir, "vertical")[0]), "event_type", "user_id")


@query(_compacted("DESC"))
def compact_to_block_horizontal(spark, sf_dir):
    """The same, but the last input wins."""
    return _shown(blocks.read_block(spark, _compact(spark, sf_dir, "horizontal")[0]), "event_type", "user_id")


@query(f"WITH c AS ({_compacted('ASC')}) SELECT min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT (event_type, user_id)) AS series_count, count(*) AS sample_count FROM c")
def compact_meta(spark, sf_dir):
    """The meta data of a compacted block."""
    return blocks.read_meta(spark, _compact(spark, sf_dir, "vertical")[0]).drop("id")


def _arrivals(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("ts_ms").alias("seq"), "labels", "ts_ms", "value")


def _node(spark, sf_dir) -> Node:
    """All events appended and flushed through two nodes, one after the other, on one path; then opened by a third."""
    path = _folder(spark, "node")
    with Node(spark, path) as node:
        node.append(_arrivals(spark, sf_dir).where(F.col("ts_ms") < CUT))
        node.flush()
    with Node(spark, path) as node:
        node.append(_arrivals(spark, sf_dir).where(F.col("ts_ms") >= CUT))
        node.flush()
    return Node(spark, path)


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms, value, CASE WHEN ts_ms < {CUT} THEN 0 ELSE 1 END AS block_ord FROM s")
def node_reopen(spark, sf_dir):
    """A node opened again goes on where the last one stopped: nothing is lost or written over."""
    return _node(spark, sf_dir).range([], 0, 1 << 60).select(_label("event_type"), _label("user_id"), "ts_ms", "value", "block_ord")


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms, value FROM s WHERE regexp_full_match(event_type, 'c.*') AND ts_ms BETWEEN {START} AND {END}")
def node_range(spark, sf_dir):
    return _shown(_node(spark, sf_dir).range([regex("event_type", "c.*")], START, END), "event_type", "user_id")


@query(f"{_EVENTS} SELECT event_type, user_id, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM s WHERE ts_ms <= {END} GROUP BY event_type, user_id")
def node_instant(spark, sf_dir):
    return _keyed_labels(_node(spark, sf_dir).instant([], END), "event_type", "user_id")


@query(_EVENTS + f", r AS (SELECT * FROM s WHERE ts_ms BETWEEN {START} AND {END})" + _STEPS.format(key="event_type, user_id", tie="event_id", source="r") + "SELECT event_type, round(sum(rate), 8) AS rate FROM rates GROUP BY event_type")
def node_rate_sum_by(spark, sf_dir):
    return _node(spark, sf_dir).rate_sum_by([], "event_type", START, END).withColumn("rate", F.round("rate", 8))


@query(f"{_EVENTS} SELECT event_type, round(sum(value) / count(*), 8) AS avg_value FROM s WHERE ts_ms BETWEEN {START} AND {END} GROUP BY event_type")
def node_avg_by(spark, sf_dir):
    return _node(spark, sf_dir).avg_by([], "event_type", START, END).withColumn("avg_value", F.round("avg_value", 8))


def _head(spark, sf_dir) -> Node:
    node = Node(spark, _folder(spark, "node"))
    node.append(_arrivals(spark, sf_dir))
    return node


_ONE = {"__name__": "events_value", "event_type": "click", "user_id": "7"}


@query(f"{_EVENTS} SELECT ts_ms, value FROM s WHERE event_type = 'click' AND user_id = '7' AND ts_ms BETWEEN {START} AND {END}")
def head_read(spark, sf_dir):
    """A series of the head within a time range, before any flush."""
    return _head(spark, sf_dir).read(START, END, _ONE).select("ts_ms", "value")


@query(f"{_EVENTS} SELECT ts_ms, value FROM s WHERE event_type = 'click' AND user_id = '7'")
def head_read_all(spark, sf_dir):
    """All samples of a series of the head, by its id."""
    node = _head(spark, sf_dir)
    return node.read_id(node.get_or_create(_ONE)).select("ts_ms", "value")


@query(f"{_EVENTS} SELECT 'default' AS tenant, {_CANON} AS canonical, max(ts_ms) AS latest FROM s GROUP BY event_type, user_id, region")
def head_series(spark, sf_dir):
    """The series that the head knows and their latest times, after the node was opened again."""
    node = Node(spark, _head(spark, sf_dir).path)
    return node.known_series().join(node.latest(), "label_key").select("tenant", canonical(F.col("label_key")).alias("canonical"), F.col("ts_ms").alias("latest"))


@query(f"{_TENANTS}, f AS (SELECT event_type, user_id, min(event_id) AS first FROM t GROUP BY ALL), g AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM f), stop AS (SELECT min(event_id) AS first_bad FROM t JOIN g USING (event_type, user_id) WHERE r > 40), kept AS (SELECT event_type, user_id, 1700000000000 + event_id AS ts_ms, value FROM t WHERE event_id < coalesce((SELECT first_bad FROM stop), 1152921504606846976)) SELECT * FROM kept")
def ingest_stops_at_failure(spark, sf_dir):
    """A body that fails half way keeps the samples before the failing one."""
    node = Node(spark, _folder(spark, "node"), budget=40)
    e = _tenants(spark, sf_dir).select("seq", "labels", (F.col("seq") + 1700000000000).alias("ts_ms"), "value")
    try:
        node.append(e, "one")
    except ingestion.CardinalityLimitExceeded:
        pass
    return _shown(node.head(), "event_type", "user_id")


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms, value FROM s")
def log_replay(spark, sf_dir):
    """A log of numbered parts, read by a second log on its path; an unfinished part does not count."""
    path = _folder(spark, "log")
    rows = _shown(_events(spark, sf_dir), "event_type", "user_id")
    first = Log(spark, path, "event_type string, user_id string, ts_ms long, value double")
    first.write(first.next(), rows.where(F.col("ts_ms") < CUT))
    again = Log(spark, path, first.schema)
    again.write(again.next(), rows.where(F.col("ts_ms") >= CUT))
    rows.limit(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/part-{2:012d}")
    return Log(spark, path, first.schema).read()


def _lines(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    line = F.concat(F.lit('events_value{event_type="'), "event_type", F.lit('",user_id="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("ts_ms").cast("string"), F.lit(" "), F.col("value").cast("string"))
    return e.select(F.col("ts_ms").alias("seq"), F.lit("t").alias("tenant"), line.alias("line"))


@query(f"{_EVENTS} SELECT 'events_value' AS name, event_type, user_id, ts_ms, value FROM s")
def text_source(spark, sf_dir):
    """Samples from text files, with blank and comment lines between them."""
    path = _folder(spark, "text")
    _lines(spark, sf_dir).select(F.explode(F.array(F.lit("# comment"), F.lit("  "), F.concat(F.lit("\t "), "line", F.lit(" ")))).alias("value")).write.text(path)
    return _shown(read_text(spark, path).withColumn("name", F.element_at("labels", "__name__")), "event_type", "user_id").withColumn("name", F.lit("events_value"))


#: Lines and their errors; null where a line is good.
LINES = [
    ('m{a="1"} 1 2', None), ("m 1 2", None), ('m{a="1",} 1 2', None), ("m{} 1 2", None), ("m 1 0x1p3", None), ("m 1 NaN", None), ('m{a="x=y"} 1 2', None), ('m{a="1",a="2"} 1 2', None),
    ('{a="b"} 1 2', "empty metric"), ('m{a="1,2"} 1 2', "bad label"), ("m{a=1} 1 2", "bad label"), ('m{="x"} 1 2', "bad label"), ('m{a="} 1 2', "bad label"), ('m{a="1" 1 2', "unclosed labels"),
    ("m 1", "missing field"), ("m", "missing field"), ("m x 1", "bad time"), ("m 1.5 1", "bad time"), ("m 1 x", "bad value"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{line}', {'NULL' if e is None else repr(e)})" for line, e in LINES) + ") v(line, error)")
def parse_errors(spark, sf_dir):
    """Good and bad lines, and what is wrong with each."""
    return parse_lines(spark.createDataFrame([(line,) for line, _ in LINES], "line string")).select("line", "error")


@query(f"{_IDS} SELECT 'event_type' AS label, event_type AS label_value, count(*) AS n, min(series_id) AS first, max(series_id) AS last FROM ids GROUP BY event_type")
def posting_lists(spark, sf_dir):
    """Posting lists as rising arrays of ids."""
    lists = index.posting_arrays(index.series_table(_events(spark, sf_dir))).where("label = 'event_type'")
    return lists.select("label", "label_value", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))


@query(f"{_EVENTS} SELECT 't' AS tenant, event_type, user_id, ts_ms, value FROM s")
def streaming_restart(spark, sf_dir):
    """All events as text lines through a stream that is stopped and started again from its checkpoint."""
    path = _folder(spark, "stream")
    ingest = Ingest(spark, f"{path}/store")
    for part in (F.col("seq") < CUT, F.col("seq") >= CUT):
        _lines(spark, sf_dir).where(part).write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema("seq long, tenant string, line string").json(f"{path}/in")
        ingest.start(stream, f"{path}/checkpoint").awaitTermination()
    return ingest.samples().select("tenant", _label("event_type"), _label("user_id"), "ts_ms", "value")


@query(f"{_EVENTS} SELECT 't' AS tenant, count(DISTINCT (event_type, user_id)) AS series, CAST(sum(m) AS BIGINT) AS latest_sum FROM (SELECT event_type, user_id, max(ts_ms) AS m FROM s GROUP BY ALL)")
def streaming_state(spark, sf_dir):
    """What a stream keeps for its next batch: admitted series and latest times."""
    path = _folder(spark, "stream")
    ingest = Ingest(spark, f"{path}/store")
    _lines(spark, sf_dir).write.json(f"{path}/in")
    ingest.start(spark.readStream.schema("seq long, tenant string, line string").json(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    latest = ingest.last_times().agg(F.sum("last_ts").alias("latest_sum"))
    return ingest.series().groupBy("tenant").agg(F.count("*").alias("series")).crossJoin(latest)


@query("SELECT 'l_extendedprice' AS source, count(*) AS n FROM lineitem")
def validated_labels(spark, sf_dir):
    """All samples of valid labels and times pass the check that fails on others."""
    return index.check_labels(tables.lineitem_samples(spark, sf_dir)).agg(F.count("*").alias("n")).select(F.lit("l_extendedprice").alias("source"), "n")
