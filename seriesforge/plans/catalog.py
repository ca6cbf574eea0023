"""Registered queries over the test tables, and their SQL for DuckDB.

Series come from ``events`` (labels event_type, user_id, and region on even users
only), ``lineitem`` (returnflag, linestatus) and ``orders`` (orderstatus,
orderpriority).  Results have scalar columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import canonical, label_or_blank
from seriesforge.operators import compaction, index, ingestion, selectors
from seriesforge.operators.matchers import eq, neq, not_regex, regex
from seriesforge.sources import blocks, tables
from seriesforge.sources.demo import demo_samples
from seriesforge.sources.exposition import parse_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-05 and 2024-01-20, in ms.
START, END = 1704412800000, 1705708800000

_EVENTS = """
WITH s AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, user_id AS uid,
  CASE WHEN user_id % 2 = 0 THEN 'r' || CAST(user_id % 3 AS VARCHAR) END AS region, epoch_us(ts) // 1000 AS ts_ms, value FROM events)
"""
_STEPS = """, w AS (SELECT *, lag(value) OVER (PARTITION BY {key} ORDER BY ts_ms, {tie}) AS p FROM {source}),
rates AS (SELECT {key}, count(*) AS n, coalesce(sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END)
  / nullif((max(ts_ms) - min(ts_ms)) / 1000.0, 0), 0.0) AS rate FROM w GROUP BY {key} HAVING count(*) >= 2)
"""
_LINES = "WITH s AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _label(name: str):
    return F.try_element_at("labels", F.lit(name)).alias(name)


def _shown(df: DataFrame, *labels: str) -> DataFrame:
    return df.select(*[_label(x) for x in labels], "ts_ms", "value")


def _events(spark, sf_dir):
    return tables.events_samples(spark, sf_dir)


def _range(name: str, matchers, where: str, start: int = START, end: int = END):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(selectors.select(_events(spark, sf_dir), matchers, start, end), "event_type", "user_id", "region")

    run.__name__, run.__doc__ = name, f"Range selector: {', '.join(f'{m.label}{m.op}{m.value}' for m in matchers) or 'all series'}."
    query(f"{_EVENTS} SELECT event_type, user_id, region, ts_ms, value FROM s WHERE {where} AND ts_ms BETWEEN {start} AND {end}")(run)


_range("range_eq", [eq("event_type", "click")], "event_type = 'click'")
_range("range_neq", [neq("event_type", "click")], "event_type <> 'click'")
_range("range_regex", [regex("event_type", "c.*|.*w")], "regexp_full_match(event_type, 'c.*|.*w')")
_range("range_not_regex", [not_regex("user_id", "1.*")], "NOT regexp_full_match(user_id, '1.*')")
_range("range_regex_anchored", [regex("user_id", "1")], "user_id = '1'")
_range("range_multi_matcher", [eq("event_type", "click"), regex("user_id", "[0-9]{2}"), neq("user_id", "11")], "event_type = 'click' AND regexp_full_match(user_id, '[0-9]{2}') AND user_id <> '11'")
_range("range_all", [], "true")
_range("range_exact_bounds", [], "true", 1704067200000, 1704153600000)
_range("range_empty", [eq("event_type", "no such type")], "false")
_range("missing_label_eq", [eq("region", "")], "coalesce(region = '', false)")
_range("missing_label_eq_value", [eq("region", "r1")], "coalesce(region = 'r1', false)")
_range("missing_label_neq", [neq("region", "r1")], "coalesce(region <> 'r1', true)")
_range("missing_label_regex", [regex("region", ".*")], "coalesce(regexp_full_match(region, '.*'), false)")
_range("missing_label_not_regex", [not_regex("region", ".*")], "coalesce(NOT regexp_full_match(region, '.*'), true)")


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value FROM lineitem WHERE l_returnflag <> 'N' AND epoch_us(l_shipdate) // 1000 <= 800000000000")
def range_lineitem(spark, sf_dir):
    """Range selector over series with repeated times."""
    return _shown(selectors.select(tables.lineitem_samples(spark, sf_dir), [neq("returnflag", "N")], 0, 800000000000), "returnflag", "linestatus")


@query("SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value FROM orders WHERE regexp_full_match(o_orderpriority, '[12]-.*') AND o_orderstatus = 'O'")
def range_orders(spark, sf_dir):
    """Range selector over orders by two labels."""
    return _shown(selectors.select(tables.orders_samples(spark, sf_dir), [regex("orderpriority", "[12]-.*"), eq("orderstatus", "O")], 0, 1 << 60), "orderstatus", "orderpriority")


def _two_blocks(spark, sf_dir):
    """Two overlapping blocks of events; in the second, values of shared samples differ."""
    e = _events(spark, sf_dir).drop("block_ord")
    a = e.where("event_id % 3 <> 0").drop("event_id")
    b = e.where("event_id % 3 <> 1").select("labels", "ts_ms", (F.col("value") + 1000).alias("value"))
    return [a, b]


_BLOCKS = f"{_EVENTS}, b AS (SELECT event_type, user_id, ts_ms, value, 0 AS ord FROM s WHERE event_id % 3 <> 0 UNION ALL SELECT event_type, user_id, ts_ms, value + 1000, 1 FROM s WHERE event_id % 3 <> 1)"


@query(f"{_BLOCKS} SELECT event_type, user_id, ts_ms, value, ord AS block_ord FROM b WHERE event_type = 'click' AND ts_ms BETWEEN {START} AND {END}")
def range_multi_block_bag(spark, sf_dir):
    """Range over two blocks keeps duplicates."""
    df = selectors.select(selectors.union_blocks(_two_blocks(spark, sf_dir)), [eq("event_type", "click")], START, END)
    return df.select(_label("event_type"), _label("user_id"), "ts_ms", "value", "block_ord")


def _keyed_labels(df: DataFrame, *names: str) -> DataFrame:
    m = F.map_from_entries("label_key")
    return df.select(*[F.try_element_at(m, F.lit(n)).alias(n) for n in names], *[c for c in df.columns if c != "label_key"])


@query(f"{_EVENTS} SELECT event_type, user_id, max(ts_ms) AS ts_ms, arg_max(value, (ts_ms, event_id)) AS value FROM s WHERE event_type <> 'view' AND ts_ms <= {END} GROUP BY event_type, user_id")
def instant(spark, sf_dir):
    """Instant selector: each series' last sample, without a lookback limit."""
    return _keyed_labels(selectors.instant_select(_events(spark, sf_dir), [neq("event_type", "view")], END), "event_type", "user_id")


@query(f"{_BLOCKS} SELECT event_type, user_id, ts_ms, value FROM b WHERE ts_ms <= {END} QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts_ms DESC, ord DESC) = 1")
def instant_multi_block(spark, sf_dir):
    """Instant over two blocks: of equal times the later block's sample."""
    return _keyed_labels(selectors.instant_select(selectors.union_blocks(_two_blocks(spark, sf_dir)), [], END), "event_type", "user_id")


@query(_EVENTS + _STEPS.format(key="event_type, user_id", tie="event_id", source="s") + "SELECT event_type, user_id, n, round(rate, 9) AS rate FROM rates")
def counter_rate_per_series(spark, sf_dir):
    """Counter rate of each series."""
    df = selectors.counter_rates(tables.keyed(_events(spark, sf_dir)))
    return _keyed_labels(df.withColumn("rate", F.round("rate", 9)), "event_type", "user_id")


@query(_EVENTS + f", r AS (SELECT * FROM s WHERE ts_ms BETWEEN {START} AND {END})" + _STEPS.format(key="event_type, user_id", tie="event_id", source="r") + "SELECT event_type, round(sum(rate), 8) AS rate FROM rates GROUP BY event_type")
def rate_sum_by(spark, sf_dir):
    """Counter rates summed by event type."""
    return selectors.rate_sum_by(_events(spark, sf_dir), [], "event_type", START, END).withColumn("rate", F.round("rate", 8))


@query(_EVENTS + f", r AS (SELECT *, coalesce(region, '') AS g FROM s WHERE ts_ms BETWEEN {START} AND {END} AND event_type = 'click')" + _STEPS.format(key="g, event_type, user_id", tie="event_id", source="r") + "SELECT g AS region, round(sum(rate), 8) AS rate FROM rates GROUP BY g")
def rate_sum_by_missing_group(spark, sf_dir):
    """Counter rates by a label that some series lack: they form the blank group."""
    return selectors.rate_sum_by(_events(spark, sf_dir), [eq("event_type", "click")], "region", START, END).withColumn("rate", F.round("rate", 8))


_NARROW = 1704240000000


@query(_EVENTS + f", r AS (SELECT * FROM s WHERE ts_ms BETWEEN {_NARROW} AND {_NARROW + 14400000})" + _STEPS.format(key="event_type, user_id", tie="event_id", source="r") + "SELECT event_type, round(sum(rate), 8) AS rate FROM rates GROUP BY event_type")
def rate_sum_by_sparse(spark, sf_dir):
    """Rates over a narrow range: series of one sample are left out, and groups of only such series too."""
    return selectors.rate_sum_by(_events(spark, sf_dir), [], "event_type", _NARROW, _NARROW + 14400000).withColumn("rate", F.round("rate", 8))


@query(f"{_EVENTS} SELECT event_type, round(sum(value) / count(*), 8) AS avg_value FROM s WHERE ts_ms BETWEEN {START} AND {END} GROUP BY event_type")
def avg_by(spark, sf_dir):
    """Mean of all samples by event type."""
    return selectors.avg_by(_events(spark, sf_dir), [], "event_type", START, END).withColumn("avg_value", F.round("avg_value", 8))


@query(f"{_EVENTS} SELECT coalesce(region, '') AS region, round(sum(value) / count(*), 8) AS avg_value FROM s WHERE ts_ms BETWEEN {START} AND {END} GROUP BY ALL")
def avg_by_missing_group(spark, sf_dir):
    return selectors.avg_by(_events(spark, sf_dir), [], "region", START, END).withColumn("avg_value", F.round("avg_value", 8))


@query(f"{_LINES} SELECT returnflag, round(sum(value) / count(*), 8) AS avg_value FROM s GROUP BY returnflag")
def avg_by_lineitem(spark, sf_dir):
    return selectors.avg_by(tables.lineitem_samples(spark, sf_dir), [], "returnflag", 0, 1 << 60).withColumn("avg_value", F.round("avg_value", 8))


def _series(spark, sf_dir):
    return index.series_table(_events(spark, sf_dir))


_CANON = """'{__name__="events_value",event_type="' || event_type || '",' || CASE WHEN region IS NULL THEN '' ELSE 'region="' || region || '",' END || 'user_id="' || user_id || '"}'"""


@query(f"{_EVENTS}, d AS (SELECT DISTINCT event_type, user_id, region, {_CANON} AS canonical FROM s), p AS (SELECT canonical, unnest([('__name__', 'events_value'), ('event_type', event_type), ('user_id', user_id), ('region', region)]) AS x FROM d) SELECT x[1] AS label, x[2] AS label_value, count(*) AS series FROM p WHERE x[2] IS NOT NULL GROUP BY ALL")
def postings(spark, sf_dir):
    """The inverted index: how many series each label and value has."""
    return index.postings(_series(spark, sf_dir)).groupBy("label", "label_value").agg(F.count("*").alias("series"))


def _named(spark, sf_dir, ids: DataFrame) -> DataFrame:
    return _series(spark, sf_dir).join(ids, "series_id", "left_semi").select("canonical")


@query(f"{_EVENTS} SELECT DISTINCT {_CANON} AS canonical FROM s WHERE event_type = 'click' AND region = 'r1'")
def postings_intersect(spark, sf_dir):
    s = _series(spark, sf_dir)
    return _named(spark, sf_dir, index.intersect(index.posting_list(s, "event_type", "click"), index.posting_list(s, "region", "r1")))


@query(f"{_EVENTS} SELECT DISTINCT {_CANON} AS canonical FROM s WHERE event_type = 'click' OR region = 'r1'")
def postings_union(spark, sf_dir):
    s = _series(spark, sf_dir)
    return _named(spark, sf_dir, index.union(index.posting_list(s, "event_type", "click"), index.posting_list(s, "region", "r1")))


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms, value FROM s WHERE event_type = 'purchase' AND region = 'r2' AND ts_ms BETWEEN {START} AND {END}")
def select_exact(spark, sf_dir):
    """Exact selection by a semi-join of samples with the index."""
    return _shown(index.select_exact(tables.keyed(_events(spark, sf_dir)), _series(spark, sf_dir), {"event_type": "purchase", "region": "r2"}, START, END), "event_type", "user_id")


@query(f"{_EVENTS} SELECT count(*) AS series FROM (SELECT DISTINCT event_type, user_id FROM s)")
def series_count(spark, sf_dir):
    return tables.keyed(_events(spark, sf_dir)).agg(F.count_distinct("label_key").alias("series"))


@query(f"{_EVENTS} SELECT DISTINCT {_CANON} AS canonical FROM s")
def canonical_labels(spark, sf_dir):
    return tables.keyed(_events(spark, sf_dir)).select("label_key").distinct().select(canonical(F.col("label_key")).alias("canonical"))


@query(f"{_EVENTS}, m AS (SELECT ts_ms - ts_ms % 86400000 AS block_start, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT (event_type, user_id)) AS series_count, count(*) AS sample_count FROM s GROUP BY 1) SELECT 'block-' || lpad(CAST(min_ts AS VARCHAR), 13, '0') || '-' || lpad(CAST(max_ts AS VARCHAR), 13, '0') AS id, * FROM m")
def block_meta(spark, sf_dir):
    return blocks.block_meta(tables.keyed(_events(spark, sf_dir)), 86_400_000)


_CHUNKS = f"{_EVENTS}, o AS (SELECT *, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts_ms) - 1) // 6 AS chunk_no FROM s), c AS (SELECT event_type, user_id, chunk_no, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS sample_count FROM o GROUP BY ALL)"


@query(f"{_CHUNKS} SELECT * FROM c")
def chunk_index(spark, sf_dir):
    """Chunks of six samples."""
    return _keyed_labels(blocks.chunk_index(tables.keyed(_events(spark, sf_dir)), 6), "event_type", "user_id")


@query(f"{_CHUNKS} SELECT * FROM c WHERE min_ts <= {START + 86400000} AND max_ts >= {START}")
def chunk_prune(spark, sf_dir):
    return _keyed_labels(blocks.prune_chunks(blocks.chunk_index(tables.keyed(_events(spark, sf_dir)), 6), START, START + 86400000), "event_type", "user_id")


def _compacted(order: str) -> str:
    return f"{_BLOCKS} SELECT event_type, user_id, ts_ms, value FROM b QUALIFY row_number() OVER (PARTITION BY event_type, user_id, ts_ms ORDER BY ord {order}) = 1"


@query(_compacted("ASC"))
def vertical_compact(spark, sf_dir):
    """Replicas: the first block wins."""
    return _shown(compaction.vertical(_two_blocks(spark, sf_dir)), "event_type", "user_id")


@query(_compacted("DESC"))
def horizontal_compact(spark, sf_dir):
    """Successive blocks: the last block wins."""
    return _shown(compaction.horizontal(_two_blocks(spark, sf_dir)), "event_type", "user_id")


@query(f"{_LINES} SELECT returnflag, linestatus, ts_ms, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1")
def duplicate_times(spark, sf_dir):
    """Times that a series has several times, which no block may hold."""
    return _keyed_labels(blocks.duplicate_times(tables.keyed(tables.lineitem_samples(spark, sf_dir))), "returnflag", "linestatus").withColumn("n", F.col("n").cast("long"))


@query(f"{_LINES}, a AS (SELECT *, max(ts_ms) OVER (PARTITION BY returnflag, linestatus ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s) SELECT returnflag, linestatus, seq, (ts_ms >= 0 AND (top IS NULL OR ts_ms > top)) AS accepted FROM a")
def monotonic_accept(spark, sf_dir):
    """Samples later than all earlier arrivals of their series."""
    samples = tables.keyed(tables.lineitem_samples(spark, sf_dir))
    # the two labels instead of the map: what is sorted is half as wide
    narrow = samples.select(_label("returnflag"), _label("linestatus"), "label_key", "seq", "ts_ms")
    return ingestion.monotonic(narrow).select("returnflag", "linestatus", "seq", "accepted")


def _tenants(spark, sf_dir):
    e = tables.keyed(_events(spark, sf_dir))
    return e.withColumn("tenant", F.concat(F.lit("t"), F.col("event_id") % 4)).withColumn("seq", F.col("event_id"))


_TENANTS = f"{_EVENTS}, t AS (SELECT *, 't' || CAST(event_id % 4 AS VARCHAR) AS tenant FROM s)"


@query(f"{_TENANTS}, f AS (SELECT tenant, event_type, user_id, min(event_id) AS first FROM t GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first) AS r FROM f) SELECT tenant, event_id AS seq, r <= CASE WHEN tenant = 't1' THEN 5 ELSE 40 END AS admitted FROM t JOIN g USING (tenant, event_type, user_id)")
def tenant_gate(spark, sf_dir):
    """Series within each tenant's budget, in arrival order."""
    budgets = spark.createDataFrame([("t1", 5)], "tenant string, max_active_series int")
    return ingestion.tenant_gate(_tenants(spark, sf_dir), budgets, 40).select("tenant", "seq", "admitted")


@query(f"{_TENANTS}, f AS (SELECT tenant, event_type, user_id, min(event_id) AS first FROM t GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first) AS r FROM f), a AS (SELECT tenant, event_id, event_id // 100 AS body, r <= 40 AS ok FROM t JOIN g USING (tenant, event_type, user_id)), b AS (SELECT *, min(ok) OVER (PARTITION BY tenant, body ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kept FROM a) SELECT tenant, event_id AS seq FROM b WHERE kept")
def tenant_gate_abort(spark, sf_dir):
    """A body stops at its first rejected line."""
    gated = ingestion.tenant_gate(_tenants(spark, sf_dir), None, 40).withColumn("body", F.concat_ws("/", "tenant", F.floor(F.col("seq") / 100)))
    return ingestion.abort_after_rejection(gated).select("tenant", "seq")


@query(f"{_TENANTS} SELECT tenant, count(DISTINCT (event_type, user_id)) AS active_series FROM t GROUP BY tenant")
def active_series(spark, sf_dir):
    return ingestion.active_series(_tenants(spark, sf_dir))


@query(f"{_EVENTS} SELECT event_id AS seq, 'events_value' AS name, event_type, user_id, ts_ms, value FROM s")
def parse_text_lines(spark, sf_dir):
    """Samples written as text lines and parsed back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(
        F.lit('events_value{event_type="'), "event_type", F.lit('",user_id="'), F.col("user_id").cast("string"), F.lit('"} '),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit(" "), F.col("value").cast("string"),
    )
    parsed = parse_lines(e.select(F.col("event_id").alias("seq"), line.alias("line")), strict=True)
    return parsed.select("seq", F.try_element_at("labels", F.lit("__name__")).alias("name"), _label("event_type"), _label("user_id"), "ts_ms", "value")


@query("SELECT 'svc-' || CAST(s % 5 AS VARCHAR) AS service, 'pod-' || CAST(s AS VARCHAR) AS instance, i * 15000 AS ts_ms, CAST(s * 1000 + i AS DOUBLE) AS value FROM range(8) a(s), range(25) b(i)")
def demo_load(spark, sf_dir):
    """The demo generator: 8 series of 25 samples."""
    return _shown(demo_samples(spark, 8, 25), "service", "instance")


@query(f"{_EVENTS} SELECT coalesce(region, '') AS region, count(*) AS samples FROM s GROUP BY ALL")
def label_projection(spark, sf_dir):
    """A label's value, blank where it is missing."""
    return _events(spark, sf_dir).groupBy(label_or_blank(F.col("labels"), "region").alias("region")).agg(F.count("*").alias("samples"))


def _stored(spark, sf_dir) -> DataFrame:
    """Events written as a block in a folder that Spark's shared storage has, and read back."""
    import uuid

    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{root}/block-{uuid.uuid4().hex}"
    blocks.write_block(_events(spark, sf_dir).select("labels", "ts_ms", "value"), path)
    return blocks.read_block(spark, path)


@query(f"{_EVENTS} SELECT event_type, user_id, ts_ms, value FROM s WHERE event_type = 'click' AND ts_ms BETWEEN {START} AND {END}")
def block_round_trip(spark, sf_dir):
    """A block written, read back and selected from; the time range prunes its partitions."""
    stored = _stored(spark, sf_dir).withColumn("block_ord", F.lit(0))
    return _shown(selectors.select(stored, [eq("event_type", "click")], START, END), "event_type", "user_id")
