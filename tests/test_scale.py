"""How often and how widely the engine's steps touch rows; their results are held by the other tests."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from seriesforge.functions.labels import label_key
from seriesforge.operators import ingestion, selectors
from seriesforge.plans import catalog, stored  # noqa: F401  stored adds its queries to the catalog
from seriesforge.plans.node import Node
from seriesforge.sources import blocks
from seriesforge.streaming.ingest import Ingest


def _samples(spark, n, series=7, gap=1):
    labels = F.create_map(F.lit("s"), (F.col("id") % series).cast("string"))
    return spark.range(n).select((F.col("id") * gap).alias("seq"), labels.alias("labels"), (F.col("id") * 1000).alias("ts_ms"), F.col("id").cast("double").alias("value"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_a_batch_is_parsed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(i):
        seen.add(1)
        return f'm{{a="{i % 5}"}} {i} 1' if i % 10 else "bad"

    lines = spark.range(200).select(F.col("id").alias("seq"), F.lit("t").alias("tenant"), F.udf(touch, StringType()).asNondeterministic()("id").alias("line"))
    ingest = Ingest(spark, f"file://{tmp_path}/store", budget=3)
    ingest.ingest_batch(lines, 0)
    assert seen.value == 200
    # 5 series of 40 lines; of the multiples of 5 every other one is bad
    kept = {r[0]: r[1] for r in ingest.samples().groupBy(F.element_at("labels", "a")).count().collect()}
    assert kept == {"1": 40, "2": 40, "3": 40}
    assert {r[0]: r[1] for r in ingest.rejected().groupBy("error").count().collect()} == {"missing field": 20, "series budget": 60}


def test_a_block_computes_ids_once_a_series(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def touch(k):
        seen.add(1)
        return int(k[0]["value"])

    udf = F.udf(touch, LongType()).asNondeterministic()
    monkeypatch.setattr(blocks, "fingerprint", lambda k: udf(k))
    meta = blocks.write_block(_samples(spark, 90, 9), f"file://{tmp_path}/block")
    assert seen.value == 9
    assert (meta["series_count"], meta["sample_count"], meta["min_ts"], meta["max_ts"]) == (9, 90, 0, 89000)
    assert meta["id"] == "block-0000000000000-0000000089000"


def test_fingerprints_once_a_series(spark, tmp_path):
    s = _samples(spark, 50).withColumn("block_ord", F.lit(0))
    lines = _plan(selectors.range_select(s, [], 0, 40000))
    at = [i for i, line in enumerate(lines) if "aggregate(" in line]
    assert at and all("Aggregate [" in lines[i] + lines[i + 1] for i in at)
    with Node(spark, f"file://{tmp_path}/node") as node:
        node.append(_samples(spark, 50))
        found = node.read_id(node.get_or_create({"s": "3"}))
        assert not any("aggregate(" in line for line in _plan(found))
        assert [r["ts_ms"] for r in found.collect()] == [i * 1000 for i in range(3, 50, 7)]
        assert node.read_id(12345).count() == 0


def test_range_ordered_ranks_no_rows_in_one_task(spark):
    df = catalog.QUERIES["range_ordered"](spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    # what meets in one task are counts of partitions
    assert single and all("n#" in lines[i + 1] and "HashAggregate" in lines[i + 1] for i in single)


def test_monotonic_wide_gaps_and_long_series(spark):
    s = _samples(spark, 300, 3, gap=1 << 20).withColumn("ts_ms", F.pmod(F.xxhash64("seq"), F.lit(1000))).withColumn("label_key", label_key(F.col("labels")))
    s = s.withColumn("counts", F.col("seq") % 5 != 0)
    w = Window.partitionBy("label_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.when(F.col("counts"), F.col("ts_ms"))).over(w)
    want = {(r["seq"], r["e"]) for r in s.withColumn("e", F.col("counts") & (top.isNull() | (F.col("ts_ms") > top))).collect()}
    for stretch in (10, 50, 1 << 30):
        assert {(r["seq"], r["accepted"]) for r in ingestion.monotonic(s, stretch=stretch, counting="counts").collect()} == want


def test_monotonic_of_equal_arrival_numbers(spark):
    # of one number, times fall in one row order and rise in the other; both are the same rows
    rows = [("a" if n % 2 else "b", None if n > 36 else n // 4, t) for n in range(40) for t in (n * 10 + 3, n * 10, n * 10 + 7, n * 10 + 3, -5)]
    want = set()
    for series in "ab":
        top = None
        for seq, t in sorted(((seq, t) for s, seq, t in rows if s == series), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            want.add((series, seq, t, t >= 0 and (top is None or t > top)))
            top = t if top is None else max(top, t)
    for stood in (rows, rows[::-1]):
        s = spark.createDataFrame(stood, "s string, seq long, ts_ms long").coalesce(1).withColumn("label_key", label_key(F.create_map(F.lit("s"), "s")))
        for stretch in (3, 1 << 30):
            assert {(r["s"], r["seq"], r["ts_ms"], r["accepted"]) for r in ingestion.monotonic(s, stretch=stretch).collect()} == want


def test_monotonic_accept_sorts_no_maps(spark):
    df = catalog.QUERIES["monotonic_accept"](spark, "/root/testdata/sf0.001")
    lines = _plan(df)
    windows = [i for i, line in enumerate(lines) if "Window [" in line and "_inside" in line]
    assert windows and all("labels#" not in lines[i + 1] for i in windows)


def test_without_a_budget_every_series_is_let_in(spark, tmp_path):
    s = _samples(spark, 40, 40)
    with Node(spark, f"file://{tmp_path}/node") as node:
        # no series are ranked, as no number of them is too large
        assert not any("row_number" in line for line in _plan(node._gated(s, "t")))
        assert node.append(s) == 40 and node.series_count() == 40
        assert node.head().where(label_key(F.col("labels")) != F.col("label_key")).count() == 0
    keyed = s.withColumn("label_key", label_key(F.col("labels")))
    two = keyed.withColumn("tenant", F.lit("t")).unionByName(keyed.withColumn("tenant", F.lit("u")))
    for known, n in ((None, 2), (keyed.where("seq = 39").select(F.lit("u").alias("tenant"), "label_key"), 2)):
        gated = ingestion.tenant_gate(two, spark.createDataFrame([("u", 2)], "tenant string, max_active_series int"), None, known=known)
        assert {r[0]: r[1] for r in gated.where("admitted").groupBy("tenant").count().collect()} == {"t": 40, "u": n}


def test_a_stream_without_a_budget_refuses_no_series(spark, tmp_path):
    lines = spark.range(60).select(F.col("id").alias("seq"), F.lit("t").alias("tenant"), F.format_string('m{a="%d"} %d 1', F.col("id") % 40, F.col("id")).alias("line"))
    ingest = Ingest(spark, f"file://{tmp_path}/store")
    for batch, part in enumerate((F.col("seq") < 20, F.col("seq") >= 20)):
        ingest.ingest_batch(lines.where(part), batch)
    assert ingest.samples().count() == 60 and ingest.series().count() == 40 and ingest.rejected().count() == 0
    # what only one batch reads is gone
    assert ingest._logs["parsed"].parts() == ingest._logs["checked"].parts() == []


def test_the_streaming_queries_have_no_budget(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stored, "Ingest", lambda *a, **k: seen.append(Ingest(*a, **k)) or seen[-1])
    assert catalog.QUERIES["streaming_state"](spark, "/root/testdata/sf0.001").count() == 1
    assert catalog.QUERIES["streaming_restart"](spark, "/root/testdata/sf0.001").count() == 1000
    assert [i.budget for i in seen] == [None, None]


def test_an_append_holds_no_label_sets(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    held = []
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: held.append((df.columns, df.count())) or persist(df, *a))
    with Node(spark, f"file://{tmp_path}/node") as node:
        assert node.append(_samples(spark, 90, 9)) == 90
        node.flush()
        assert node.samples().count() == 90
    # label sets are held once a series, not once a sample
    assert all(n <= 9 for columns, n in held if {"labels", "label_key"} & set(columns))
    assert node._checked.parts() == []
