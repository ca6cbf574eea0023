import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesforge.functions.labels import canonical, fingerprint, intervals_overlap, label_key, valid_labels
from seriesforge.operators import compaction, index, ingestion, selectors
from seriesforge.operators.matchers import Matcher, eq, neq, not_regex, regex
from seriesforge.plans.node import Node
from seriesforge.sources import blocks
from seriesforge.sources.demo import demo_samples
from seriesforge.sources.exposition import parse_body, parse_lines
from seriesforge.streaming.ingest import Ingest

SCHEMA = "labels map<string,string>, ts_ms long, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("block_ord", F.lit(0))


@pytest.fixture(scope="module")
def three(spark):
    """Three series of ten samples."""
    rows = []
    for labels, a, b in (({"service": "checkout", "status": "200"}, 1, 1), ({"service": "checkout", "status": "500"}, 2, 2), ({"service": "payment", "status": "200"}, 10, 1)):
        rows += [(labels, i * 1000, float(a + b * i)) for i in range(10)]
    return frame(spark, rows).cache()


def test_range_with_two_matchers(three):
    got = selectors.range_select(three, [eq("service", "checkout"), regex("status", "5..")], 2000, 6000).collect()
    assert [r.ts_ms for r in got] == [2000, 3000, 4000, 5000, 6000]
    assert len({str(r.label_key) for r in got}) == 1


def test_rate_sum_by(three):
    got = {r.status: r.rate for r in selectors.rate_sum_by(three, [eq("service", "checkout")], "status", 0, 9000).collect()}
    assert got == pytest.approx({"200": 1.0, "500": 2.0})


def test_counter_reset(spark):
    df = frame(spark, [({"a": "1"}, t, v) for t, v in ((0, 10.0), (1000, 15.0), (2000, 2.0), (3000, 5.0))]).withColumn("label_key", label_key(F.col("labels")))
    assert selectors.counter_rates(df).first().rate == pytest.approx(10 / 3)


def test_rate_of_equal_times_is_zero_and_single_samples_are_left_out(spark):
    a = frame(spark, [({"a": "1"}, 5, 1.0), ({"b": "1"}, 5, 1.0)]).drop("block_ord")
    both = selectors.union_blocks([a, a.where("labels['a'] is not null")])
    assert [(r.a, r.rate) for r in selectors.rate_sum_by(both, [], "a", 0, 9).collect()] == [("1", 0.0)]


def test_avg_weighs_samples_and_groups_missing_labels(spark):
    df = frame(spark, [({"g": "x", "s": "1"}, 1, 1.0)] + [({"g": "x", "s": "2"}, t, 5.0) for t in (1, 2, 3)] + [({"s": "3"}, 1, 7.0)])
    assert {r.g: r.avg_value for r in selectors.avg_by(df, [], "g", 0, 9).collect()} == {"x": 4.0, "": 7.0}


@pytest.mark.parametrize(
    ("matcher", "present", "missing"),
    [
        (eq("region", ""), [""], False), (neq("region", "x"), ["", "500", "x500y", "a\n"], True), (regex("region", ".*"), ["", "500", "x500y", "x"], False),
        (not_regex("region", ".*"), ["a\n"], True), (regex("region", "5.."), ["500"], False), (regex("region", "x|5"), ["x"], False),
    ],
)
def test_matchers_on_missing_labels(spark, matcher, present, missing):
    df = frame(spark, [({"region": v}, 0, 0.0) for v in ("", "500", "x500y", "x", "a\n")] + [({"other": "1"}, 0, 0.0)])
    got = selectors.select(df, [matcher], 0, 1).collect()
    assert sorted(r.labels["region"] for r in got if "region" in r.labels) == sorted(present)
    assert any("other" in r.labels for r in got) == missing


def test_invalid_matchers(spark, three):
    for bad, error in (((None, "=", "x"), TypeError), (("a", "=", None), TypeError), (("", "=", "x"), ValueError), (("a", "~", "x"), ValueError)):
        with pytest.raises(error):
            Matcher(*bad)
    with pytest.raises(Exception, match="(?i)unclosed|pattern"):
        selectors.select(three, [regex("nobody", "(")], 0, 1)


def test_instant_takes_old_samples_and_the_later_block(spark):
    a = frame(spark, [({"a": "1"}, 0, 1.0), ({"a": "2"}, 7, 2.0)]).drop("block_ord")
    b = frame(spark, [({"a": "1"}, 0, 9.0)]).drop("block_ord")
    got = selectors.instant_select(selectors.union_blocks([a, b]), [], 10**12).collect()
    assert sorted((r.label_key[0].value, r.ts_ms, r.value) for r in got) == [("1", 0, 9.0), ("2", 7, 2.0)]
    assert selectors.instant_select(selectors.union_blocks([a, b]), [], 5).count() == 1


def test_conflicting_blocks(spark):
    a, b = (frame(spark, [({"a": "1"}, 0, v), ({"a": "1"}, 1000, v)]).drop("block_ord") for v in (1.0, 9.0))
    assert selectors.range_select(selectors.union_blocks([a, b]), [], 0, 0).count() == 2
    assert {r.value for r in compaction.vertical([a, b]).collect()} == {1.0}
    assert {r.value for r in compaction.horizontal([a, b]).collect()} == {9.0}
    once = compaction.vertical([a, b])
    assert sorted(compaction.vertical([once.drop("label_key")]).select("ts_ms", "value").collect()) == sorted(once.select("ts_ms", "value").collect())


def test_adjacent_blocks(spark):
    a, b = (frame(spark, [({"s": "c"}, t, 1.0) for t in ts]).drop("block_ord") for ts in ((0, 1000), (2000, 3000)))
    assert sorted(r.ts_ms for r in compaction.horizontal([a, b]).collect()) == [0, 1000, 2000, 3000]


GOLDEN = [
    ({"service": "checkout"}, -3519278088862321324), ({"service": "payment"}, -7888202581156899172), ({"service": "checkout", "status": "200"}, -3690888554652659962),
    ({"status": "500", "service": "checkout"}, -9083388319058556627), ({"service": "payment", "status": "500"}, 1965339964089053925),
    ({"__name__": "http_requests_total", "service": "checkout", "status": "200"}, -731539245537061171), ({"a": "1;b=2"}, 5924815044096295349), ({"a": "1", "b": "2"}, 5924815044096295349),
]


def _fnv(labels):
    h = 0xCBF29CE484222325
    for k in sorted(labels):
        for b in f"{k}={labels[k]};".encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_fingerprints(spark):
    more = [({"ключ": "é😀", "x": "\x00\n"}, None), ({"k": ""}, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(GOLDEN + more)], "i int, labels map<string,string>")
    got = {r.i: r.f for r in df.select("i", fingerprint(label_key(F.col("labels"))).alias("f")).collect()}
    for i, (x, want) in enumerate(GOLDEN + more):
        assert got[i] == _fnv(x)
        assert want in (None, got[i])


def test_label_sets_that_collide_stay_apart(spark):
    df = frame(spark, [({"a": "1;b=2"}, 0, 1.0), ({"a": "1", "b": "2"}, 0, 2.0), ({'a="1",b': "2"}, 0, 3.0)])
    series = index.series_table(df)
    assert series.count() == 3 and index.colliding(series).count() == 1
    assert selectors.instant_select(df, [], 9).count() == 3


def test_canonical_and_validity(spark):
    df = spark.createDataFrame([({"url": '/a"b\\c', "b": "x"},), ({},), ({"": "x"},), ({"a": None},)], "labels map<string,string>")
    rows = df.select(canonical(label_key(F.col("labels"))).alias("c"), valid_labels(F.col("labels")).alias("ok")).collect()
    assert rows[0].c == '{b="x",url="/a\\"b\\\\c"}'
    assert [r.ok for r in rows] == [True, False, False, False]


def test_index(spark):
    df = frame(spark, [({"service": s, "status": t}, 0, 1.0) for s, t in (("checkout", "200"), ("checkout", "500"), ("payment", "500"))])
    series = index.series_table(df)
    assert [r.canonical for r in index.exact_match(series, {"service": "checkout", "status": "500"}).collect()] == ['{service="checkout",status="500"}']
    assert index.posting_list(series, "status", "500").count() == 2
    assert index.exact_match(series, {}).count() == 3
    assert index.posting_list(series, "status", "404").count() == 0


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "series_id long") for xs in ((1, 3, 5, 7), (2, 3, 5, 9)))
    assert sorted(r[0] for r in index.intersect(a, b).collect()) == [3, 5]
    assert sorted(r[0] for r in index.union(a, b).collect()) == [1, 2, 3, 5, 7, 9]
    assert index.intersect(a, b.limit(0)).count() == 0


def test_overlap_is_inclusive(spark):
    df = spark.createDataFrame([(200, 300), (50, 100), (0, 99), (201, 300)], "a long, b long")
    assert [r[0] for r in df.select(intervals_overlap(F.col("a"), F.col("b"), 100, 200)).collect()] == [True, True, False, False]


def test_block_round_trip(spark, tmp_path):
    df = frame(spark, [({"service": s, "status": "500"}, i * 1000, float(a + i)) for s, a in (("checkout", 1), ("payment", 10)) for i in range(10)])
    meta = blocks.write_block(df, f"{tmp_path}/b")
    assert (meta["id"], meta["series_count"], meta["sample_count"]) == ("block-0000000000000-0000000009000", 2, 20)
    assert blocks.read_meta(spark, f"{tmp_path}/b").first().asDict() == meta
    stored = blocks.read_block(spark, f"{tmp_path}/b").withColumn("block_ord", F.lit(0))
    got = selectors.range_select(stored, [eq("service", "checkout")], 2000, 5000).collect()
    assert [r.ts_ms for r in got] == [2000, 3000, 4000, 5000]
    with pytest.raises(ValueError, match="twice"):
        blocks.write_block(df.union(df), f"{tmp_path}/c")
    with pytest.raises(ValueError, match="empty"):
        blocks.write_block(df.limit(0), f"{tmp_path}/d")


def test_special_values_and_gaps_survive_a_block(spark, tmp_path):
    times = [0, 64, 64 + 128, 192 + 384, 576 + 2432, 2**41]
    values = [float("nan"), float("inf"), float("-inf"), -0.0, 5e-324, 1.5]
    blocks.write_block(frame(spark, list(zip([{"a": "1"}] * 6, times, values, strict=True))), f"{tmp_path}/b")
    got = sorted((r.ts_ms, repr(r.value)) for r in blocks.read_block(spark, f"{tmp_path}/b").collect())
    assert got == sorted(zip(times, map(repr, values), strict=True))


def test_meta_validation():
    for bad in (("", 0, 1, 1, 1), ("b", 100, 50, 1, 1), ("b", 0, 1, -1, 1), ("b", 0, 1, 1, -1)):
        with pytest.raises(ValueError):
            blocks.validate_meta(*bad)


def test_time_range_prunes_partitions(spark, tmp_path):
    blocks.write_block(frame(spark, [({"a": "1"}, i * 3_600_000, 1.0) for i in range(48)]), f"{tmp_path}/b")
    df = selectors.time_range(spark.read.parquet(f"{tmp_path}/b/samples"), 7_200_000, 14_399_999)
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block_start" in plan and "PushedFilters: [IsNotNull(ts_ms)" in plan
    assert df.count() == 2


def test_chunks(spark):
    df = frame(spark, [({"a": "1"}, 1 + 1000 * i, 1.0) for i in range(100)]).withColumn("label_key", label_key(F.col("labels")))
    assert sorted(r.sample_count for r in blocks.chunk_index(df, 32).collect()) == [4, 32, 32, 32]
    assert blocks.prune_chunks(blocks.chunk_index(df, 32), 40_000, 50_000).count() == 1


def _parsed(spark, line):
    return parse_lines(spark.createDataFrame([(line,)], "line string")).collect()


def test_parser(spark):
    (r,) = _parsed(spark, 'http_requests_total{service="checkout",status="500"} 1700000000000 42.0')
    assert r.labels == {"__name__": "http_requests_total", "service": "checkout", "status": "500"} and (r.ts_ms, r.value) == (1700000000000, 42.0)
    for line in ("", "   ", "# c", " # c"):
        assert _parsed(spark, line) == []
    for line in ('m{a="1,2"} 1 1', 'm{a="x y"} 1 1', "m{a=1} 1 1", "m 1", "m", "m x 1", "m 1 x", 'm{a="1" 1 1', 'm{=" "} 1 1', 'm{a="} 1 1'):
        assert _parsed(spark, line)[0].error, line
    for line, labels in (
        ('m{a="1",} 1 1', {"__name__": "m", "a": "1"}), ("m{} 1 1", {"__name__": "m"}), ("m 1 1", {"__name__": "m"}), ('m{__name__="n"} 1 1', {"__name__": "n"}),
        ('m{a="1",a="2"} 1 1', {"__name__": "m", "a": "2"}), ('m{a="x=y"} 1 1', {"__name__": "m", "a": "x=y"}), ('m{a="1"}junk 1 1', {"__name__": "m", "a": "1"}),
    ):
        assert _parsed(spark, line)[0].labels == labels, line
    assert _parsed(spark, "m 1 Infinity")[0].value == float("inf")
    with pytest.raises(Exception, match="bad label"):
        parse_body(spark, "m 1 1\nm{a=1} 1 1").collect()


def _arrivals(spark, rows):
    df = spark.createDataFrame(rows, "seq long, tenant string, s string, ts_ms long")
    return df.withColumn("label_key", label_key(F.create_map(F.lit("s"), F.col("s"))))


def test_monotonic(spark):
    df = _arrivals(spark, [(1, "t", "a", 5), (2, "t", "a", 5), (3, "t", "a", 4), (4, "t", "a", 6), (5, "t", "b", 1), (6, "t", "c", -1)])
    assert [r.accepted for r in ingestion.monotonic(df).orderBy("seq").collect()] == [True, False, False, True, True, False]


def test_gate(spark):
    df = _arrivals(spark, [(1, "t", "a", 1), (2, "t", "b", 1), (3, "t", "a", 2), (4, "u", "b", 1), (5, "u", "c", 1)])
    budgets = spark.createDataFrame([("u", 2)], "tenant string, max_active_series int")
    gated = ingestion.tenant_gate(df, budgets, 1)
    assert [r.admitted for r in gated.orderBy("seq").collect()] == [True, False, True, True, True]
    left = ingestion.abort_after_rejection(gated.withColumn("body", F.lit(1)).where("tenant = 't'"))
    assert [r.seq for r in left.collect()] == [1]
    assert {r.tenant: r.active_series for r in ingestion.active_series(df).collect()} == {"t": 2, "u": 2}
    known = df.where("s = 'b' and tenant = 't'").select("tenant", "label_key")
    again = ingestion.tenant_gate(df.where("tenant = 't'"), None, 1, known=known)
    assert [r.admitted for r in again.orderBy("seq").collect()] == [False, True, False]


def test_demo(spark):
    df = demo_samples(spark, 8, 25)
    assert df.count() == 200 and index.series_table(df).count() == 8
    assert df.where("labels['instance'] = 'pod-7' and ts_ms = 360000").first().value == 7024.0


def test_node(spark, tmp_path):
    node = Node(spark, f"{tmp_path}/n", budget=2)
    rows = spark.createDataFrame([(i, {"__name__": "m", "service": "checkout"}, 1000 * i, float(i)) for i in range(10)], "seq long, labels map<string,string>, ts_ms long, value double")
    assert node.append(rows) == 10 and node.series_count() == 1
    assert node.read(5000, 6000, {"service": "checkout", "__name__": "m"}).count() == 2
    node.flush()
    assert node.ingest('m{service="checkout"} 20000 1\nm{service="pay"} 1 2') == 2
    node.flush()
    assert node.range([], 0, 99999).count() == 12
    assert node.instant([eq("service", "checkout")], 99999).first().value == 1.0
    assert {r.service for r in node.avg_by([], "service", 0, 99999).collect()} == {"checkout", "pay"}
    assert node.rate_sum_by([], "service", 0, 9000).count() == 1
    with pytest.raises(ingestion.CardinalityLimitExceeded):
        node.ingest('m{service="third"} 1 1')
    with pytest.raises(ValueError, match="rise"):
        node.ingest('m{service="checkout"} 20000 1')
    assert node.ingest('m{service="checkout"} 20000 1', strict=False) == 0


def _samples(spark, rows):
    return spark.createDataFrame(rows, "seq long, labels map<string,string>, ts_ms long, value double")


def test_node_opened_again(spark, tmp_path):
    path, a, b = f"{tmp_path}/n", {"__name__": "m", "s": "a"}, {"__name__": "m", "s": "b"}
    first = Node(spark, path, budget=2)
    first.append(_samples(spark, [(0, a, 10, 1.0), (1, a, 20, 2.0)]))
    first.flush()
    first.append(_samples(spark, [(0, a, 30, 3.0)]))
    first.close()
    with pytest.raises(ValueError, match="closed"):
        first.flush()
    second = Node(spark, path, budget=2)
    assert second.read_all(a).count() == 3 and second.range([], 0, 99).count() == 2
    with pytest.raises(ValueError, match="rise"):
        second.append(_samples(spark, [(0, b, 1, 1.0), (1, a, 30, 9.0), (2, a, 40, 9.0)]))
    # what stood before the failing sample is kept, what follows is not
    assert second.read_all(b).count() == 1 and second.read_all(a).count() == 3
    with pytest.raises(ingestion.CardinalityLimitExceeded):
        second.get_or_create({"__name__": "m", "s": "c"})
    own = second.get_or_create(a)
    assert own == second.get_or_create(dict(reversed(a.items()))) and second.series_count() == 2
    rows = spark.createDataFrame([(0, own, 50, 5.0)], "seq long, series_id long, ts_ms long, value double")
    assert second.append_by_id(rows) == 1 and [r.ts_ms for r in second.read_id(own, 25).collect()] == [30, 50]
    with pytest.raises(KeyError):
        second.append_by_id(rows.withColumn("series_id", F.lit(12345)))
    assert second.read_id(12345).count() == 0
    second.flush()
    third = Node(spark, path)
    assert [m["sample_count"] for m in third.metas] == [2, 3] and third.range([], 0, 99).count() == 5
    assert third.compact("horizontal")["sample_count"] == 5
    for i in range(18):
        third.append(_samples(spark, [(0, a, 100 + i, 0.0)]))
    assert third._series.deltas(third._next) < 18 and third.series_count() == 2 and Node(spark, path).latest().count() == 2


def test_blocks_are_pruned_and_checked(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    rows = [({"s": x}, i * 3_600_000, 1.0) for x in "abcd" for i in range(24)]
    blocks.write_block(frame(spark, rows), path)
    df = blocks.read_block(spark, path, [eq("s", "b")], 7_200_000, 14_399_999)
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(series_id," in plan and "block_start" in plan and df.count() == 2
    assert blocks.read_block(spark, path, [eq("s", "x")], 0, 99).count() == 0
    blocks.check_chunks(spark, path)
    own = blocks.read_series(spark, path).first().series_id
    assert blocks.entry(spark, path, own).count() == 12 and blocks.entry(spark, path, 1).count() == 0
    blocks.read_chunks(spark, path).withColumn("distinct_times", F.col("sample_count")).withColumn("max_ts", F.col("max_ts") + 1).write.parquet(f"{path}2/chunks")
    spark.read.parquet(f"{path}/samples").write.partitionBy("block_start").parquet(f"{path}2/samples")
    with pytest.raises(ValueError, match="chunk"):
        blocks.check_chunks(spark, f"{path}2")
    with pytest.raises(ValueError, match="mode"):
        compaction.to_block([], path, "x")


def test_posting_ids(spark):
    assert index.posting_ids(spark, [-5, 1, 7]).count() == 3
    for bad in ([5, 5], [5, 4]):
        with pytest.raises(ValueError, match="rise"):
            index.posting_ids(spark, bad)


def test_long_series_are_cut_into_stretches(spark):
    rows = [(i, "t", "ab"[i % 2], (i * 7919) % 101) for i in range(400)]
    df = _arrivals(spark, rows)
    top, want = {}, {}
    for i, _, s, t in rows:
        want[i] = t > top.get(s, -1)
        top[s] = max(t, top.get(s, -1))
    assert {r.seq: r.accepted for r in ingestion.monotonic(df, stretch=16).collect()} == want


def test_streaming_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ingest = Ingest(spark, f"file://{tmp_path}/store", budget=2)

    def run(name, lines):
        (source / name).write_text("\n".join(json.dumps({"seq": i, "tenant": "t", "line": x}) for i, x in lines))
        stream = spark.readStream.schema("seq long, tenant string, line string").json(str(source))
        ingest.start(stream, f"{tmp_path}/cp").awaitTermination()

    run("a.json", [(1, 'm{s="a"} 10 1'), (2, 'm{s="a"} 5 1'), (3, 'm{s="b"} 1 2'), (4, 'm{s="c"} 1 3'), (5, "bad")])
    assert sorted((r.labels["s"], r.ts_ms) for r in ingest.samples().collect()) == [("a", 10), ("b", 1)]
    run("b.json", [(6, 'm{s="a"} 10 9'), (7, 'm{s="a"} 11 9'), (8, 'm{s="c"} 2 9')])
    assert sorted((r.labels["s"], r.ts_ms) for r in ingest.samples().collect()) == [("a", 10), ("a", 11), ("b", 1)]
    assert ingest.series().count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50), st.floats(0, 1e6)), min_size=1, max_size=30))
def test_properties(spark, rows):
    df = frame(spark, [({"s": s} if s != "c" else {"t": "x"}, t, v) for s, t, v in rows])
    total = df.count()
    assert selectors.select(df, [eq("s", "a")], 0, 99).count() + selectors.select(df, [neq("s", "a")], 0, 99).count() == total
    assert selectors.select(df, [regex("s", "a|b")], 0, 99).count() + selectors.select(df, [not_regex("s", "a|b")], 0, 99).count() == total
    assert all(r.rate >= 0 for r in selectors.rate_sum_by(df, [], "s", 0, 99).collect())
