import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.expr import rule_condition, volume_range
from shelfspark.operators import benchmarking, events, ingest, mart, metrics, periods, portfolio
from shelfspark.sources.tables import read_facts, write_facts
from shelfspark.streaming import incremental


def d(text):
    return dt.date.fromisoformat(text)


def test_mapping_errors(spark):
    raw = spark.createDataFrame([(1, "x")], "a int, b string")
    assert ingest.map_columns(raw, {"a": "k"}).columns == ["k"]
    for mapping, required in (({"z": "k"}, ()), ({"a": "k", "b": "k"}, ()), ({"a": "k"}, ("m",))):
        with pytest.raises(ValueError):
            ingest.map_columns(raw, mapping, required)


def test_periods_of_text(spark):
    rows = [("2025", "3"), ("2025", "March"), ("2025", "13"), ("x", "1"), (None, "1"), ("2025", None)]
    got = ingest.normalise_period(spark.createDataFrame(rows, "y string, m string"), "y", "m").collect()
    assert [(r["period"], r["period_issue"]) for r in got] == [(d("2025-03-01"), None)] * 2 + [(None, "invalid_month"), (None, "invalid_year"), (None, "invalid_year"), (None, "invalid_month")]


def test_two_canonical_stores_are_an_error(spark):
    rows = spark.createDataFrame([("A",)], "store string")
    with pytest.raises(ValueError):
        ingest.canonical_stores(rows, spark.createDataFrame([("A", "B"), ("A", "C")], "source_store string, canonical_store string"))


def test_rule_conditions(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, k string")
    count = lambda *c: df.where(rule_condition(list(c), df.columns)).count()
    assert count(("x", "between", (1.0, 2.0))) == 2 and count(("x", "lt", 5.0), ("k", "in", ("a",))) == 1
    assert count(("x", "not_in", (1.0,))) == 1 and count(("missing", "eq", 1)) == 0


def test_volume_ranges_are_half_open(spark):
    df = spark.createDataFrame([(0.25,), (0.26,), (0.0,), (None,), (9.0,)], "v double")
    assert [r[0] for r in df.select(volume_range("v")).collect()] == ["le_0_25", "gt_0_25_le_0_50", None, None, "gt_5_00"]


def test_gaps_in_months(spark):
    rows = [(d("2025-01-01"), "a", 10.0), (d("2026-01-01"), "a", 15.0), (d("2026-02-01"), "a", 0.0), (d("2026-04-01"), "a", 8.0), (d("2026-02-01"), None, 1.0), (d("2026-01-01"), None, 4.0)]
    df = spark.createDataFrame(rows, "period date, k string, revenue double")
    get = lambda kind: {(r["period"], r["k"]): (r["reference_period"], r["delta_pct"], r["month_gap"]) for r in periods.compare(df, ("k",), "revenue", kind).collect()}
    assert (d("2026-04-01"), "a") not in get("MOM")
    assert get("PREVIOUS_AVAILABLE")[d("2026-04-01"), "a"] == (d("2026-02-01"), None, 2)
    assert get("YOY")[d("2026-01-01"), "a"] == (d("2025-01-01"), 0.5, 12)
    assert get("MOM")[d("2026-02-01"), None][1] == -0.75


def test_price_segments_keep_ties(spark):
    rows = [("c", s, p) for s, p in zip("abcdefgh", (10.0, 20.0, 20.0, 40.0, 50.0, None, 0.0, 30.0), strict=True)]
    got = {r["sku"]: r["price_segment"] for r in benchmarking.price_segments(spark.createDataFrame(rows, "category string, sku string, price double")).collect()}
    assert got == {"a": "ECONOMY", "b": "ECONOMY", "c": "ECONOMY", "h": "MID", "d": "PREMIUM", "e": "PREMIUM", "f": "UNCLASSIFIED_PRICE_NULL", "g": "UNCLASSIFIED_PRICE_INVALID"}


def test_relative_price_leaves_the_target_out(spark):
    for prices in ([1.0, 2.0, 4.0, 8.0, 16.0], [1.0, 2.0, 4.0, 8.0], [3.0, 3.0], [5.0]):
        df = spark.createDataFrame([("c", f"s{k}", False, p) for k, p in enumerate(prices)] + [("c", "own", True, 6.0)], "category string, sku string, is_own boolean, price double")
        got = {r["sku"]: r["peer_median"] for r in benchmarking.relative_prices(df).collect()}
        import statistics

        want = {f"s{k}": statistics.median(prices[:k] + prices[k + 1 :]) if len(prices) > 1 else None for k in range(len(prices))} | {"own": statistics.median(prices)}
        assert got == want


def test_abc_first_row_is_a_and_signs_stand_apart(spark):
    df = spark.createDataFrame([("c", "x", 90.0), ("c", "y", 10.0), ("c", "z", 0.0), ("c", "n", -5.0)], "category string, sku string, v double")
    got = {r["sku"]: r["abc_class"] for r in portfolio.abc_classes(df, "v", ("category",)).collect()}
    assert got == {"x": "A", "y": "C", "z": "UNCLASSIFIED", "n": "NEGATIVE_OR_CORRECTION"}


def test_private_label_unknown(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "private_label boolean")
    assert [metrics.private_label_scope(df, s).count() for s in ("INCLUDE", "EXCLUDE", "ONLY")] == [3, 1, 1]
    assert metrics.private_label_scope(df, "EXCLUDE", keep_unknown=True).count() == 2


def test_range_aggregation_never_invents(spark):
    rows = [("m", mart.SUM, 1.0, None, None), ("m", mart.SUM, None, None, None), ("r", mart.RATIO, 9.0, 1.0, 4.0), ("r", mart.RATIO, 9.0, 2.0, 2.0), ("u", mart.UNSUPPORTED, 3.0, None, None), ("p", mart.PERIOD_ONLY, 3.0, None, None)]
    df = spark.createDataFrame([("g", "e", "c", None, *r, None) for r in rows], "entity_type string, entity_id string, category string, manufacturer string, metric string, range_strategy string, value double, numerator double, denominator double, share_scope string")
    got = {r["metric"]: (r["value"], r["limitation"]) for r in mart.range_aggregate(df).collect()}
    assert got == {"m": (None, "additive_value_missing"), "r": (0.5, None), "u": (None, "range_aggregation_unsupported"), "p": (None, "range_aggregation_period_only")}


def test_facts_are_partitioned_and_read_back(spark, tmp_path):
    rows = [("r", "s", "month", "2025-01-01", "b1", "x", 1.0), ("r", "s", "month", "2025-02-01", "b1", "x", 2.0)]
    facts = spark.createDataFrame(rows, "retailer_id string, source_id string, period_grain string, period_start string, mart_build_id string, metric string, value double")
    path = str(tmp_path / "facts")
    write_facts(facts, path)
    write_facts(facts.where("period_start = '2025-02-01'").withColumn("value", F.lit(5.0)), path)
    got = read_facts(spark, path, {"period_start": "date", "metric": "string", "value": "double", "added_later": "string"})
    assert sorted(map(tuple, got.collect())) == [(d("2025-01-01"), "x", 1.0, None), (d("2025-02-01"), "x", 5.0, None)]


def test_affected_months(spark):
    got = incremental.affected_periods(spark.createDataFrame([(d("2025-01-01"),)], "period date"))
    assert sorted(r[0] for r in got.collect()) == [d("2025-01-01"), d("2025-02-01"), d("2026-01-01")]


def test_stream_ingest_takes_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = spark.createDataFrame([("2025", "1", "s", 2.0), ("2025", "99", "s", 3.0)], "y string, m string, store string, units double")

    def sink(batch, _):
        ingest.normalise_period(batch, "y", "m").where("period is not null").write.mode("append").parquet(out)

    for _ in range(2):
        frame.write.mode("append").parquet(source)
        incremental.ingest_stream(spark.readStream.schema(frame.schema).parquet(source), sink, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_event_confidence(spark):
    rows = [("comparison", "e", d("2025-01-01"), 2.0, 1.0, 1.0, "LOW", None)]
    facts = spark.createDataFrame(rows, "feature string, entity_id string, period date, current_value double, reference_value double, delta_pct double, comparison_quality string, label_changed boolean")
    assert [(r["rule_id"], r["confidence"]) for r in events.detect(facts).collect()] == [("revenue_up", "MEDIUM")]


def test_peer_counts_equal_pairs_without_making_them(spark):
    """A SKU in two groups, one of an unknown owner, one without a group, NULL SKUs, and a group whose only rival is the target."""
    rows = [("a", "s1", False), ("a", "s2", False), ("a", "s3", True), ("a", "s4", None), ("b", "s1", False), ("b", "s2", False), ("b", "s5", False), ("c", "s6", False), (None, "s7", False), ("a", None, False), ("b", "s5", False), ("d", "s8", True), ("d", "s9", False)]
    df = spark.createDataFrame(rows, "category string, sku string, is_own boolean")
    want = sorted(map(tuple, benchmarking.peers(df, df, ("category",)).groupBy("target").count().collect()))
    assert sorted(map(tuple, benchmarking.peer_counts(df, df, ("category",)).collect())) == want == [("s1", 2), ("s2", 2), ("s3", 2), ("s4", 2), ("s5", 2), ("s8", 1)]
    many = spark.range(20_000).selectExpr("'a' as category", "concat('s', id) as sku", "false as is_own")  # 400 million pairs
    counted = benchmarking.peer_counts(many, many, ("category",)).agg({"n_peers": "sum"}).first()[0]
    assert counted == 20_000 * 19_999
