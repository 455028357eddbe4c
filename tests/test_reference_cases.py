"""Hand examples with literal answers: comparison quality and points, portfolio classes, definitions, gates, events, revisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import benchmarking, definitions, economics, events, governance, mart, periods, portfolio


def d(text):
    return dt.date.fromisoformat(text)


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1, rows
    return rows[0]


@pytest.fixture
def months(spark):
    rows = [(d(p), "a", v) for p, v in (("2025-01-01", 100.0), ("2026-01-01", 150.0), ("2026-02-01", 120.0), ("2026-04-01", 90.0))]
    return spark.createDataFrame(rows, "period date, k string, revenue double").withColumn("revenue_share", F.col("revenue"))


def test_comparison_quality_by_kind(months):
    get = lambda kind, p, **m: one(periods.compare(months, ("k",), "revenue", kind, **m), period=d(p))
    yoy = get("YOY", "2026-01-01")
    assert (yoy["comparison_quality"], yoy["month_gap"], yoy["is_contiguous"], yoy["same_calendar_month"], yoy["delta_pct"], yoy["delta_pp"]) == ("HIGH", 12, False, True, 0.5, None)
    assert get("MOM", "2026-02-01")["comparison_quality"] == "HIGH"
    assert get("PREVIOUS_AVAILABLE", "2026-04-01")["comparison_quality"] == "MEDIUM"
    assert get("PREVIOUS_AVAILABLE", "2026-02-01")["comparison_quality"] == "LOW"
    assert get("CUSTOM", "2026-01-01", custom="2026-04-01")["month_gap"] == -3
    assert [r["period"] for r in periods.compare(months, ("k",), "revenue", "MOM").collect()] == [d("2026-02-01")]
    issues = periods.comparison_issues(periods.compare(months, ("k",), "revenue", "MOM"), months, "MOM").collect()
    assert {(r["period"], r["issue_code"]) for r in issues} == {(d(p), "MISSING_COMPARISON_BASE") for p in ("2025-01-01", "2026-01-01", "2026-04-01")}


def test_points_are_plain_differences(months):
    assert one(periods.compare(months, ("k",), "revenue_share", "YOY"), period=d("2026-01-01"))["delta_pp"] == 50.0


def test_portfolio_classes(spark):
    rows = [("c", "x", 90.0), ("c", "y", 10.0), ("c", "z", 0.0), ("n", "x", 5.0), ("n", "y", -1.0), ("o", "x", 0.0)]
    df = spark.createDataFrame(rows, "category string, maker string, v double")
    got = {(r["category"], r["maker"]): (r["abc_class"], r["limitation"]) for r in portfolio.abc_portfolio(df, "v", ("category",), "maker").collect()}
    refused = (None, "abc_negative_values_not_applicable")
    assert got == {("c", "x"): ("A", None), ("c", "y"): ("C", None), ("c", "z"): ("C", None), ("n", "x"): refused, ("n", "y"): refused, ("o", "x"): ("C", None)}


def test_contribution_scopes(spark):
    df = spark.createDataFrame([(d("2026-01-01"), "c", "b", 1.0)], "period date, category string, brand string, units double")
    with pytest.raises(ValueError):
        portfolio.contribution(df, "brand", "category", "units", "2026-01-01", "2025-01-01")
    row = portfolio.contribution(df.withColumn("units", F.col("units").cast("decimal(18,2)")), "category", "brand", "units", "2026-01-01", "2025-01-01").first()
    assert (row["delta_abs"], row["contribution"], row["flags"], row["state"]) == (1.0, 1.0, "", "READY")


def test_definition_order_and_missing(spark):
    D = definitions.Definition
    a = D("a", "a", "derived_ratio", "network", numerator="b", denominator="c")
    b, c = D("b", "b", "sum", "network", column="units"), D("c", "c", "derived_ratio", "network", numerator="b", denominator="b")
    order, missing = definitions.resolve([a, b, c, D("x", "x", "derived_ratio", "network", numerator="none", denominator="b")])
    assert [m.name for m in order] == ["b", "c", "a"] and missing == ["x"]
    assert len(definitions.standard_definitions()) == 73


def test_definitions_on_hand_rows(spark):
    rows = [(d("2026-01-01"), "k", "m", "b", "s1", "t1", 2.0, 20.0, 18.0, 6.0, 10.0, 5.0), (d("2026-01-01"), "k", "m", "b", "s1", "t2", -1.0, -10.0, -9.0, -3.0, 10.0, None), (d("2026-01-01"), "k", "m", "b", "s2", "t2", 3.0, 60.0, 54.0, 9.0, 20.0, 15.0)]
    df = spark.createDataFrame(rows, "period date, category string, manufacturer string, brand string, sku string, store string, units double, revenue_vat double, revenue_net double, margin_abs double, shelf_price_vat double, input_price_vat double")
    rows, issues = definitions.calculate(df, definitions.standard_definitions())
    got = {(r["entity_id"], r["concept"]): r["metric_value"] for r in rows.where("entity_type = 'sku'").collect()}
    assert issues == []
    assert (got["s1", "units"], got["s1", "store_count"], got["s1", "selling_store_count"], got["s1", "active_store_count"], got["s1", "distribution"]) == (1.0, 2.0, 1.0, 2.0, 0.5)
    assert got["s1", "weighted_shelf_price_vat"] == 10.0 and got["s2", "units_per_selling_store"] == 3.0 and got["s1", "retailer_margin_pct"] == pytest.approx(3 / 9)


def test_filter_grain():
    assert definitions.effective_grain("network", {"brand": ("b",), "category": ("c",)}) == ("brand", False)
    assert definitions.effective_grain("network", {"sku": ("s",), "store": ("t",)}) == ("store", True)
    assert definitions.effective_grain("category", {}) == ("category", False)
    assert definitions.effective_grain("sku", {"category": ("c",)}) == ("sku", False)
    assert definitions.effective_grain("brand", {"store": ("t",)}) == ("store", True)
    assert definitions.effective_grain("store", {"category": ("c",)}) == ("store", True)
    assert definitions.effective_grain("store", {"store": ("t",)}) == ("store", False)
    assert definitions.effective_grain("network", {"package": ("p",)}) == ("network", True)


@pytest.mark.parametrize(
    "strategy,rows,value,code",
    [
        (mart.SUM, [(1.0, None, None, None), (2.0, None, None, None)], 3.0, None),
        (mart.SUM, [(1.0, None, None, None), (None, None, None, None)], None, "additive_value_missing"),
        (mart.RATIO, [(0.5, 1.0, 2.0, None), (0.1, 1.0, 10.0, None)], 2 / 12, None),
        (mart.WEIGHTED, [(0.5, 1.0, None, None)], None, "range_components_missing"),
        (mart.RECOMPUTE, [(0.5, 1.0, 0.0, None)], None, "zero_range_denominator"),
        (mart.SHARE, [(0.5, 1.0, 2.0, "category"), (0.5, 1.0, 2.0, "network")], None, "share_scope_missing_or_mixed"),
        (mart.SHARE, [(0.5, 1.0, 2.0, "category"), (0.5, 2.0, 4.0, "category")], 0.5, None),
        (mart.PERIOD_ONLY, [(0.5, None, None, None)], None, "range_aggregation_period_only"),
        (mart.UNSUPPORTED, [(0.5, None, None, None)], None, "range_aggregation_unsupported"),
    ],
)
def test_range_strategies(spark, strategy, rows, value, code):
    schema = "value double, numerator double, denominator double, share_scope string"
    df = spark.createDataFrame(rows, schema).selectExpr("'sku' as entity_type", "'s' as entity_id", "'c' as category", "'m' as manufacturer", "'x' as metric", f"'{strategy}' as range_strategy", "*")
    got = mart.range_aggregate(df).first()
    assert got["limitation"] == code and (got["value"] is None if value is None else got["value"] == pytest.approx(value))


def test_tax_rules_of_each_row(spark):
    rules = economics.tax_rules(spark, (("a", "2025-01-01", "2025-12-31", 0.2, "G"), ("b", "2025-06-01", None, 0.1, "G"), ("c", "2025-01-01", None, 1.5, "H")))
    rows = spark.createDataFrame([(d(p), g) for p, g in (("2025-01-01", "G"), ("2025-07-01", "G"), ("2026-01-01", "G"), ("2024-01-01", "G"), ("2025-01-01", "H"), ("2025-01-01", None))], "period date, category_group string")
    got = [(r["tax_rule_id"], r["tax_rate"], r["tax_issue"]) for r in economics.resolve_tax(rows, rules).orderBy("category_group", "period").collect()]
    assert sorted(got, key=str) == sorted([(None, None, "no_matching_tax_rule"), (None, None, "no_matching_tax_rule"), ("a", 0.2, None), (None, None, "multiple_matching_tax_rules"), ("b", 0.1, None), ("c", None, "invalid_tax_rate")], key=str)


def test_issue_rows_and_gates(spark):
    issues = governance.mapping_issues(spark, ["a", "b"], {"a": "units", "b": "units", "z": "odd"}, ("period",), ("units", "period"))
    assert {(r["issue_code"], r["subject"]) for r in issues.collect()} == {("UNKNOWN_SOURCE_COLUMN", "z"), ("UNKNOWN_TARGET_COLUMN", "odd"), ("MISSING_REQUIRED_TARGET", "period"), ("DUPLICATE_TARGET", "units")}
    with pytest.raises(ValueError):
        governance.require(issues)
    rows = spark.createDataFrame([("r",)], "rule_id string")
    assert governance.gated(rows, issues).count() == 0 and governance.gated(rows, issues.limit(0)).count() == 1
    signs = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, -2.0), (3, 1.0, -2.0), (4, -1.0, 2.0)], "source_row_number long, units double, revenue_vat double")
    assert sorted((r["source_row_number"], r["issue_code"]) for r in governance.sign_issues(signs).collect()) == [(2, "BUSINESS_EXCEPTION"), (3, "SUSPICIOUS"), (4, "SUSPICIOUS")]
    prices = spark.createDataFrame([(1, 1.0), (2, None)], "source_row_number long, shelf_price_vat double")
    assert sorted((r["field"], r["source_row_number"]) for r in governance.price_issues(prices).collect()) == [("input_price_vat", None), ("shelf_price_vat", 2)]


def test_scope_and_applicable_rules(spark):
    rules = spark.createDataFrame([("a", True, "r", "s", "v1"), ("b", True, "r", None, "v1"), ("c", False, "r", None, "v1"), ("d", True, "q", None, "v1"), ("e", True, "r", "t", "v1"), ("f", True, "r", None, "v2")], "rule_id string, enabled boolean, retailer_id string, source_id string, rule_version string")
    assert sorted(r["rule_id"] for r in governance.applicable(rules, "r", "s", "v1").collect()) == ["a", "b"]
    assert sorted(r["rule_id"] for r in governance.in_context(rules.withColumn("analysis_run_id", F.col("rule_version")), "r", "s", "v1").collect()) == ["a"]


def test_event_identity_depends_on_context(spark):
    rows = spark.createDataFrame([("revenue_up", "MATERIAL_REVENUE_GROWTH", "e", d("2026-01-01"))], "rule_id string, event_type string, entity_id string, period date")
    ids = {events.identified(rows, run, retailer, source, version).first()["event_id"] for run, retailer, source, version in (("r", "a", "s", "v1"), ("r", "b", "s", "v1"), ("r", "a", "t", "v1"), ("r", "a", "s", "v2"), ("q", "a", "s", "v1"))}
    assert len(ids) == 5


def test_event_duplicates_vocabulary_and_scope(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "x"), ("2", "y")], "event_id string, label string")
    assert sorted((r["event_id"], r["label"], r["conflict"]) for r in events.deduplicated(rows, ("label",)).collect()) == [("1", "x", False), ("2", "x", True)]
    rules = spark.createDataFrame([("a", "SHARE_GAIN", "SHARE"), ("b", "ODD", "SHARE"), ("c", "SHARE_LOSS", None), ("c", "SHARE_LOSS", "SHARE")], "rule_id string, event_type string, event_family string")
    assert {(r["rule_id"], r["issue_code"]) for r in events.vocabulary_issues(rules).collect()} == {("b", "UNKNOWN_EVENT_TYPE"), ("c", "UNKNOWN_EVENT_FAMILY"), ("c", "DUPLICATE_EVENT_RULE_ID")}
    assert len(events.EVENT_TYPES) == 27 and len(events.EVENT_FAMILIES) == 9
    assert events.scope_limitations(["entity_type", "entity_id"], {"category": ("c",), "sku": ("s",)}, grain="sku", private_label_scope="ONLY") == ("event_private_label_scope_not_materialized", "event_category_scope_not_materialized")


def test_families_and_patterns(spark):
    rows = [(d(p), "e", *v) for p, v in (("2025-01-01", (100.0, 100.0, 10.0, 0.5, 0.2)), ("2026-01-01", (105.0, 120.0, 9.0, 0.6, 0.2)))]
    wide = spark.createDataFrame(rows, "period date, entity_id string, revenue_net double, units double, avg_shelf_price double, numeric_distribution double, margin_pct double")
    compared = periods.compare_metrics(wide, ("entity_id",), ("revenue_net", "units", "avg_shelf_price", "numeric_distribution", "margin_pct"), "YOY")
    assert sorted((r["event_type"], r["event_family"]) for r in events.detect_families(compared).collect()) == [("DISTRIBUTION_GAIN", "DISTRIBUTION"), ("MATERIAL_UNITS_GROWTH", "GROWTH_DECLINE"), ("PRICE_DECREASE", "PRICE")]
    assert [r["event_type"] for r in events.patterns(compared).collect()] == ["PROMO_LIKE_PATTERN"]


def products(spark):
    """Two competitors and an own product of a group, one competitor without price and one of another group."""
    rows = [
        ("c", "own", True, "still", "b", "MID", "pet", 5.0, 2.0, 2.0), ("c", "x", False, "still", "b", "MID", "pet", 9.0, 3.0, 3.0), ("c", "y", False, "still", "b", "MID", "pet", 5.0, None, None),
        ("c", "z", False, "still", None, "MID", "pet", 1.0, 4.0, 4.0), ("d", "alone", False, "still", "b", "MID", "pet", 1.0, 4.0, 4.0),
    ]
    return spark.createDataFrame(rows, "category string, sku string, is_own boolean, carbonation string, volume_band string, price_segment string, package string, units double, weighted_shelf_price_vat double, price double")


def test_benchmark_features_of_hand_rows(spark, monkeypatch):
    monkeypatch.setattr(benchmarking.pooled, "__defaults__", (("units",), 2, benchmarking.DIRECT))
    got = {(r["scope"], r["metric"], r["sku"]): (r["rank"], r["percentile"], r["population_size"]) for r in benchmarking.benchmark_features(products(spark), ("units", "weighted_shelf_price_vat")).collect()}
    assert got["BROAD", "units", "own"] == (2, 0.5, 4) and got["BROAD", "units", "x"] == (1, 1.0, 3)
    assert got["BROAD", "weighted_shelf_price_vat", "own"] == (1, 1.0, 4) and got["BROAD", "weighted_shelf_price_vat", "y"] == (None, None, 3)
    assert got["TOP_N", "units", "z"] == (3, 0.0, 3) and got["TOP_N", "units", "x"] == (1, 1.0, 2) and got["TOP_N", "units", "own"] == (2, 0.25, 3)
    assert got["DIRECT", "units", "own"] == (2, 0.25, 3) and ("DIRECT", "units", "z") not in got
    assert not [k for k in got if k[2] == "alone"]


def test_pool_prices_of_hand_rows(spark, monkeypatch):
    monkeypatch.setattr(benchmarking.pooled, "__defaults__", (("units",), 2, benchmarking.DIRECT))
    got = {(r["scope"], r["sku"]): (r["peer_median_price"], r["price_vs_peer_median_abs"], r["price_index_to_peer_median"], r["population_size"], r["issues"]) for r in benchmarking.pool_prices(products(spark)).collect()}
    assert got["BROAD", "own"] == (3.5, -1.5, pytest.approx(100 * 2 / 3.5), 3, "")
    assert got["BROAD", "x"] == (4.0, -1.0, 75.0, 2, "") and got["BROAD", "z"] == (3.0, 1.0, pytest.approx(400 / 3), 2, "")
    assert got["BROAD", "y"] == (None, None, None, 2, "EMPTY_DIRECT_PEER_GROUP,ZERO_PEER_MEDIAN")
    assert got["TOP_N", "x"] == (None, None, None, 1, "EMPTY_DIRECT_PEER_GROUP,ZERO_PEER_MEDIAN")
    assert got["DIRECT", "own"] == (3.0, -1.0, pytest.approx(200 / 3), 2, "")


def test_revisions_and_builds(spark):
    builds = spark.createDataFrame([("r", "b1", "APPROVED"), ("r", "b2", "DRAFT"), ("q", "b3", "DRAFT"), ("p", "b4", "DRAFT"), ("p", "b5", "DRAFT")], "retailer_id string, mart_build_id string, status string")
    assert {r["retailer_id"]: (r["mart_build_id"], r["state"]) for r in governance.resolve_build(builds).collect()} == {"r": ("b1", "RESOLVED"), "q": ("b3", "RESOLVED"), "p": (None, "AMBIGUOUS_BUILD")}
    facts = spark.createDataFrame([("r", "s", d("2026-01-01"), 1), ("r", "s", d("2026-01-01"), 2), ("r", "s", d("2026-02-01"), 2)], "retailer_id string, source_id string, period date, revision int")
    assert [r["period"] for r in governance.revision_conflicts(facts).collect()] == [d("2026-01-01")]
    active = spark.createDataFrame([("r", "s", 2, d("2026-01-01"), True), ("r", "s", 1, d("2026-01-01"), False)], "retailer_id string, source_id string, revision int, period date, is_active boolean")
    assert sorted((r["period"], r["revision"]) for r in governance.inactive_facts(facts, active).collect()) == [(d("2026-01-01"), 1), (d("2026-02-01"), 2)]


def test_stored_records_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "universe")
    rows = spark.createDataFrame([("r", d("2026-01-01"), "t1"), ("r", d("2026-02-01"), "t2")], "retailer_id string, period date, store string")
    governance.write_governed(rows, path, ("retailer_id", "period"))
    governance.write_governed(rows.where("store = 't2'").withColumn("store", F.lit("t3")), path, ("retailer_id", "period"))
    assert sorted(r["store"] for r in spark.read.parquet(path).collect()) == ["t1", "t3"]
    governance.canonical_write(rows, str(tmp_path / "c"), {"period": "date", "store": "string", "volume_l": "double"})
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["period", "store", "volume_l"]
