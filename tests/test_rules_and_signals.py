"""Event rules as tables and the signal feed on hand rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import events, rules, signals
from shelfspark.plans import mart_queries

SF = "/root/testdata/sf0.01"
CONTEXT = {"analysis_run_id": "run_a", "retailer_id": "retailer_a", "source_id": "source_a", "rule_version": "rules_v1"}


def d(text):
    return dt.date.fromisoformat(text)


def compared(spark, source_id="source_a", retailer_id="retailer_a", quality="HIGH", distribution=-0.10):
    rows = [("revenue", 88.0, 100.0, -0.12, None), ("units", 120.0, 100.0, 0.20, None), ("distribution", 0.8 + distribution, 0.80, distribution / 0.8, distribution), ("velocity", 8.0, 10.0, -0.20, None),
            ("weighted_shelf_price_vat", 12.0, 10.0, 0.20, None), ("retailer_margin_pct", 0.17, 0.20, -0.15, -0.03)]
    full = [("run_a", retailer_id, source_id, "rules_v1", "sku", "SKU_1", "CATEGORY_A", c, f"{c}.v1", d("2026-02-01"), d("2025-02-01"), "YOY", quality, now, then, now - then, pct, pp) for c, now, then, pct, pp in rows]
    return spark.createDataFrame(full, "analysis_run_id string, retailer_id string, source_id string, rule_version string, entity_type string, entity_id string, category string, concept string, metric_definition_id string, current_period date, reference_period date, comparison_type string, comparison_quality string, current_value double, reference_value double, delta_abs double, delta_pct double, delta_pp double")


def facts(spark, **kw):
    return rules.comparison_facts(compared(spark, **kw), CONTEXT | {k: v for k, v in kw.items() if k in CONTEXT})


def fired(spark, rows, *specs, context=CONTEXT):
    return rules.detect_events(rows, *rules.rule_tables(spark, specs, "retailer_a", "rules_v1"), context)


def types(df):
    return sorted(r["event_type"] for r in df.collect())


ONE = ("r1", "DISTRIBUTION_LOSS", "DISTRIBUTION", "comparison", ("distribution",), (("delta_pp", "lte", -0.05),), {})


def test_single_features(spark):
    rows = facts(spark)
    assert rows.columns == list(rules.FACT_COLUMNS) and len(rows.columns) == 37
    assert types(fired(spark, rows, ONE)) == ["DISTRIBUTION_LOSS"]
    assert types(fired(spark, rows, (*ONE[:5], (("delta_pp", "lte", -0.2),), {}))) == []
    points = fired(spark, rows, ("m", "MARGIN_PCT_EROSION", "MARGIN_PCT", "comparison", ("retailer_margin_pct",), (("delta_pp", "lte", -0.02),), {})).collect()
    assert [r["delta_pp"] for r in points] == [-0.03] and "retailer_margin_pct.v1" in points[0]["metric_lineage"]
    assert types(fired(spark, rows, ONE, ("p", "PRICE_INCREASE", "PRICE", "comparison", ("weighted_shelf_price_vat",), (("delta_pct", "between", (0.2, 0.3)),), {}))) == ["DISTRIBUTION_LOSS", "PRICE_INCREASE"]


@pytest.mark.parametrize("condition, fires", [
    (("delta_pct", "gt", -0.12), False), (("delta_pct", "gte", -0.12), True), (("delta_pct", "lt", -0.12), False), (("delta_pct", "lte", -0.12), True), (("observed_value", "eq", 88), True), (("observed_value", "in", [1, 88.0]), True),
    (("observed_value", "not_in", [88]), False), (("comparison_quality", "in", ["HIGH", "LOW"]), True), (("comparison_quality", "not_in", ["LOW"]), True), (("percentile", "not_in", [1]), False), (("delta_pp", "lte", 0), False), (("nowhere", "gt", 0), False),
])
def test_operators(spark, condition, fires):
    assert fired(spark, facts(spark), ("r", "SHARE_LOSS", "SHARE", "comparison", ("revenue",), (condition,), {})).count() == int(fires)


def test_all_conditions_and_scope_of_rules(spark):
    rows = facts(spark)
    two = (("delta_pct", "lte", -0.1), ("observed_value", "gt", 90.0))
    assert types(fired(spark, rows, ("r", "SHARE_LOSS", "SHARE", "comparison", ("revenue",), two, {}))) == []
    assert types(fired(spark, rows, (*ONE[:5], (), {}))) == []
    for more in ({"enabled": False}, {"retailer_id": "retailer_b"}, {"rule_version": "rules_v2"}, {"source_id": "source_b"}, {"entity_types": ["store"]}, {"comparison_types": ["MOM"]}, {"required_metrics": ["x.v1"]}):
        assert types(fired(spark, rows, (*ONE[:6], more))) == [], more
    for more in ({"source_id": "source_a"}, {"entity_types": ["sku", "brand"]}, {"comparison_types": ["YOY"]}, {"required_metrics": ["distribution.v1"]}):
        assert types(fired(spark, rows, (*ONE[:6], more))) == ["DISTRIBUTION_LOSS"], more
    assert types(fired(spark, facts(spark, source_id="source_b"), ONE)) == []
    assert fired(spark, rows.limit(0), ONE).count() == 0


def test_composite_rules(spark):
    price = next(r for r in rules.STANDARD if r[1] == "PRICE_INCREASE")
    assert types(fired(spark, facts(spark, distribution=-0.01), price)) == ["PRICE_INCREASE"]
    assert types(fired(spark, facts(spark), price)) == []
    without = facts(spark, distribution=-0.01).where("feature_name <> 'velocity'")
    assert types(fired(spark, without, price)) == []
    row = fired(spark, facts(spark, distribution=-0.01), price).first()
    assert row["feature_name"] == "weighted_shelf_price_vat+velocity+distribution" and row["observed_value"] is None and "velocity_delta_pct" in row["trigger_values"]
    twice = facts(spark, distribution=-0.01)
    assert fired(spark, twice.unionByName(twice), price).count() == 1


def test_labels_confidence_and_candidates(spark):
    rows = [("run_a", "retailer_a", "source_a", d("2026-02-01"), "sku", s, "C", "abc_revenue", now, then) for s, now, then in (("x", "B", "A"), ("y", "B", "B"), ("z", "C", "C"), ("n", "A", None))]
    abc = rules.abc_facts(spark.createDataFrame(rows, "analysis_run_id string, retailer_id string, source_id string, period date, entity_type string, entity_id string, category string, abc_metric string, abc_class string, reference_abc_class string"), CONTEXT)
    specs = [r for r in rules.STANDARD if r[1] in ("ABC_CLASS_CHANGE", "PERSISTENT_C_CLASS")]
    assert sorted((r["event_type"], r["entity_id"], r["current_class"], r["reference_class"]) for r in fired(spark, abc, *specs).collect()) == [("ABC_CLASS_CHANGE", "x", "B", "A"), ("PERSISTENT_C_CLASS", "z", "C", "C")]
    assert [r["confidence"] for r in fired(spark, facts(spark, quality="LOW"), ONE).collect()] == ["MEDIUM"]
    pressure = next(r for r in rules.STANDARD if r[1] == "PRICE_PRESSURE_PATTERN")
    row = fired(spark, facts(spark), pressure).first()
    assert "PRICE_ELASTICITY" in row["hypothesis_candidates"] and "promo_calendar" in row["missing_evidence"] and "cause" not in row.asDict()


def test_benchmark_facts_fire_and_stand_apart_by_scope(spark):
    rows = [("run_a", "retailer_a", "source_a", d("2026-02-01"), "SKU_1", "c", scope, "k", m, 1.0, 1.0, p, 5) for scope in ("BROAD", "DIRECT") for m, p in (("units_per_selling_store", 0.9), ("numeric_distribution", 0.3))]
    marks = rules.benchmark_facts(spark.createDataFrame(rows, "analysis_run_id string, retailer_id string, source_id string, reference_period date, target_entity_id string, category string, benchmark_scope string, benchmark_scope_id string, metric_name string, metric_value double, rank double, percentile double, population_size long"), CONTEXT)
    out = fired(spark, marks, next(r for r in rules.STANDARD if r[1] == "HIGH_VELOCITY_LOW_DISTRIBUTION")).collect()
    assert sorted(r["benchmark_scope"] for r in out) == ["BROAD", "DIRECT"] and {(r["entity_type"], r["entity_id"], str(r["period"])) for r in out} == {("sku", "SKU_1", "2026-02-01")}
    assert rules.benchmark_facts(spark.createDataFrame([], marks.schema).withColumn("metric_name", F.lit("x")), CONTEXT).count() == 0


def test_standard_rules_name_every_type_and_all_fire(spark):
    specs = rules.STANDARD
    assert {r[1] for r in specs} == set(events.EVENT_TYPES) and len(specs) == 27 and {r[2] for r in specs} == set(events.EVENT_FAMILIES)
    assert {r["event_type"] for r in mart_queries._events(spark, SF).select("event_type").distinct().collect()} == set(events.EVENT_TYPES)


def test_identity_of_a_configuration(spark):
    a = rules.config_digest(*rules.rule_tables(spark, rules.STANDARD, "retailer_a", "rules_v1"))
    assert a == rules.config_digest(*rules.rule_tables(spark, rules.STANDARD[::-1], "retailer_a", "rules_v1")) and len(a) == 16
    assert a != rules.config_digest(*rules.rule_tables(spark, rules.STANDARD[1:], "retailer_a", "rules_v1"))
    with_ids = fired(spark, facts(spark), ONE).withColumn("event_config_hash", F.lit(a)).withColumn("event_id", events.event_id(*rules.EVENT_IDENTITY))
    assert len(with_ids.first()["event_id"]) == 24


EVENT = "retailer_id string, source_id string, event_id string, event_type string, event_family string, entity_type string, entity_id string, category string, period date, comparison_type string, input_source string, severity string"


def confirmed(spark, *rows):
    """(id, type, family, SKU, month) of events."""
    return spark.createDataFrame([("retailer_a", "source_a", i, k, f, "sku", s, "category_a", d(p), "YOY", "comparison", "HIGH") for i, k, f, s, p in rows], EVENT)


def ask(**kw):
    return signals.Request("retailer_a", "source_a", **({"date_from": "2026-01-01", "date_to": "2026-01-01", "comparison_mode": "YOY"} | kw))


def told(feed):
    row = feed.status.first()
    return row["status"], row["event_count"], row["surfaced_event_count"], row["limitations"]


HERE = ("a", "MATERIAL_REVENUE_DECLINE", "GROWTH_DECLINE", "sku_a", "2026-01-01")
NO_SCOPE = "event_private_label_scope_not_materialized"


def test_feed_surfaces_classes_and_counts_the_rest(spark):
    df = confirmed(spark, HERE, ("b", "PRICE_PRESSURE_PATTERN", "PATTERN_CANDIDATE", "sku_a", "2026-01-01"), ("c", "PROMO_LIKE_PATTERN", "PATTERN_CANDIDATE", "sku_a", "2026-01-01"))
    out = signals.feed(df, ask())
    assert told(out) == ("PARTIAL", 3, 2, NO_SCOPE)
    assert sorted((r["event_id"], r["signal_type"]) for r in out.rows.collect()) == [("a", "COMMERCIAL_SIGNAL"), ("b", "DETERMINISTIC_PATTERN")]
    assert [tuple(r) for r in out.excluded.collect()] == [("PROMO_LIKE_PATTERN", 1)]
    whole = df.withColumn("private_label_scope", F.lit("INCLUDE"))
    assert told(signals.feed(whole, ask()))[0] == "READY"
    assert [r["event_id"] for r in signals.feed(whole, ask(signal_types=("DETERMINISTIC_PATTERN",))).rows.collect()] == ["b"]


def test_feed_without_surfaced_events(spark):
    out = signals.feed(confirmed(spark, ("p", "ABC_CLASS_CHANGE", "PORTFOLIO", "s", "2026-01-01"), ("q", "PEER_OUTPERFORMANCE", "BENCHMARK", "s", "2026-01-01")), ask())
    assert told(out) == ("NO_SURFACED_SIGNALS", 2, 0, f"{NO_SCOPE},no_surfaced_signals_in_scope") and out.rows.count() == 0
    assert {tuple(r) for r in out.excluded.collect()} == {("ABC_CLASS_CHANGE", 1), ("PEER_OUTPERFORMANCE", 1)}
    assert told(signals.feed(confirmed(spark, (*HERE[:4], "2026-02-01")), ask())) == ("NO_CONFIRMED_EVENTS", 0, 0, f"{NO_SCOPE},no_confirmed_events_in_scope")
    assert told(signals.feed(confirmed(spark, HERE).limit(0), ask())) == ("NO_CONFIRMED_EVENTS", 0, 0, "no_confirmed_events")
    assert told(signals.feed(confirmed(spark, HERE).limit(0), ask(), enabled_rules=0))[3] == "no_enabled_event_rules"
    assert told(signals.feed(None, ask(), spark)) == ("NOT_CONFIGURED", 0, 0, "signal_events_path_not_configured")


def test_feed_scope_and_limits(spark):
    df = confirmed(spark, HERE, ("b", *HERE[1:3], "sku_b", "2026-01-01"), ("o", *HERE[1:4], "2026-02-01"))
    assert [r["event_id"] for r in signals.feed(df, ask(grain_id="sku", entity_ids=("sku_b",))).rows.collect()] == ["b"]
    assert [r["event_id"] for r in signals.feed(df, ask(grain_id="sku", entity_filters={"sku": ("sku_a",)})).rows.collect()] == ["a"]
    assert [(r["event_id"], r["place"]) for r in signals.feed(df, ask(limit=1)).rows.collect()] == [("a", 1)] and told(signals.feed(df, ask(limit=1)))[1:3] == (2, 1)
    assert signals.feed(df, ask(comparison_mode="MOM")).rows.count() == 0
    scopes = confirmed(spark, HERE).withColumn("private_label_scope", F.lit("INCLUDE")).unionByName(confirmed(spark, ("x", *HERE[1:])).withColumn("private_label_scope", F.lit("EXCLUDE")))
    assert [r["event_id"] for r in signals.feed(scopes, ask(private_label_scope="EXCLUDE")).rows.collect()] == ["x"]


@pytest.mark.parametrize("request_, limitation", [
    ({"private_label_scope": "EXCLUDE"}, NO_SCOPE), ({"entity_filters": {"manufacturer": ("m",)}}, "event_manufacturer_scope_not_materialized"), ({"period_mode": "AVAILABLE_MONTH_SET"}, "signals_available_month_set_unsupported"),
    ({"period_mode": "DATE_RANGE"}, "signals_date_range_unsupported"), ({"period_mode": "FULL_AVAILABLE_HISTORY"}, "signals_full_history_unsupported"), ({"entity_filters": {"volume": (0.5,)}}, "event_volume_scope_not_materialized"),
])
def test_feed_is_closed_to_what_it_cannot_answer(spark, request_, limitation):
    out = signals.feed(confirmed(spark, HERE), ask(**request_))
    assert told(out) == ("NO_SURFACED_SIGNALS", 0, 0, limitation) and out.rows.count() == 0 and out.excluded.count() == 0


class Memory:
    """A build that keeps its datasets in memory."""

    def __init__(self):
        self.held, self.written = {}, []

    def has(self, name):
        return name in self.held

    def read(self, name):
        return self.held[name]

    def dataset(self, name, make):
        if name not in self.held:
            self.held[name] = make()
            self.written.append(name)
        return self.held[name]


def test_rules_run_only_where_no_events_are_stored(spark):
    build, detect = Memory(), lambda rows: fired(spark, rows, ONE)
    first = signals.stored_events(build, lambda: facts(spark), detect)
    assert [r["event_source"] for r in first.collect()] == ["EVENT_FACTS_RUNTIME_MATERIALIZATION"] and build.written == ["event_facts", "events"]
    again = signals.stored_events(build, lambda: 1 / 0, lambda rows: 1 / 0)
    assert [r["event_source"] for r in again.collect()] == ["CONFIRMED_EVENT_OUTPUT"]
