"""The metric catalog, category positions, typing and aliases on hand rows."""

import datetime as dt

import pytest

from shelfspark.operators import catalog, ingest, positions


def d(text):
    return dt.date.fromisoformat(text)


def private(spark, *changes):
    base = {
        "retailer_id": "r", "source_id": None, "metric_concept": "revenue", "metric_definition_id": "m", "metric_definition_version": "v1", "metric_config_hash": None, "rule_version": None, "display_label": None, "grain_support": ["sku"],
        "period_support": ["month"], "comparison_support": ["NONE"], "private_label_scope_support": ["INCLUDE"], "range_strategy": "sum_available_periods", "availability_status": "AVAILABLE", "sort_order": 1,
    }
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], catalog.PRIVATE)


def public(spark, *rows):
    return spark.createDataFrame(list(rows) or [("revenue", "Revenue", ["NONE", "YOY"], "sum_available_periods")], catalog.PUBLIC)


def facts(spark):
    row = ("r", "s", "m", "v1", "h1", "rules", "revenue", "sum_available_periods")
    return spark.createDataFrame([row, row], "retailer_id string, source_id string, metric_definition_id string, metric_definition_version string, metric_config_hash string, rule_version string, metric_concept string, range_aggregation_strategy string")


@pytest.mark.parametrize("change, request_, want", [
    ({}, {}, []), ({"metric_config_hash": "h1", "rule_version": "rules"}, {}, []), ({"metric_config_hash": "h2"}, {}, ["metric_definition_not_in_catalog"]), ({"rule_version": "other"}, {}, ["metric_definition_not_in_catalog"]),
    ({"metric_definition_version": "v2"}, {}, ["metric_definition_not_in_catalog"]), ({"source_id": "s"}, {}, []), ({"source_id": "t"}, {}, ["metric_definition_not_in_catalog"]), ({}, {"grain_id": "brand"}, ["metric_not_supported_for_grain"]),
    ({}, {"comparison_mode": "YOY"}, ["metric_not_supported_for_comparison"]), ({"comparison_support": []}, {"comparison_mode": "YOY"}, []), ({}, {"period_grain": "week"}, ["metric_not_supported_for_period_grain"]),
    ({}, {"private_label_scope": "ONLY"}, ["metric_not_supported_for_private_label_scope"]), ({"range_strategy": "period_only"}, {}, ["catalog_range_strategy_mismatch"]), ({"availability_status": "NOT_AVAILABLE"}, {}, ["metric_not_available"]),
    ({}, {"metric_concepts": ("revenue", "units")}, ["metric_not_in_catalog"]),
])
def test_limitations(spark, change, request_, want):
    own = catalog.effective_catalog(public(spark), private(spark, change), "r", "s")
    request = catalog.Request("r", "s", **({"grain_id": "sku"} | request_))
    assert sorted(r["issue_code"] for r in catalog.catalog_limitations(facts(spark), own, request).collect()) == want


def test_two_entries_for_a_definition_are_ambiguous(spark):
    own = catalog.effective_catalog(public(spark), private(spark, {}, {"metric_config_hash": "h1"}), "r", "s")
    assert [tuple(r) for r in catalog.catalog_limitations(facts(spark), own, catalog.Request("r", "s", "sku")).collect()] == [("ambiguous_catalog_entry", "m", "revenue")]


def test_catalog_issues(spark):
    rows = private(spark, {}, {}, {"metric_concept": "nothing", "metric_definition_id": "n"}, {"metric_definition_id": "g", "grain_support": ["shelf"], "comparison_support": ["ODD"], "period_support": ["week"]}, {"metric_concept": "distribution", "metric_definition_id": "d"})
    held = public(spark, ("revenue", "a", ["NONE"], "sum_available_periods"), ("revenue", "b", ["NONE"], "sum_available_periods"), ("distribution", "c", ["NONE"], "period_only"))
    got = {(r["issue_code"], r["metric_definition_id"]) for r in catalog.catalog_issues(held, rows).collect()}
    assert got == {("duplicate_public_metric_concept", None), ("duplicate_private_metric_identity", "m"), ("private_override_unknown_concept", "n"), ("unknown_grain", "g"), ("unknown_period_grain", "g"), ("unsupported_comparison_mode", "g"), ("private_override_expands_period_only_range", "d")}


def test_labels_and_scopes_of_entries(spark):
    rows = private(spark, {"display_label": "Own"}, {"metric_definition_id": "n", "source_id": "t"}, {"metric_definition_id": "o", "retailer_id": "q"})
    assert [(r["metric_definition_id"], r["label"]) for r in catalog.effective_catalog(public(spark), rows, "r", "s").collect()] == [("m", "Own")]
    assert {r["label"] for r in catalog.effective_catalog(public(spark), rows, "r").collect()} == {"Own", "Revenue"}


def test_positions_of_hand_rows(spark):
    month = d("2026-01-01")
    parent = lambda c: f'{{"category": "{c}", "manufacturer": "m"}}'
    rows = [(month, "sku", s, parent(c), b, v) for s, c, b, v in (
        ("a", "c", "revenue", 80.0), ("b", "c", "revenue", 10.0), ("c", "c", "revenue", 10.0), ("z", "c", "revenue", 0.0), ("n", "c", "revenue", None),
        ("a", "c", "units", 5.0), ("b", "c", "units", -1.0), ("q", "e", "units", 0.0),
    )] + [(month, "category", "c", "{}", "revenue", 100.0), (month, "category", "e", "{}", "revenue", 300.0), (month, "store", "t", "{}", "revenue", 1.0)]
    df = spark.createDataFrame(rows, "period_start date, grain_id string, entity_id string, parent_entity_ids string, metric_concept string, value double")
    got = {(r["concept_id"], r["universe"], r["entity_id"]): r for r in positions.positions(positions.month_set(df, ("2026-01-01", "2026-02-01"))).collect()}
    rank = lambda *k: (got[k]["rank"], got[k]["tie_count"], got[k]["population"])
    assert rank("sku_rank_revenue", "c", "a") == (1, 1, 4) and rank("sku_rank_revenue", "c", "c") == (2, 2, 4) and rank("sku_rank_revenue", "c", "z") == (4, 1, 4)
    assert rank("category_rank_revenue", "ALL", "e") == (1, 1, 2) and ("sku_rank_revenue", "c", "n") not in got
    assert got["entity_revenue_share", "c", "b"]["share"] == 0.1 and got["entity_cumulative_revenue_share", "c", "c"]["cumulative_share"] == 1.0
    assert [got["sku_abc_revenue", "c", s]["abc_class"] for s in "abcz"] == ["A", "B", "C", "C"]
    refused = got["sku_abc_units", "c", "a"]
    assert (refused["abc_class"], refused["limitation"]) == (None, "abc_negative_contribution_semantics_unsupported")
    assert got["sku_abc_units", "e", "q"]["limitation"] == "abc_positive_universe_required" and got["entity_units_share", "e", "q"]["share"] is None
    assert {k[0] for k in got} <= {*positions.RANKS, *positions.SHARES, *positions.CLASSES}


def test_typing_keeps_rows_and_tells_flaws(spark):
    rows = [(1, "s", "12", "1.5", "true"), (2, " ", "12.5", "x", "no way"), (3, None, None, None, None), (4, "t", " 7 ", "", "false")]
    df = spark.createDataFrame(rows, "source_row_number long, sku string, n string, v string, own string")
    out, issues = ingest.typed(df, ("sku", "absent"), ("n",), ("v",), ("own",), ("sku",))
    assert [tuple(r) for r in out.orderBy("source_row_number").collect()] == [(1, "s", 12, 1.5, True), (2, " ", None, None, None), (3, None, None, None, None), (4, "t", 7, None, False)]
    assert {tuple(r) for r in issues.collect()} == {("blank_required_string", "sku", 2), ("invalid_integer_value", "n", 2), ("invalid_numeric_value", "v", 2), ("blank_required_string", "sku", 3), ("null_integer_value", "n", 3)}
    _, strict = ingest.typed(df, numbers=("v",), required=("v",))
    assert {tuple(r) for r in strict.collect()} == {("invalid_numeric_value", "v", 2), ("null_numeric_value", "v", 3), ("null_numeric_value", "v", 4)}
    assert {tuple(r) for r in ingest.value_issues(df, "own", {"true": "1", "false": "0"}).collect()} == {("unknown_value", "own", "no way", 2)}


def test_mapping_and_alias_issues(spark):
    rows = ingest.mapping_issue_rows(spark, ["a", "b", "c", "d"], {"a": "sku", "b": "sku", "x": "odd"}, ("sku", "units"), ("sku", "units"), ("d",))
    assert {(r["issue_code"], r["subject"]) for r in rows.collect()} == {("unknown_source_column", "x"), ("unknown_canonical_target", "odd"), ("missing_required_mapping", "units"), ("duplicate_target_mapping", "sku"), ("unmapped_source_column", "c")}
    aliases = spark.createDataFrame([(1, None, None, None, "s1", "t"), (2, None, None, None, "s1", "u"), (3, "r", None, None, "s2", "t"), (4, "q", None, None, "s3", "t")], "place int, retailer_id string, source_id string, rule_version string, source_store string, canonical_store string")
    assert [tuple(r) for r in ingest.alias_issues(aliases).collect()] == [("conflicting_store_alias", "s1")]
    own = ingest.scoped_aliases(aliases, "r", "s", "v")
    assert {tuple(r) for r in own.collect()} == {("s1", "t"), ("s2", "t")}
    one, two = (ingest.alias_version(a).first() for a in (own, own.repartition(3).orderBy("canonical_store")))
    assert one == two and one["n_aliases"] == 2 and one != ingest.alias_version(own.where("source_store = 's1'")).first()
