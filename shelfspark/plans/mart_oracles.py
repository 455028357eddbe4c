"""SQL for the queries of the stored mart, event rules, the feed, pools, ingestion and lineage."""

from __future__ import annotations

from ..operators.definitions import config_hash, standard_definitions
from .oracles import _ACTIVE, _NUM, CUR, GRAINS, STORES, SUMS, U, _PRODUCTS, abc, c, compare, e, grain, have, r, s

HASH = config_hash(standard_definitions())
_WINDOW = "period_start BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'"
_PARENTS = (("brand", "brand"), ("canonical_product_id", "sku"), ("canonical_store_id", "store"), ("category", "category"), ("manufacturer", "manufacturer"))
_SHELF, _INPUT = "units > 0 AND shelf_price_vat IS NOT NULL", "units > 0 AND input_price_vat IS NOT NULL"


def _total(x: str, where: str = "true") -> str:
    return f"CAST(sum(CASE WHEN {where} THEN CAST({x} AS DECIMAL(24,8)) END) AS DOUBLE)"


def _wide(name: str) -> str:
    keys = f"period{', ' + GRAINS[name] if GRAINS[name] else ''}"
    return f"""w_{name} AS (SELECT w.*, active_stores FROM (SELECT {keys}, {s('revenue_vat')} AS revenue_vat, {s('revenue_net')} AS revenue_net, {s(U)} AS units, {s('margin_abs')} AS margin_abs, {_total('margin_abs')} AS mn, {_total('revenue_net')} AS md,
 {_total('shelf_price_vat * units', _SHELF)} AS sn, {_total('units', _SHELF)} AS sd, {_total('input_price_vat * units', _INPUT)} AS pn, {_total('units', _INPUT)} AS pd, count(DISTINCT store) AS stores, {STORES} AS selling_stores,
 count(DISTINCT CASE WHEN units > 0 THEN sku END) AS skus, count(DISTINCT CASE WHEN units > 0 THEN brand END) AS brands, count(DISTINCT CASE WHEN units > 0 THEN category END) AS categories FROM e GROUP BY {keys}) w JOIN act USING (period))"""


def _facts() -> str:
    null, out = "CAST(NULL AS DOUBLE)", []
    for g, keys in GRAINS.items():
        held = keys.split(", ") if keys else []
        entity = held[-1] if held else "'ALL'"
        parents = "concat_ws(', ', " + ", ".join(f"'\"{k}\": \"' || {c} || '\"'" for k, c in _PARENTS if c in held) + ")" if held else "''"
        by = lambda n, d, a, b: (f"{n} / nullif({d}, 0)", n, d, a, b)
        rows = [(k, (c, null, null, None, None), "sum", "'sum_available_periods'") for k, c in (("revenue_vat", "revenue_vat"), ("revenue", "revenue_net"), ("units", "units"), ("retailer_margin_abs", "margin_abs"))]
        held_parts = lambda n, d, st: f"CASE WHEN {n} IS NOT NULL AND {d} IS NOT NULL THEN '{st}' ELSE 'period_only' END"
        rows += [("retailer_margin_pct", by("mn", "md", "margin_abs", "revenue_net"), "ratio_of_sums", held_parts("mn", "md", "ratio_of_sums"))]
        rows += [(k, by(n, d, None, None), "weighted_average", held_parts(n, d, "weighted_ratio_of_sums")) for k, n, d in (("weighted_shelf_price_vat", "sn", "sd"), ("weighted_input_price_vat", "pn", "pd"))]
        count = lambda k, c: (k, (f"CAST({c} AS DOUBLE)", null, null, None, None), "distinct_count", "'period_only'")
        if g in ("category", "manufacturer", "brand", "sku"):
            rows += [count("store_count", "stores"), count("selling_store_count", "selling_stores"), count("active_store_count", "active_stores")]
            pairs = (("distribution", "selling_stores", "selling_store_count", "active_stores", "active_store_count"), ("units_per_selling_store", "units", "units", "selling_stores", "selling_store_count"), ("revenue_per_selling_store", "revenue_net", "revenue", "selling_stores", "selling_store_count"), ("margin_per_selling_store", "margin_abs", "retailer_margin_abs", "selling_stores", "selling_store_count"))
            rows += [(k, by(f"CAST({n} AS DOUBLE)", f"CAST({d} AS DOUBLE)", f"{g}_{a}", f"{g}_{b}"), "derived_ratio", "'period_only'") for k, n, a, d, b in pairs]
        if g == "store":
            rows += [count("assortment_sku_count", "skus"), count("assortment_brand_count", "brands"), count("assortment_category_count", "categories")]
        text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
        nulls = lambda *names: ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)
        out += [
            f"""SELECT 'retailer_a' AS retailer_id, 'source_a' AS source_id, 'run_a' AS analysis_run_id, 'INCLUDE' AS private_label_scope, 'month' AS period_grain, period AS period_start, last_day(period) AS period_end, strftime(period, '%Y-%m-%d') AS business_period_id,
 '{g}' AS grain_id, {entity} AS entity_id, '{{' || {parents} || '}}' AS parent_entity_ids, '{k}' AS metric_concept, '{g}_{k}' AS metric_name, '{g}.{k}.v1' AS metric_definition_id, 'v1' AS metric_definition_version, '{HASH}' AS metric_config_hash,
 {nulls('semantic_family', 'semantic_compatibility_version')}, false AS cross_retailer_comparable, {v} AS value, {n} AS numerator_value, {dd} AS denominator_value, {nulls('business_rule_id', 'denominator_universe_type', 'store_alias_mapping_version')},
 {text(a)} AS numerator_metric_name, {text(b)} AS denominator_metric_name, '{kind}' AS aggregation, {strategy} AS range_aggregation_strategy, {nulls('share_scope')}, 'rules_v1' AS rule_version, 'valid' AS quality_status, {nulls('quality_flags')} FROM w_{g}"""
            for k, (v, n, dd, a, b), kind, strategy in rows
        ]
    return " UNION ALL ".join(out)


_MART = f"{_ACTIVE}, {', '.join(_wide(g) for g in GRAINS)}, mart AS ({_facts()})"
_NAMES = ("revenue", "units", "retailer_margin_abs", "retailer_margin_pct", "weighted_shelf_price_vat", "category_revenue_share", "distribution", "velocity")
_PROD = f"""{_PRODUCTS}, act AS (SELECT {STORES} AS active_stores FROM e WHERE period = {CUR}),
 pr AS (SELECT prod.category, prod.sku, coalesce(prod.is_own, false) AS is_own, prod.carbonation, prod.package, CASE WHEN volume_l <= 0 THEN NULL WHEN volume_l <= 0.25 THEN 'le_0_25' WHEN volume_l <= 0.5 THEN 'gt_0_25_le_0_50' WHEN volume_l <= 0.75 THEN 'gt_0_50_le_0_75' WHEN volume_l <= 1.0 THEN 'gt_0_75_le_1_00'
  WHEN volume_l <= 1.5 THEN 'gt_1_00_le_1_50' WHEN volume_l <= 2.0 THEN 'gt_1_50_le_2_00' WHEN volume_l <= 5.0 THEN 'gt_2_00_le_5_00' WHEN volume_l IS NOT NULL THEN 'gt_5_00' END AS volume_band, price_segment, price, revenue_net, units,
  {r('units', 'selling_stores')} AS units_per_selling_store, margin_abs AS retailer_margin_abs, {r('selling_stores', 'active_stores')} AS numeric_distribution, avg_shelf_price AS weighted_shelf_price_vat FROM prod JOIN seg USING (category, sku), act),
 tops AS (SELECT DISTINCT sku FROM ({' UNION ALL '.join(f"SELECT sku, row_number() OVER (PARTITION BY category ORDER BY {m} DESC, sku) AS k FROM pr WHERE NOT is_own AND {m} IS NOT NULL" for m in ('revenue_net', 'units', 'units_per_selling_store'))}) WHERE k <= 10),
 pool AS (SELECT 'BROAD' AS scope, category AS scope_key, NOT is_own AS in_pool, * FROM pr UNION ALL SELECT 'TOP_N', category, sku IN (SELECT sku FROM tops), * FROM pr
  UNION ALL SELECT 'DIRECT', category || '|' || carbonation || '|' || volume_band || '|' || price_segment || '|' || package, true, * FROM pr WHERE carbonation IS NOT NULL AND volume_band IS NOT NULL AND package IS NOT NULL)"""
_MARKS = f"""{_PROD}, pm AS ({' UNION ALL '.join(f"SELECT scope, scope_key, in_pool, sku, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM pool" for m in ('revenue_net', 'units', 'units_per_selling_store', 'retailer_margin_abs', 'numeric_distribution', 'weighted_shelf_price_vat'))}),
 mk AS (SELECT t.scope, t.scope_key, t.sku, t.metric, t.v AS value, CASE WHEN t.v IS NOT NULL THEN 1 + count(*) FILTER (CASE WHEN t.metric = 'weighted_shelf_price_vat' THEN p.v < t.v ELSE p.v > t.v END) END AS rank,
  1 + count(*) FILTER (p.v = t.v) AS ties, 1 + count(p.v) AS n, 1 + count(*) AS population_size FROM pm t JOIN pm p ON p.scope = t.scope AND p.scope_key = t.scope_key AND p.metric = t.metric AND p.in_pool AND p.sku <> t.sku GROUP BY t.scope, t.scope_key, t.sku, t.metric, t.v),
 marks AS (SELECT scope, scope_key, sku, metric, value, rank, CASE WHEN n > 1 THEN 1 - (rank + (ties - 1) / 2.0::DOUBLE - 1) / (n - 1) END AS percentile, population_size FROM mk)"""
_EF = f"""{grain('manufacturer', 'g0')}, actm AS (SELECT period, {STORES} AS active_stores FROM e GROUP BY period),
 wf AS (SELECT period, category, category || '|' || manufacturer AS entity_id, revenue_net AS revenue, units, margin_abs AS retailer_margin_abs, margin_pct AS retailer_margin_pct, avg_shelf_price AS weighted_shelf_price_vat,
  {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS category_revenue_share, {r('selling_stores', 'active_stores')} AS distribution, {r('units', 'selling_stores')} AS velocity FROM g0 JOIN actm USING (period)),
 lf AS (SELECT period, category, entity_id, unnest([{', '.join(f"'{m}'" for m in _NAMES)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in _NAMES)}]) AS value FROM wf),
 cf AS ({compare(('category', 'entity_id', 'metric'), 'value', have('CAST(lf.period - INTERVAL 12 MONTH AS DATE)', 'lf'), 'lf', 'YOY')}),
 wr AS (SELECT *, revenue AS revenue_net FROM wf), ab AS (SELECT period, category, entity_id, abc_class FROM {abc('wr', 'period', 'entity_id')}), {_MARKS},
 ef AS (SELECT 'manufacturer' AS entity_type, entity_id, category, 'comparison' AS input_source, metric AS feature_name, period, reference_period, 'YOY' AS comparison_type, comparison_quality, current_value AS observed_value, reference_value, CAST(NULL AS VARCHAR) AS observed_label, CAST(NULL AS VARCHAR) AS reference_label,
   CAST(NULL AS BOOLEAN) AS label_changed, delta_abs, delta_pct, CASE WHEN metric IN ('retailer_margin_pct', 'distribution', 'category_revenue_share') THEN delta_abs END AS delta_pp, 'manufacturer.' || metric || '.v1' AS metric_definition_id, 'v1' AS metric_definition_version,
   CAST(NULL AS VARCHAR) AS benchmark_scope, CAST(NULL AS VARCHAR) AS benchmark_scope_id, CAST(NULL AS VARCHAR) AS pool_source, CAST(NULL AS DOUBLE) AS rank, CAST(NULL AS DOUBLE) AS percentile, CAST(NULL AS BIGINT) AS population_size FROM cf
  UNION ALL SELECT 'manufacturer', a.entity_id, a.category, 'abc', 'abc_revenue', a.period, p.period, NULL, NULL, NULL, NULL, a.abc_class, p.abc_class, a.abc_class <> p.abc_class, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
   FROM ab a LEFT JOIN ab p ON p.entity_id = a.entity_id AND p.category = a.category AND p.period = CAST(a.period - INTERVAL 12 MONTH AS DATE)
  UNION ALL SELECT 'sku', sku, split_part(scope_key, '|', 1), 'benchmark', metric, {CUR}, NULL, NULL, NULL, value, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, scope, scope_key, CASE scope WHEN 'BROAD' THEN 'CATEGORY_POOL' WHEN 'TOP_N' THEN 'RULE_POOL_UNION' ELSE 'DIRECT_DIMENSIONS' END, CAST(rank AS DOUBLE), percentile, population_size FROM marks)"""
_VOID = [f"CAST(NULL AS VARCHAR) AS {k}" for k in ("metric_config_hash", "peer_rule_id", "peer_rule_version", "peer_config_hash", "price_segment_rule_id", "price_segment_rule_version", "price_segment_config_hash")]
#: (rule, type, family, source, feature, condition, severity, confidence) of rules on one feature.
_SINGLE = (
    ("revenue_growth", "MATERIAL_REVENUE_GROWTH", "GROWTH_DECLINE", "comparison", "revenue", "delta_pct >= 0.10", "MEDIUM", "HIGH"), ("revenue_decline", "MATERIAL_REVENUE_DECLINE", "GROWTH_DECLINE", "comparison", "revenue", "delta_pct <= -0.10", "HIGH", "HIGH"),
    ("units_growth", "MATERIAL_UNITS_GROWTH", "GROWTH_DECLINE", "comparison", "units", "delta_pct >= 0.10", "MEDIUM", "HIGH"), ("units_decline", "MATERIAL_UNITS_DECLINE", "GROWTH_DECLINE", "comparison", "units", "delta_pct <= -0.10", "MEDIUM", "HIGH"),
    ("margin_growth", "MATERIAL_MARGIN_GROWTH", "GROWTH_DECLINE", "comparison", "retailer_margin_abs", "delta_pct >= 0.10", "MEDIUM", "HIGH"), ("margin_decline", "MATERIAL_MARGIN_DECLINE", "GROWTH_DECLINE", "comparison", "retailer_margin_abs", "delta_pct <= -0.10", "HIGH", "HIGH"),
    ("distribution_gain", "DISTRIBUTION_GAIN", "DISTRIBUTION", "comparison", "distribution", "delta_pp >= 0.05", "MEDIUM", "HIGH"), ("distribution_loss", "DISTRIBUTION_LOSS", "DISTRIBUTION", "comparison", "distribution", "delta_pp <= -0.05", "HIGH", "HIGH"),
    ("velocity_gain", "VELOCITY_GAIN", "VELOCITY", "comparison", "velocity", "delta_pct >= 0.10", "MEDIUM", "HIGH"), ("velocity_loss", "VELOCITY_LOSS", "VELOCITY", "comparison", "velocity", "delta_pct <= -0.10", "HIGH", "HIGH"),
    ("stable_velocity", "STABLE_VELOCITY", "VELOCITY", "comparison", "velocity", "delta_pct BETWEEN -0.05 AND 0.05", "INFO", "HIGH"),
    ("share_gain", "SHARE_GAIN", "SHARE", "comparison", "category_revenue_share", "delta_pp >= 0.02", "MEDIUM", "HIGH"), ("share_loss", "SHARE_LOSS", "SHARE", "comparison", "category_revenue_share", "delta_pp <= -0.02", "MEDIUM", "HIGH"),
    ("price_decrease", "PRICE_DECREASE", "PRICE", "comparison", "weighted_shelf_price_vat", "delta_pct <= -0.10", "MEDIUM", "HIGH"),
    ("margin_pct_gain", "MARGIN_PCT_GAIN", "MARGIN_PCT", "comparison", "retailer_margin_pct", "delta_pp >= 0.02", "MEDIUM", "HIGH"), ("margin_pct_erosion", "MARGIN_PCT_EROSION", "MARGIN_PCT", "comparison", "retailer_margin_pct", "delta_pp <= -0.02", "HIGH", "HIGH"),
    ("abc_class_change", "ABC_CLASS_CHANGE", "PORTFOLIO", "abc", "abc_revenue", "label_changed", "INFO", "HIGH"), ("persistent_c", "PERSISTENT_C_CLASS", "PORTFOLIO", "abc", "abc_revenue", "observed_label = 'C' AND reference_label = 'C'", "LOW", "HIGH"),
    ("peer_outperformance", "PEER_OUTPERFORMANCE", "BENCHMARK", "benchmark", "revenue_net", "percentile >= 0.80", "MEDIUM", "MEDIUM"), ("peer_underperformance", "PEER_UNDERPERFORMANCE", "BENCHMARK", "benchmark", "revenue_net", "percentile <= 0.20 AND benchmark_scope <> 'DIRECT'", "MEDIUM", "MEDIUM"),
    ("price_pressure", "PRICE_PRESSURE_PATTERN", "PATTERN_CANDIDATE", "comparison", "weighted_shelf_price_vat", "delta_pct >= 0.10", "MEDIUM", "MEDIUM"),
)
#: The same of rules on several features.
_BOTH = (
    ("price_increase", "PRICE_INCREASE", "PRICE", "comparison", "weighted_shelf_price_vat+velocity+distribution", "weighted_shelf_price_vat_delta_pct >= 0.10 AND velocity_delta_pct <= -0.10 AND distribution_delta_pp BETWEEN -0.02 AND 0.02", "MEDIUM", "HIGH"),
    ("stable_sku", "STABLE_SKU", "PORTFOLIO", "comparison", "revenue+units", "revenue_delta_pct BETWEEN -0.05 AND 0.05 AND units_delta_pct BETWEEN -0.05 AND 0.05", "INFO", "HIGH"),
    ("high_velocity_low_distribution", "HIGH_VELOCITY_LOW_DISTRIBUTION", "BENCHMARK", "benchmark", "units_per_selling_store+numeric_distribution", "units_per_selling_store_percentile >= 0.80 AND numeric_distribution_percentile <= 0.50 AND units_per_selling_store_population_size >= 2", "MEDIUM", "MEDIUM"),
    ("low_velocity_high_distribution", "LOW_VELOCITY_HIGH_DISTRIBUTION", "BENCHMARK", "benchmark", "units_per_selling_store+numeric_distribution", "units_per_selling_store_percentile <= 0.20 AND numeric_distribution_percentile >= 0.50", "MEDIUM", "MEDIUM"),
    ("price_power", "PRICE_POWER_PATTERN", "PATTERN_CANDIDATE", "comparison", "weighted_shelf_price_vat+units", "weighted_shelf_price_vat_delta_pct >= 0.03 AND units_delta_pct >= 0.0", "MEDIUM", "MEDIUM"),
    ("promo_like", "PROMO_LIKE_PATTERN", "PATTERN_CANDIDATE", "comparison", "weighted_shelf_price_vat+units", "weighted_shelf_price_vat_delta_pct <= -0.03 AND units_delta_pct >= 0.10", "MEDIUM", "MEDIUM"),
)
_SIDE = ", ".join(f"max(CASE WHEN feature_name = '{f}' THEN {k} END) AS {f}_{k}" for f in ("weighted_shelf_price_vat", "velocity", "distribution", "revenue", "units", "units_per_selling_store", "numeric_distribution") for k in ("delta_pct", "delta_pp", "percentile", "population_size"))


def _confident(own: str, population: str) -> str:
    return f"CASE WHEN '{own}' = 'HIGH' AND (comparison_quality = 'LOW' OR {population} < 2) THEN 'MEDIUM' ELSE '{own}' END"


_FIRED = f"""{_EF}, wd AS (SELECT entity_type, entity_id, category, input_source, period, reference_period, comparison_type, comparison_quality, benchmark_scope, benchmark_scope_id, pool_source, {_SIDE} FROM ef GROUP BY ALL),
 fired AS (""" + " UNION ALL ".join([
    f"SELECT '{i}.v1' AS event_rule_id, '{k}' AS event_type, '{f}' AS event_family, entity_type, entity_id, category, period, reference_period, feature_name, observed_value, observed_label, reference_label, delta_pct, delta_pp, percentile, benchmark_scope_id, '{sv}' AS severity, {_confident(cf, 'population_size')} AS confidence FROM ef WHERE input_source = '{src}' AND feature_name = '{ft}' AND {x}"
    for i, k, f, src, ft, x, sv, cf in _SINGLE
] + [
    f"SELECT '{i}.v1', '{k}', '{f}', entity_type, entity_id, category, period, reference_period, '{ft}', NULL, NULL, NULL, NULL, NULL, NULL, benchmark_scope_id, '{sv}', {_confident(cf, 'NULL')} FROM wd WHERE input_source = '{src}' AND {x}"
    for i, k, f, src, ft, x, sv, cf in _BOTH
]) + ")"
_CLASS = """CASE WHEN event_type IN ('PROMO_LIKE_PATTERN', 'ABC_CLASS_CHANGE', 'PERSISTENT_C_CLASS') OR event_family IN ('PORTFOLIO', 'BENCHMARK') THEN NULL WHEN event_family = 'PATTERN_CANDIDATE' THEN 'DETERMINISTIC_PATTERN'
 WHEN event_family IN ('GROWTH_DECLINE', 'DISTRIBUTION', 'VELOCITY', 'SHARE', 'PRICE', 'MARGIN_PCT') THEN 'COMMERCIAL_SIGNAL' END"""
_SIGNALS = f"{_FIRED}, own AS (SELECT *, {_CLASS} AS signal_type FROM fired WHERE period = {CUR}), placed AS (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY severity, event_type, entity_type, entity_id, period, event_rule_id, feature_name) AS place FROM own WHERE signal_type IS NOT NULL)"

ORACLES: dict[str, str] = {
    "mart_metric_facts": e("SELECT period_start, period_end, grain_id, entity_id, parent_entity_ids, metric_definition_id, value, numerator_value, denominator_value, range_aggregation_strategy FROM mart", _MART),
    "mart_fact_descriptions": e("SELECT period_start, * EXCLUDE (period_start, period_end, grain_id, entity_id, parent_entity_ids, value, numerator_value, denominator_value, range_aggregation_strategy), count(*) AS n_facts FROM mart GROUP BY ALL", _MART),
    "mart_fact_scan": e(f"SELECT retailer_id, source_id, period_start, grain_id, entity_id, metric_definition_id, value FROM mart WHERE {_WINDOW} AND period_end <= DATE '1998-06-30' AND grain_id = 'category' AND metric_concept = 'revenue'", _MART),
    "mart_parent_scan": e(f"SELECT period_start, entity_id, parent_entity_ids, metric_concept, value FROM mart WHERE {_WINDOW} AND grain_id = 'brand' AND metric_concept IN ('revenue', 'units') AND (parent_entity_ids LIKE '%\"category\": \"ECONOMY\"%' OR parent_entity_ids LIKE '%\"category\": \"SMALL\"%') AND parent_entity_ids LIKE '%\"manufacturer\": \"MFR_1\"%'", _MART),
    "fact_validation": e(f"SELECT 'OUTSIDE_BUILD' AS issue_code, 'analysis_run_id=run_a' AS subject, (SELECT count(*) FROM mart) + (SELECT count(*) FROM mart WHERE grain_id = 'network' AND period_start = {CUR}) AS n_rows UNION ALL SELECT 'DUPLICATE_IDENTITY', 'network|ALL|' || metric_definition_id || '|1998-03-01', 2 FROM mart WHERE grain_id = 'network' AND period_start = {CUR}", _MART),
    "event_fact_rows": e(f"SELECT 'run_a' AS analysis_run_id, 'retailer_a' AS retailer_id, 'source_a' AS source_id, 'rules_v1' AS rule_version, *, {', '.join(_VOID)}, CAST(NULL AS DOUBLE) AS peer_median_price FROM ef", _EF),
    "event_rules": e("SELECT * FROM fired", _FIRED),
    "event_rule_issues": "SELECT * FROM (VALUES ('bare.v1', 'INVALID_EVENT_CONDITION', 'ERROR', NULL), ('stock.v1', 'MISSING_EVENT_FEATURE', 'WARNING', 'stock_days'), ('field.v1', 'MISSING_EVENT_FEATURE', 'WARNING', 'stock_level')) v(rule_id, issue_code, severity, subject)",
    "stored_events": e("SELECT * FROM fired WHERE period BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'", _FIRED),
    "signal_feed": e("SELECT signal_type, place, severity, event_type, event_family, entity_type, entity_id, period, event_rule_id, delta_pct, 'PARTIAL' AS status FROM placed WHERE place <= 20", _SIGNALS),
    "signal_feed_status": e("SELECT CASE WHEN n > 0 THEN 'PARTIAL' WHEN m > 0 THEN 'NO_SURFACED_SIGNALS' ELSE 'NO_CONFIRMED_EVENTS' END AS status, m AS event_count, n AS surfaced_event_count, 'event_private_label_scope_not_materialized' || CASE WHEN n > 0 THEN '' WHEN m > 0 THEN ',no_surfaced_signals_in_scope' ELSE ',no_confirmed_events_in_scope' END AS limitations FROM (SELECT (SELECT count(*) FROM own) AS m, (SELECT count(*) FROM placed WHERE place <= 20) AS n)", _SIGNALS),
    "signal_feed_excluded": e("SELECT event_type, count(*) AS n FROM own WHERE signal_type IS NULL GROUP BY 1", _SIGNALS),
    "benchmark_features": e("SELECT scope, scope_key, sku, metric, value, rank, percentile, population_size FROM marks", _MARKS),
    "benchmark_prices": e("""SELECT scope, scope_key, sku, price, m AS peer_median_price, CASE WHEN m <> 0 THEN price - m END AS price_vs_peer_median_abs, 100 * price / nullif(m, 0) AS price_index_to_peer_median, price / nullif(m, 0) - 1 AS price_delta_pct_to_peer_median, population_size,
 concat_ws(',', CASE WHEN m IS NULL THEN 'EMPTY_DIRECT_PEER_GROUP' END, CASE WHEN m IS NULL OR m = 0 THEN 'ZERO_PEER_MEDIAN' END) AS issues FROM (SELECT t.scope, t.scope_key, t.sku, t.price, CASE WHEN t.price IS NOT NULL THEN median(p.price) FILTER (p.price > 0) END AS m, count(*) AS population_size
 FROM pool t JOIN pool p ON p.scope = t.scope AND p.scope_key = t.scope_key AND p.in_pool AND p.sku <> t.sku GROUP BY t.scope, t.scope_key, t.sku, t.price)""", _PROD),
}


def _parts(keys: str) -> str:
    """SKU x store facts of seven concepts, rolled up to the keys."""
    concepts = (
        ("revenue_vat", "s", "revenue_vat", None, None), ("revenue", "s", "revenue_net", None, None), ("units", "s", "units", None, None), ("retailer_margin_abs", "s", "margin_abs", None, None),
        ("retailer_margin_pct", "r", None, "margin_abs", "revenue_net"), ("weighted_shelf_price_vat", "w", None, "sv", "sw"), ("weighted_input_price_vat", "w", None, "iv", "iw"),
    )
    flags = (("missing_margin", "null_margins > 0"), ("returns", "return_rows > 0"), ("unknown_private_label", "private_label IS NULL"))
    out = []
    for k, kind, v, n, d in concepts:
        zero = lambda x: f"count(*) FILTER ({x} IS NULL)" if x else "count(*)"
        total = lambda x: f"CAST(sum({x}) AS DOUBLE)"
        value = f"CASE WHEN {zero(v)} = 0 THEN {total(v)} END" if kind == "s" else f"CASE WHEN {zero(n)} = 0 AND {zero(d)} = 0 THEN {total(n)} / nullif({total(d)}, 0) END"
        part = lambda x, n=n, d=d, kind=kind: "CAST(NULL AS DOUBLE)" if kind == "s" else f"CASE WHEN ({zero(n)} = 0 AND {zero(d)} = 0) OR count(*) = 1 THEN {total(x)} END"
        mix = "concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER ({c}) > 0 THEN '{f}=' || count(*) FILTER ({c}) END" for f, c in flags) + ")"
        names = "concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER ({c}) > 0 THEN '{f}' END" for f, c in flags) + ")"
        out.append(f"""SELECT {keys}, '{k}' AS metric_concept, {value} AS value, {part(n or v)} AS numerator_value, {part(d or v)} AS denominator_value, count(*) AS n_facts, {zero(v)} AS null_value, {zero(n)} AS null_numerator, {zero(d)} AS null_denominator,
 CASE WHEN count(*) FILTER (null_margins > 0) = 0 THEN 'valid' ELSE 'mixed' END AS quality_status, {names} AS quality_flags, {mix} AS flag_counts, max(period) AS latest_period FROM base GROUP BY {keys}""")
    return " UNION ALL ".join(out)


_BASE = f"""base AS (SELECT period, category, manufacturer, brand, sku, store, store_format, region, package, carbonation, volume_l, private_label, is_own, sum(CAST(revenue_vat AS DECIMAL(24,8))) AS revenue_vat, sum(revenue_net) AS revenue_net, sum(CAST(units AS DECIMAL(24,8))) AS units, sum(margin_abs) AS margin_abs,
 sum(CASE WHEN {_SHELF} THEN CAST(shelf_price_vat * units AS DECIMAL(24,8)) END) AS sv, sum(CASE WHEN {_SHELF} THEN CAST(units AS DECIMAL(24,8)) END) AS sw, sum(CASE WHEN {_INPUT} THEN CAST(input_price_vat * units AS DECIMAL(24,8)) END) AS iv, sum(CASE WHEN {_INPUT} THEN CAST(units AS DECIMAL(24,8)) END) AS iw,
 count(*) FILTER (margin_abs IS NULL) AS null_margins, count(*) FILTER (units < 0) AS return_rows, 'rev_' || replace(region, ' ', '') || '_' || CAST(year(period) AS VARCHAR) AS rev, 'run_' || lower(store_format) AS run FROM e GROUP BY ALL)"""
_AFTER = "(period, category, manufacturer, brand, sku_name, store, sku, units, CAST(revenue_vat AS DOUBLE), shelf_price_vat) > (DATE '1998-05-01', 'ECONOMY', 'MFR_2', '', '', '', '', 0.0, 0.0, 0.0)"
_SCOPE = "period BETWEEN DATE '1998-01-01' AND DATE '1998-12-01' AND category IN ('ECONOMY', 'SMALL')"
ORACLES |= {
    "product_store_quality": e(_parts("category"), _BASE),
    "product_store_months": e(f"SELECT * EXCLUDE (latest_period) FROM ({_parts('period, category, store_format')})", _BASE),
    "lineage": e(f"""SELECT category, region, metric_concept, count(*) AS n_facts, CASE WHEN count(*) FILTER (null_margins > 0) = 0 THEN 'valid' ELSE 'mixed' END AS quality_status,
 concat_ws(',', CASE WHEN count(*) FILTER (null_margins > 0) > 0 THEN 'missing_margin' END, CASE WHEN count(*) FILTER (return_rows > 0) > 0 THEN 'returns' END, CASE WHEN count(*) FILTER (private_label IS NULL) > 0 THEN 'unknown_private_label' END) AS quality_flags,
 max(period) AS latest_period, max(rev) AS latest_revision_id, array_to_string(list_sort(list(DISTINCT rev)), ',') AS source_revision_ids, array_to_string(list_sort(list(DISTINCT run)), ',') AS analysis_run_ids
 FROM base CROSS JOIN (VALUES ('revenue_vat'), ('revenue'), ('units'), ('retailer_margin_abs'), ('retailer_margin_pct'), ('weighted_shelf_price_vat'), ('weighted_input_price_vat')) k(metric_concept) GROUP BY category, region, metric_concept""", _BASE),
    "source_rows_seek": c(f"SELECT period, category, manufacturer, brand, sku_name, store, sku, units, CAST(revenue_vat AS DOUBLE) AS revenue_vat, shelf_price_vat, (SELECT count(*) FROM canon WHERE {_SCOPE}) AS total_count FROM canon WHERE {_SCOPE} AND {_AFTER} ORDER BY period, category, manufacturer, brand, sku_name, store, sku, units, CAST(revenue_vat AS DOUBLE), shelf_price_vat LIMIT 100"),
    "mart_rebuild": e(f"SELECT period, category, {s("CASE WHEN period = DATE '1998-02-01' AND store = 'STORE_1' THEN 2 * revenue_net ELSE revenue_net END")} AS revenue_net, {s(U)} AS units, CASE WHEN (SELECT count(*) FROM canon WHERE period = DATE '1998-02-01' AND store = 'STORE_1') > 0 AND period IN (DATE '1998-02-01', DATE '1998-03-01', DATE '1999-02-01') THEN 'build_2' ELSE 'build_1' END AS mart_build_id FROM e GROUP BY period, category"),
    "stream_ingest": c(f"SELECT period, category, CAST(sum(revenue_vat) AS DOUBLE) AS revenue_vat, CAST(sum({U}) AS DOUBLE) AS units, {STORES} AS selling_stores, (SELECT count(DISTINCT period) + 1 FROM canon) AS n_files, 1 AS n_duplicates FROM canon GROUP BY period, category"),
}


def _positions(months: str) -> str:
    """Ranks, shares and classes by concept, each as a query of its own."""
    base = f"""pb AS (SELECT grain_id, CASE WHEN grain_id = 'category' THEN 'ALL' ELSE json_extract_string(parent_entity_ids, '$.category') END AS universe, entity_id, parent_entity_ids, metric_concept AS basis, sum(CAST(value AS DECIMAL(24,8))) AS v
 FROM mart WHERE period_start IN ({months}) AND grain_id IN ('category', 'manufacturer', 'brand', 'sku') AND metric_concept IN ('revenue', 'units', 'retailer_margin_abs') GROUP BY ALL HAVING count(*) = count(value)),
 pp AS (SELECT *, CAST(v AS DOUBLE) AS value, rank() OVER (k ORDER BY v DESC) AS rk, count(*) OVER (PARTITION BY grain_id, universe, basis, v) AS ties, count(*) OVER k AS pop, row_number() OVER w AS place, min(v) OVER k AS least, CAST(sum(v) OVER k AS DOUBLE) AS total,
  CAST(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM pb WINDOW k AS (PARTITION BY grain_id, universe, basis), w AS (PARTITION BY grain_id, universe, basis ORDER BY v DESC, entity_id, parent_entity_ids))"""
    row = lambda k, where, rank="NULL", ties="NULL", share="NULL", run="NULL", label="NULL", code="NULL": f"SELECT '{k}' AS concept_id, CAST({rank} AS INTEGER) AS rank, CAST({ties} AS BIGINT) AS tie_count, pop AS population, CAST({share} AS DOUBLE) AS share, CAST({run} AS DOUBLE) AS cumulative_share, CAST({label} AS VARCHAR) AS abc_class, CAST({code} AS VARCHAR) AS limitation, grain_id, universe, entity_id, parent_entity_ids, value FROM pp WHERE {where}"
    out = []
    for b, name in (("revenue", "revenue"), ("units", "units"), ("retailer_margin_abs", "margin_abs")):
        out += [row(f"{g}_rank_{name}", f"grain_id = '{g}' AND basis = '{b}'", "rk", "ties") for g in ("category", "manufacturer", "brand", "sku")]
        short = name.replace("_abs", "")
        out += [row(f"entity_{short}_share", f"grain_id <> 'category' AND basis = '{b}'", share="CASE WHEN total > 0 THEN value / total END"), row(f"entity_cumulative_{short}_share", f"grain_id <> 'category' AND basis = '{b}'", run="CASE WHEN total > 0 THEN running / total END")]
        refused = "CASE WHEN least < 0 THEN 'abc_negative_contribution_semantics_unsupported' WHEN total <= 0 THEN 'abc_positive_universe_required' END"
        label = "CASE WHEN least < 0 OR total <= 0 THEN NULL WHEN v = 0 THEN 'C' WHEN place = 1 OR running / total <= 0.8 THEN 'A' WHEN running / total <= 0.95 THEN 'B' ELSE 'C' END"
        out += [row(f"{g}_abc_{name}", f"grain_id = '{g}' AND basis = '{b}'", run="CASE WHEN least >= 0 AND total > 0 THEN running / total END", label=label, code=refused) for g in ("manufacturer", "sku")]
    return e(" UNION ALL ".join(out), f"{_MART}, {base}")


_FLAWED = f"""{_NUM}, tx AS (SELECT source_row_number AS n, source_row_number % 13 AS f, year(period) AS y, units, store_format FROM num)"""
ORACLES |= {
    "portfolio_positions": _positions(CUR),
    "portfolio_positions_year": _positions(", ".join(f"DATE '1998-{m:02d}-01'" for m in range(1, 13))),
    "catalog_limitations": """SELECT * FROM (VALUES ('metric_not_in_catalog', NULL, 'velocity'), ('metric_definition_not_in_catalog', 'network.revenue.v1', 'revenue'), ('metric_definition_not_in_catalog', 'manufacturer.revenue.v1', 'revenue'), ('metric_definition_not_in_catalog', 'brand.revenue.v1', 'revenue'), ('metric_definition_not_in_catalog', 'store.revenue.v1', 'revenue'),
 ('metric_not_supported_for_private_label_scope', 'sku.revenue.v1', 'revenue'), ('catalog_range_strategy_mismatch', 'sku.revenue.v1', 'revenue'), ('ambiguous_catalog_entry', 'category.units.v1', 'units'), ('ambiguous_catalog_entry', 'brand.units.v1', 'units'), ('metric_not_supported_for_grain', 'brand.units.v1', 'units'),
 ('metric_not_supported_for_period_grain', 'sku.units.v1', 'units'), ('metric_not_available', 'sku.units.v1', 'units'), ('metric_definition_not_in_catalog', 'network.units.v1', 'units'), ('metric_definition_not_in_catalog', 'manufacturer.units.v1', 'units'), ('metric_definition_not_in_catalog', 'store.units.v1', 'units'),
 ('metric_not_supported_for_comparison', 'category.distribution.v1', 'distribution'), ('catalog_range_strategy_mismatch', 'category.distribution.v1', 'distribution'), ('metric_definition_not_in_catalog', 'manufacturer.distribution.v1', 'distribution'), ('metric_definition_not_in_catalog', 'brand.distribution.v1', 'distribution'), ('metric_definition_not_in_catalog', 'sku.distribution.v1', 'distribution')
 ) v(issue_code, metric_definition_id, metric_concept)""",
    "typing_issues": c("SELECT code AS issue_code, field, n AS source_row_number FROM tx JOIN (VALUES (0, 'blank_required_string', 'sku'), (1, 'invalid_integer_value', 'year'), (2, 'null_integer_value', 'year'), (3, 'invalid_numeric_value', 'units'), (4, 'null_numeric_value', 'units'), (5, 'invalid_numeric_value', 'shelf_price')) k(f, code, field) USING (f)", _FLAWED),
    "typed_rows": c("SELECT CASE WHEN f NOT IN (1, 2) THEN y END AS year, count(*) AS n_rows, count(*) FILTER (f NOT IN (3, 4)) AS n_units, count(*) FILTER (f NOT IN (5, 6)) AS n_prices, CAST(sum(CASE WHEN f NOT IN (3, 4) THEN CAST(units AS DECIMAL(18,2)) END) AS DOUBLE) AS units FROM tx GROUP BY 1", _FLAWED),
    "unknown_values": c("SELECT 'unknown_value' AS issue_code, 'store_format' AS field, store_format AS source_value, n AS source_row_number FROM tx WHERE store_format NOT IN ('HYPER', 'SUPER')", _FLAWED),
    "store_alias_scope": c("SELECT CASE WHEN store IN ('STORE_2', 'STORE_4') THEN 'STORE_1' ELSE store END AS canonical_store, count(*) AS n_rows, count(DISTINCT store) AS n_sources FROM canon GROUP BY 1"),
}
