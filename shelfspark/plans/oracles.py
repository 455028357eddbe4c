"""SQL for each registered query, written apart from the operators, for another engine on the same tables."""

from __future__ import annotations

from ..sources.tables import CANONICAL

CURRENT, REFERENCE, GAP = "1998-03-01", "1997-03-01", "1998-06-01"
CUR, REF = f"DATE '{CURRENT}'", f"DATE '{REFERENCE}'"

_CANON = f"""canon AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CANONICAL.items())} FROM lineitem JOIN part ON l_partkey = p_partkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_RULES = """rules(rule_id, valid_from, valid_to, rate, grp) AS (VALUES ('reduced', DATE '1995-01-01', CAST(NULL AS DATE), CAST(0.10 AS DOUBLE), 'CATEGORY_REDUCED'),
 ('std_1', DATE '1995-01-01', DATE '1998-12-31', 0.20, 'CATEGORY_STANDARD'), ('std_2', DATE '1999-01-01', NULL, 0.22, 'CATEGORY_STANDARD'))"""
_E = f"""{_RULES}, t AS (SELECT canon.*, rule_id AS tax_rule_id, rate AS tax_rate, CAST(CAST(revenue_vat AS DOUBLE) / (1 + rate) AS DECIMAL(24,8)) AS revenue_net,
 CAST(input_price_vat / (1 + rate) * units AS DECIMAL(24,8)) AS input_cost_net FROM canon JOIN rules ON grp = category_group AND period >= valid_from AND (valid_to IS NULL OR period <= valid_to)),
 e AS (SELECT *, CAST(revenue_net - input_cost_net AS DECIMAL(24,8)) AS margin_abs FROM t)"""


def c(sql: str, more: str = "") -> str:
    return f"WITH {_CANON}{', ' + more if more else ''} {sql}"


def e(sql: str, more: str = "") -> str:
    return f"WITH {_CANON}, {_E}{', ' + more if more else ''} {sql}"


def s(x: str) -> str:
    return f"coalesce(CAST(sum({x}) AS DOUBLE), 0.0)"


def r(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


U = "CAST(units AS DECIMAL(18,2))"
STORES = "count(DISTINCT CASE WHEN units > 0 THEN store END)"
SKUS = "count(DISTINCT CASE WHEN units > 0 THEN sku END)"
SUMS = f"""{s('revenue_vat')} AS revenue_vat, {s('revenue_net')} AS revenue_net, {s(U)} AS units, {s('margin_abs')} AS margin_abs,
 {r('sum(margin_abs)', 'sum(revenue_net)')} AS margin_pct,
 {r('sum(CASE WHEN units > 0 THEN CAST(shelf_price_vat * units AS DECIMAL(24,8)) END)', f'sum(CASE WHEN units > 0 THEN {U} END)')} AS avg_shelf_price,
 CAST(sum(CASE WHEN units > 0 THEN CAST(shelf_price_vat * units AS DECIMAL(24,8)) END) AS DOUBLE) AS priced_value, CAST(sum(CASE WHEN units > 0 THEN {U} END) AS DOUBLE) AS priced_units,
 {STORES} AS selling_stores, {SKUS} AS selling_skus"""
GRAINS = {"network": "", "category": "category", "manufacturer": "category, manufacturer", "brand": "category, manufacturer, brand", "sku": "category, manufacturer, brand, sku", "store": "store"}
METRICS = "revenue_vat, revenue_net, units, margin_abs, margin_pct, avg_shelf_price, selling_stores, selling_skus"


def grain(name: str, alias: str = "g", where: str = "true") -> str:
    keys = f"period{', ' + GRAINS[name] if GRAINS[name] else ''}"
    return f"{alias} AS (SELECT {keys}, {SUMS} FROM e WHERE {where} GROUP BY {keys})"


_RANGES = ((0.25, "le_0_25"), (0.5, "gt_0_25_le_0_50"), (0.75, "gt_0_50_le_0_75"), (1.0, "gt_0_75_le_1_00"), (1.5, "gt_1_00_le_1_50"), (2.0, "gt_1_50_le_2_00"), (5.0, "gt_2_00_le_5_00"))


def vrange(v: str) -> str:
    return f"CASE WHEN {v} <= 0 THEN NULL{''.join(f" WHEN {v} <= {x} THEN '{n}'" for x, n in _RANGES)} WHEN {v} IS NOT NULL THEN 'gt_5_00' END"


def compare(keys: tuple[str, ...], metric: str, ref: str, source: str, kind: str, point: bool = False, extra: str = "") -> str:
    """Only a year and a month exactly are of HIGH quality, a gap to the last available period is MEDIUM; points are plain differences."""
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    gap = "((year(a.period) - year(ref)) * 12 + month(a.period) - month(ref))"
    quality = {"YOY": f"CASE WHEN {gap} = 12 THEN 'HIGH' ELSE 'LOW' END", "MOM": f"CASE WHEN {gap} = 1 THEN 'HIGH' ELSE 'LOW' END", "PREVIOUS_AVAILABLE": f"CASE WHEN {gap} > 1 THEN 'MEDIUM' ELSE 'LOW' END", "CUSTOM": "'LOW'"}[kind]
    pp = f"a.{metric} - b.{metric}" if point else "CAST(NULL AS DOUBLE)"
    return f"""SELECT a.period, {', '.join('a.' + k for k in keys)}, ref AS reference_period, a.{metric} AS current_value, b.{metric} AS reference_value, a.{metric} - b.{metric} AS delta_abs,
 (a.{metric} - b.{metric}) / nullif(b.{metric}, 0) AS delta_pct, {pp} AS delta_pp, b.{metric} IS NOT NULL AS comparable, {gap} AS month_gap, {gap} = 1 AS is_contiguous, month(a.period) = month(ref) AS same_calendar_month,
 {quality} AS comparison_quality{extra}
 FROM (SELECT {source}.*, {ref} AS ref FROM {source}) a LEFT JOIN {source} b ON b.period = ref AND {on} WHERE ref IS NOT NULL"""


def have(expr: str, source: str = "g") -> str:
    return f"(SELECT max(p.period) FROM (SELECT DISTINCT period FROM {source}) p WHERE p.period = {expr})"


YOY = have(f"CAST(g.period - INTERVAL 12 MONTH AS DATE)")
MOM = have(f"CAST(g.period - INTERVAL 1 MONTH AS DATE)")
PREVIOUS = "(SELECT max(p.period) FROM (SELECT DISTINCT period FROM g) p WHERE p.period < g.period)"
MONTHLY = grain("category", where=f"period <> DATE '{GAP}'")

ORACLES: dict[str, str] = {
    "category_month_economics": e("SELECT period, category, revenue_vat, revenue_net, units, margin_pct, avg_shelf_price FROM g", grain("category")),
    "canonical_sales": c(f"SELECT {', '.join(k for k in CANONICAL if k != 'revenue_vat')}, CAST(revenue_vat AS DOUBLE) AS revenue_vat FROM canon"),
    "source_profile": c("SELECT count(*) AS n_rows, count(DISTINCT period) AS n_periods, count(DISTINCT store) AS n_stores, count(DISTINCT sku) AS n_skus, CAST(sum(CAST(volume_l IS NULL AS INT)) AS BIGINT) AS null_volume_l, CAST(sum(CAST(private_label IS NULL AS INT)) AS BIGINT) AS null_private_label, CAST(sum(CAST(input_price_vat IS NULL AS INT)) AS BIGINT) AS null_input_price_vat FROM canon"),
    "duplicate_grain_rows": c("SELECT period, retailer_id, store, sku, count(*) AS n_rows FROM canon GROUP BY ALL HAVING count(*) > 1"),
    "store_alias": c("SELECT CASE WHEN store = 'STORE_2' THEN 'STORE_1' ELSE store END AS canonical_store, count(*) AS n_rows, count(DISTINCT store) AS n_sources FROM canon GROUP BY 1"),
    "semantic_value_map": c("SELECT CASE store_format WHEN 'HYPER' THEN 'hypermarket' WHEN 'SUPER' THEN 'supermarket' END AS store_format, CASE WHEN store_format NOT IN ('HYPER', 'SUPER') THEN 'unknown_value' END AS value_issue, count(*) AS n_rows FROM canon GROUP BY 1, 2"),
    "period_normalise": "SELECT CASE WHEN l_linenumber IN (1, 3) THEN NULL WHEN l_linenumber = 2 THEN make_date(year(l_shipdate), 3, 1) ELSE CAST(date_trunc('month', l_shipdate) AS DATE) END AS period, CASE WHEN l_linenumber IN (1, 3) THEN 'invalid_month' END AS period_issue, count(*) AS n_rows FROM lineitem GROUP BY 1, 2",
    "type_issues": "SELECT CASE WHEN l_linenumber = 1 THEN 'invalid_number' WHEN l_linenumber IN (2, 3) THEN 'missing' END AS issue, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "tax_resolution": e("SELECT period, category_group, tax_rule_id, tax_rate, count(*) AS n_rows FROM e GROUP BY ALL"),
    "tax_rule_issues": c("SELECT period, category_group, CASE WHEN category_group = 'CATEGORY_REDUCED' THEN 'invalid_tax_rate' WHEN period < DATE '1996-01-01' THEN 'no_matching_tax_rule' WHEN year(period) = 1998 THEN 'multiple_matching_tax_rules' END AS tax_issue, count(*) AS n_rows FROM canon GROUP BY ALL"),
    "tax_semantics": c("SELECT category, CASE WHEN d = 1 THEN NULL WHEN d = 2 THEN 'REDUCED' ELSE 'STANDARD' END AS tax_group, CASE WHEN d = 1 THEN 'ambiguous' WHEN d = 2 THEN 'matched' ELSE 'default' END AS tax_state, count(*) AS n_rows FROM (SELECT category, dense_rank() OVER (ORDER BY category) AS d FROM canon) GROUP BY 1, 2, 3"),
    "row_economics": e(f"SELECT period, store, sku, {s('revenue_net')} AS revenue_net, {s('input_cost_net')} AS input_cost_net, {s('margin_abs')} AS margin_abs, max({r('margin_abs', 'revenue_net')}) AS max_margin_pct, min({r('margin_abs', 'input_cost_net')}) AS min_markup_pct, max(CASE WHEN units > 0 THEN {r('revenue_vat', 'units')} END) AS max_realized_price FROM e GROUP BY period, store, sku"),
    "sign_class": e(f"SELECT CASE WHEN units >= 0 AND revenue_vat >= 0 THEN 'SALE' WHEN units < 0 AND revenue_vat < 0 THEN 'RETURN_OR_CORRECTION' ELSE 'SUSPICIOUS' END AS sign_class, count(*) AS n_rows, {s('revenue_vat')} AS revenue_vat FROM e GROUP BY 1"),
    "reconciliation": c(f"SELECT (SELECT count(*) FROM lineitem) AS source_rows, (SELECT CAST(sum(CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem) AS source_units, count(*) AS n_rows, CAST(sum({U}) AS DOUBLE) AS units, true AS reconciled FROM canon"),
    **{f"metrics_{n}": e(f"SELECT period{', ' + k if k else ''}, {METRICS} FROM g", grain(n)) for n, k in GRAINS.items()},
}

_ACTIVE = f"act AS (SELECT period, {STORES} AS active_stores FROM e GROUP BY period)"
_BRAND = "period, category, manufacturer, brand"
ORACLES |= {
    "active_store_count_broadcast": e(f"SELECT {_BRAND}, selling_stores, active_stores FROM g JOIN act USING (period)", f"{grain('brand')}, {_ACTIVE}"),
    "numeric_distribution": e(f"SELECT {_BRAND}, {r('selling_stores', 'active_stores')} AS numeric_distribution FROM g JOIN act USING (period)", f"{grain('brand')}, {_ACTIVE}"),
    "velocity": e(f"SELECT period, category, manufacturer, {r('units', 'selling_stores')} AS units_per_store, {r('revenue_net', 'selling_stores')} AS revenue_per_store FROM g", grain("manufacturer")),
    "metric_share": e(f"SELECT {_BRAND}, revenue_net, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS share FROM g", grain("brand")),
    "pl_scoped_metrics": e(f"SELECT x.*, active_stores, {r('selling_stores', 'active_stores')} AS numeric_distribution FROM (" + " UNION ALL ".join(f"SELECT period, '{n}' AS scope, category, {s('revenue_net')} AS revenue_net, {s(U)} AS units, {STORES} AS selling_stores FROM e WHERE {w} GROUP BY period, category" for n, w in (("INCLUDE", "true"), ("EXCLUDE", "NOT private_label"), ("ONLY", "private_label"))) + ") x JOIN act USING (period)", _ACTIVE),
    "market_universe": e(" UNION ALL ".join(f"SELECT period, {s('revenue_net')} AS revenue_net, '{n}' AS universe FROM e WHERE {w} GROUP BY period" for n, w in (("TOTAL_MARKET", "true"), ("MARKET_EX_PRIVATE_LABEL", "NOT private_label"), ("PRIVATE_LABEL", "private_label"), ("OWN_PORTFOLIO", "is_own")))),
    "volume_range_filter": c(f"SELECT period, {vrange('volume_l')} AS volume_range, count(*) AS n_rows, {s(U)} AS units FROM canon WHERE volume_l > 0.25 AND volume_l <= 1.0 OR round(volume_l, 6) = 2.5 GROUP BY 1, 2"),
    "compare_yoy": e(compare(("category",), "revenue_net", YOY, "g", "YOY"), MONTHLY),
    "compare_mom": e(compare(("category",), "revenue_net", MOM, "g", "MOM"), MONTHLY),
    "compare_previous_available": e(compare(("category",), "revenue_net", PREVIOUS, "g", "PREVIOUS_AVAILABLE"), MONTHLY),
    "compare_custom": e(compare(("category",), "revenue_net", REF, "g", "CUSTOM"), MONTHLY),
    "coverage": c(f"SELECT period, available, expected, present, {r('present', 'expected')} AS coverage_ratio, CASE WHEN present = expected THEN 'COMPLETE' WHEN present = 0 THEN 'MISSING' ELSE 'PARTIAL' END AS coverage_status FROM (SELECT period, available, count(*) OVER () AS expected, CAST(sum(CAST(available AS INT)) OVER () AS BIGINT) AS present FROM (SELECT CAST(m AS DATE) AS period, CAST(m AS DATE) IN (SELECT period FROM canon WHERE period <> DATE '{GAP}') AS available FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS m)))"),
    "month_set_compare": e(f"SELECT *, current_value - reference_value AS delta_abs, (current_value - reference_value) / nullif(reference_value, 0) AS delta_pct FROM (SELECT category, CAST(sum(CASE WHEN year(period) = 1998 THEN CAST(revenue_net AS DECIMAL(24,8)) END) AS DOUBLE) AS current_value, CAST(sum(CASE WHEN year(period) = 1997 THEN CAST(revenue_net AS DECIMAL(24,8)) END) AS DOUBLE) AS reference_value, count(DISTINCT month(period)) AS n_months FROM g WHERE year(period) IN (1997, 1998) AND month(period) IN (SELECT month(period) FROM g WHERE year(period) IN (1997, 1998) GROUP BY 1 HAVING count(DISTINCT year(period)) = 2) GROUP BY category)", MONTHLY),
}


def abc(source: str, by: str, entity: str) -> str:
    """Adds abc_share, cumulative_share and abc_class to a grain table."""
    return f"""(SELECT *, CASE WHEN x < 0 THEN 'NEGATIVE_OR_CORRECTION' WHEN x = 0 THEN 'UNCLASSIFIED' WHEN place = 1 OR cumulative_share <= 0.8 THEN 'A' WHEN cumulative_share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM
 (SELECT *, {r('p', 'sum(p) OVER (PARTITION BY ' + by + ')')} AS abc_share, CASE WHEN p IS NOT NULL THEN {r('sum(p) OVER w', 'sum(p) OVER (PARTITION BY ' + by + ')')} END AS cumulative_share,
 row_number() OVER (PARTITION BY {by} ORDER BY p DESC NULLS LAST, {entity}) AS place FROM (SELECT *, CAST(revenue_net AS DECIMAL(24,8)) AS x, CASE WHEN revenue_net > 0 THEN CAST(revenue_net AS DECIMAL(24,8)) END AS p FROM {source})
 WINDOW w AS (PARTITION BY {by} ORDER BY p DESC NULLS LAST, {entity} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def two(keys: str, cond: str = "true") -> str:
    return f"SELECT {keys}, {s(f'CASE WHEN period = {CUR} THEN revenue_net END')} AS current_value, {s(f'CASE WHEN period = {REF} THEN revenue_net END')} AS reference_value FROM e WHERE period IN ({CUR}, {REF}) AND {cond} GROUP BY {keys}"


_MOVE = f"""{grain('sku')}, q AS (SELECT period, category, sku, rank() OVER (PARTITION BY period, category ORDER BY revenue_net DESC) AS rk, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS sh FROM g),
 m AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.sku, b.sku) AS sku, a.rk AS current_rank, b.rk AS reference_rank, a.sh AS current_share, b.sh AS reference_share FROM (SELECT * FROM q WHERE period = {CUR}) a FULL JOIN (SELECT * FROM q WHERE period = {REF}) b ON a.category = b.category AND a.sku = b.sku)"""
_PRODUCTS = f"""prod AS (SELECT category, sku, any_value(is_own) AS is_own, any_value(carbonation) AS carbonation, any_value(package) AS package, any_value(volume_l) AS volume_l, {SUMS} FROM e WHERE period = {CUR} GROUP BY category, sku),
 seg AS (SELECT category, sku, is_own, carbonation, price, CASE WHEN price IS NULL THEN 'UNCLASSIFIED_PRICE_NULL' WHEN price <= 0 THEN 'UNCLASSIFIED_PRICE_INVALID' WHEN n < 3 THEN 'INSUFFICIENT_POPULATION' ELSE ['ECONOMY', 'MID', 'PREMIUM'][1 + least(2, CAST(floor((rk - 1) * 3 / n) AS INT))] END AS price_segment, CASE WHEN price > 0 THEN rk END AS price_rank FROM
 (SELECT *, avg_shelf_price AS price, count(*) OVER (PARTITION BY category, avg_shelf_price > 0) AS n, rank() OVER (PARTITION BY category, avg_shelf_price > 0 ORDER BY avg_shelf_price) AS rk FROM prod))"""


def ranked(name: str, by: str) -> str:
    return e(f"SELECT period, {GRAINS[name]}, revenue_net, rank() OVER (PARTITION BY {by} ORDER BY revenue_net DESC) AS rank, count(*) OVER (PARTITION BY {by}, revenue_net) AS tie_count, count(*) OVER (PARTITION BY {by}) AS population FROM g", grain(name))


_IDENT = "entity_type, entity_id, category, manufacturer, metric"
_FACTS = f"""{grain('category', 'g1')}, {grain('manufacturer', 'g0')}, g2 AS (SELECT *, CAST(sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category) AS DOUBLE) AS category_revenue, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS category_revenue_share FROM g0), f AS (""" + " UNION ALL ".join(
    f"SELECT period AS period_start, last_day(period) AS period_end, '{g}' AS entity_type, {ent} AS entity_id, category, {mf} AS manufacturer, '{m}' AS metric, {f"CASE WHEN {num} IS NOT NULL AND {den} IS NOT NULL THEN '{st}' ELSE 'period_only' END" if num != 'CAST(NULL AS DOUBLE)' else f"'{st}'"} AS range_strategy, {scope} AS share_scope, CAST({m} AS DOUBLE) AS value, {num} AS numerator, {den} AS denominator, CASE WHEN {m} IS NULL THEN 'null_value' ELSE 'valid' END AS quality_status FROM {src}"
    for g, ent, mf, src in (("category", "category", "CAST(NULL AS VARCHAR)", "g1"), ("manufacturer", "manufacturer", "manufacturer", "g2"))
    for m, st, num, den, scope in (
        *((m, "sum_available_periods", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)") for m in ("revenue_vat", "revenue_net", "units", "margin_abs")),
        ("margin_pct", "ratio_of_sums", "margin_abs", "revenue_net", "CAST(NULL AS VARCHAR)"), ("avg_shelf_price", "weighted_ratio_of_sums", "priced_value", "priced_units", "CAST(NULL AS VARCHAR)"),
        ("selling_stores", "period_only", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"), ("selling_skus", "period_only", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"),
        *((("category_revenue_share", "recompute_share_scope", "revenue_net", "category_revenue", "'category'"),) if src == "g2" else ()),
    )
) + ")"
_WINDOW = "period_start BETWEEN DATE '1998-01-01' AND DATE '1998-06-01'"
_WHOLE = lambda x: f"CASE WHEN count({x}) = count(*) THEN CAST(sum(CAST({x} AS DECIMAL(24,8))) AS DOUBLE) END"


def _ranges(where: str) -> str:
    return f"""SELECT {_IDENT}, st AS range_strategy, CASE WHEN limitation IS NULL THEN CASE WHEN st = 'sum_available_periods' THEN total ELSE num / den END END AS value, CASE WHEN parts THEN num END AS numerator, CASE WHEN parts THEN den END AS denominator, n_periods, limitation FROM (
 SELECT *, CASE WHEN st = 'sum_available_periods' AND total IS NULL THEN 'additive_value_missing' WHEN parts AND (num IS NULL OR den IS NULL) THEN 'range_components_missing' WHEN parts AND den = 0 THEN 'zero_range_denominator'
 WHEN st = 'recompute_share_scope' AND NOT one_scope THEN 'share_scope_missing_or_mixed' WHEN st = 'period_only' THEN 'range_aggregation_period_only' WHEN st <> 'sum_available_periods' AND NOT parts THEN 'range_aggregation_unsupported' END AS limitation FROM (
 SELECT {_IDENT}, range_strategy AS st, {_WHOLE('value')} AS total, {_WHOLE('numerator')} AS num, {_WHOLE('denominator')} AS den, count(*) AS n_periods, count(DISTINCT share_scope) = 1 AND count(share_scope) = count(*) AS one_scope,
 range_strategy IN ('ratio_of_sums', 'weighted_ratio_of_sums', 'recompute_from_components', 'recompute_share_scope') AS parts FROM f WHERE {where} GROUP BY ALL))"""


_SS = f"ss AS (SELECT period, sku, store, category, manufacturer, brand, store_format, region, {s('revenue_vat')} AS revenue_vat, {s('revenue_net')} AS revenue_net, {s(U)} AS units, {s('margin_abs')} AS margin_abs, CAST(sum(CAST(margin_abs IS NULL AS INT)) AS BIGINT) AS null_margins FROM e GROUP BY ALL)"
_D8 = lambda x: f"coalesce(CAST(sum(CAST({x} AS DECIMAL(24,8))) AS DOUBLE), 0.0)"

ORACLES |= {
    "abc_batch": e(f"SELECT period, category, sku, revenue_net, abc_share, cumulative_share, abc_class FROM {abc('g', 'period, category', 'sku')}", grain("sku")),
    "abc_portfolio": e(f"""SELECT category, manufacturer, revenue_net, CASE WHEN NOT neg THEN running END AS cumulative_share, CASE WHEN NOT neg THEN CASE WHEN x = 0 THEN 'C' WHEN place = 1 OR running <= 0.8 THEN 'A' WHEN running <= 0.95 THEN 'B' ELSE 'C' END END AS abc_class, CASE WHEN neg THEN 'abc_negative_values_not_applicable' END AS limitation FROM (
 SELECT *, min(x) OVER (PARTITION BY category) < 0 AS neg, row_number() OVER w AS place, {r('sum(x) OVER (PARTITION BY category ORDER BY x DESC, manufacturer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(x) OVER (PARTITION BY category)')} AS running FROM (SELECT *, CAST(revenue_net AS DECIMAL(24,8)) AS x FROM g) WINDOW w AS (PARTITION BY category ORDER BY x DESC, manufacturer))""", grain("manufacturer", where=f"period = {CUR}")),
    "rank_category": ranked("category", "period"),
    "rank_manufacturer": ranked("manufacturer", "period, category"),
    "rank_brand": ranked("brand", "period, category"),
    "rank_sku": ranked("sku", "period, category"),
    "rank_movement": e("SELECT category, sku, current_rank, reference_rank, reference_rank - current_rank AS rank_movement, CASE WHEN reference_rank IS NULL THEN 'NEW' WHEN current_rank IS NULL THEN 'EXITED' WHEN reference_rank > current_rank THEN 'IMPROVED' WHEN reference_rank < current_rank THEN 'DECLINED' ELSE 'UNCHANGED' END AS movement_state FROM m", _MOVE),
    "share_movement": e("SELECT category, sku, current_share, reference_share, (current_share - reference_share) * 100 AS share_pp FROM m", _MOVE),
    "entity_share_cumulative": e(f"SELECT period, category, brand, {r('revenue_net', 'sum(x) OVER (PARTITION BY period, category)')} AS share, {r('sum(x) OVER (PARTITION BY period, category ORDER BY revenue_net DESC, brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(x) OVER (PARTITION BY period, category)')} AS cumulative_share FROM (SELECT *, CAST(revenue_net AS DECIMAL(24,8)) AS x FROM g)", grain("brand")),
    "price_segments": e("SELECT category, sku, price, price_segment, price_rank FROM seg", _PRODUCTS),
    "peers_broad": e("SELECT a.sku AS target, count(*) AS n_peers FROM prod a JOIN prod b ON a.category = b.category AND a.sku <> b.sku AND NOT b.is_own GROUP BY 1", _PRODUCTS),
    "peers_topn": e("SELECT a.sku AS target, b.sku AS peer FROM prod a JOIN (SELECT * FROM prod WHERE NOT is_own) b ON a.category = b.category AND a.sku <> b.sku WHERE b.sku IN (SELECT sku FROM (SELECT sku, row_number() OVER (PARTITION BY category ORDER BY revenue_net DESC NULLS LAST, sku) AS a, row_number() OVER (PARTITION BY category ORDER BY units DESC NULLS LAST, sku) AS b FROM prod) WHERE a <= 10 OR b <= 10)", _PRODUCTS),
    "peers_direct": e("SELECT DISTINCT a.sku AS target, b.sku AS peer FROM seg a JOIN seg b ON a.category = b.category AND a.carbonation = b.carbonation AND a.price_segment = b.price_segment AND a.sku <> b.sku WHERE NOT b.is_own", _PRODUCTS),
    "benchmark_rank_percentile": e("SELECT *, CASE WHEN population > 1 THEN 1 - (rank + (ties - 1) / 2.0::DOUBLE - 1) / (population - 1) END AS percentile FROM (SELECT a.category, a.sku, a.is_own, a.revenue_net AS value, 1 + count(*) FILTER (WHERE b.revenue_net > a.revenue_net) AS rank, count(*) FILTER (WHERE b.revenue_net = a.revenue_net) + CAST(a.is_own AS INT) AS ties, count(b.sku) + CAST(a.is_own AS INT) AS population FROM prod a LEFT JOIN (SELECT * FROM prod WHERE NOT is_own) b ON a.category = b.category GROUP BY 1, 2, 3, 4)", _PRODUCTS),
    "relative_price": e("SELECT category, sku, price, peer_median, price - peer_median AS price_delta, price / peer_median * 100 AS price_index, (price - peer_median) / peer_median AS price_delta_pct FROM (SELECT a.category, a.sku, a.avg_shelf_price AS price, median(b.avg_shelf_price) AS peer_median FROM prod a LEFT JOIN (SELECT * FROM prod WHERE NOT is_own AND avg_shelf_price > 0) b ON a.category = b.category AND a.sku <> b.sku WHERE a.avg_shelf_price > 0 GROUP BY 1, 2, 3)", _PRODUCTS),
    "metric_facts": e("SELECT * FROM f", _FACTS),
    "duplicate_fact_identity": e(f"SELECT period_start, {_IDENT}, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1", _FACTS),
    "fact_scan": e(f"SELECT period_start, entity_id, metric, value FROM f WHERE {_WINDOW} AND metric IN ('revenue_net', 'units') AND entity_type = 'category' AND quality_status = 'valid'", _FACTS),
    "range_aggregate": e(_ranges(_WINDOW), _FACTS),
    "scoped_rollup": e(f"SELECT period_start, metric, {_D8('value')} AS value, count(DISTINCT entity_id) AS n_entities FROM f WHERE {_WINDOW} AND metric IN ('revenue_net', 'units') AND entity_id IN ('MFR_1', 'MFR_2') GROUP BY 1, 2", _FACTS),
    "sku_store_facts": e("SELECT * FROM ss", _SS),
    "store_universe": c("SELECT period, store, min(store_format) AS store_format, min(region) AS region, count(DISTINCT store_format) > 1 AS ambiguous_format FROM canon GROUP BY 1, 2"),
    "product_store_rollup": e(f"SELECT *, margin_abs / nullif(revenue_net, 0) AS margin_pct FROM (SELECT period, category, store_format, {_D8('revenue_vat')} AS revenue_vat, {_D8('revenue_net')} AS revenue_net, {_D8('units')} AS units, {_D8('margin_abs')} AS margin_abs, CAST(sum(null_margins) AS BIGINT) AS null_margins, count(DISTINCT sku) AS n_skus, count(DISTINCT store) AS n_stores FROM ss GROUP BY 1, 2, 3)", _SS),
    "catalog_match": e("SELECT metric, n_facts, label, enabled, CASE WHEN label IS NULL THEN 'metric_not_in_catalog' WHEN NOT enabled THEN 'metric_disabled' END AS limitation FROM (SELECT metric, count(*) AS n_facts FROM f GROUP BY 1) LEFT JOIN (VALUES ('revenue_net', 'Net revenue', true), ('units', 'Pieces', false), ('margin_pct', 'Margin', true), ('margin_abs', 'Margin sum', true)) v(metric, label, enabled) USING (metric)", _FACTS),
    "provenance": e("SELECT metric, min(period_start) AS first_period, max(period_start) AS last_period, count(DISTINCT period_start) AS n_periods, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS grains, string_agg(DISTINCT quality_status, ',' ORDER BY quality_status) AS quality FROM f GROUP BY 1", _FACTS),
    "store_format_distribution": e(f"SELECT q.period, q.brand, u.store_format, format_stores, coalesce(selling_stores, 0) AS selling_stores, {r('coalesce(selling_stores, 0)', 'format_stores')} AS numeric_distribution FROM (SELECT DISTINCT period, brand FROM e) q JOIN (SELECT period, store_format, count(DISTINCT store) AS format_stores FROM e GROUP BY 1, 2) u USING (period) LEFT JOIN (SELECT period, store_format, brand, {STORES} AS selling_stores FROM e GROUP BY 1, 2, 3) a ON a.period = q.period AND a.brand = q.brand AND a.store_format = u.store_format"),
}


def kpi(keys: str, where: str, join: str) -> str:
    litre = f"CAST({U} * CAST(volume_l AS DECIMAL(10,3)) AS DECIMAL(24,8))"
    market = f"(SELECT {'period, ' if 'period' in keys else ''}{STORES} AS active_stores FROM e WHERE {where}{' GROUP BY period' if 'period' in keys else ''})"
    return f"""SELECT a.*, active_stores, {r('units', 'selling_stores')} AS velocity, {r('selling_stores', 'active_stores')} AS distribution FROM (SELECT {keys}, {s(U)} AS units, {s('revenue_vat')} AS revenue_vat, {STORES} AS selling_stores,
 {r('sum(CASE WHEN volume_l > 0 THEN revenue_vat END)', f'sum(CASE WHEN volume_l > 0 THEN {litre} END)')} AS price_per_litre FROM e WHERE {where} GROUP BY {keys}) a {join.format(market)}"""


_HALF = "period BETWEEN DATE '1998-01-01' AND DATE '1998-06-01'"
_SEG = "seg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS universe, x.* FROM ({two('category', w)}) x" for n, w in (("TOTAL_MARKET", "true"), ("MARKET_EX_PRIVATE_LABEL", "NOT private_label"), ("PRIVATE_LABEL", "private_label"), ("OWN_PORTFOLIO", "is_own"))) + "), segd AS (SELECT category, universe, current_value, reference_value, current_value - reference_value AS delta_abs, (current_value - reference_value) / nullif(reference_value, 0) AS delta_pct, CASE WHEN reference_value = 0 THEN 'ZERO_REFERENCE_DENOMINATOR' ELSE 'READY' END AS state FROM seg)"
_EV = f"""{grain('manufacturer', 'g0')}, g AS (SELECT period, category || '|' || manufacturer AS entity_id, revenue_net FROM g0), cmp AS ({compare(('entity_id',), 'revenue_net', YOY, 'g', 'YOY')}),
 ab AS (SELECT period, entity_id, abc_class FROM {abc('g', 'period', 'entity_id')}),
 ev AS (SELECT 'comparison' AS feature, entity_id, period, current_value, reference_value, delta_pct, comparison_quality, CAST(NULL AS VARCHAR) AS abc_class, CAST(NULL AS VARCHAR) AS reference_abc_class, CAST(NULL AS BOOLEAN) AS label_changed FROM cmp
 UNION ALL SELECT 'abc', ab.entity_id, ab.period, NULL, NULL, NULL, NULL, ab.abc_class, p.abc_class, ab.abc_class <> p.abc_class FROM ab LEFT JOIN ab p ON p.entity_id = ab.entity_id AND p.period = CAST(ab.period - INTERVAL 12 MONTH AS DATE)),
 det AS (SELECT rule_id, event_type, severity, entity_id, period, current_value, reference_value, delta_pct, comparison_quality, CASE WHEN comparison_quality = 'LOW' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM ev JOIN (VALUES ('revenue_up', 'MATERIAL_REVENUE_GROWTH', 'INFO'), ('revenue_down', 'MATERIAL_REVENUE_DECLINE', 'WARNING'), ('abc_change', 'ABC_CLASS_CHANGE', 'INFO')) v(rule_id, event_type, severity)
 ON (rule_id = 'revenue_up' AND feature = 'comparison' AND delta_pct >= 0.10) OR (rule_id = 'revenue_down' AND feature = 'comparison' AND delta_pct <= -0.10) OR (rule_id = 'abc_change' AND feature = 'abc' AND label_changed))"""
_REV = "rev AS (SELECT 'retailer_a' AS retailer_id, store AS source_id, year(period) AS revision, CAST(count(*) AS VARCHAR) AS content_hash, max(period) AS activated FROM canon GROUP BY 1, 2, 3)"

ORACLES |= {
    "kpi_period": e(kpi("period, brand", "true", "JOIN {} USING (period)")),
    "kpi_range": e(kpi("brand", _HALF, "CROSS JOIN {}")),
    "kpi_weighted_distribution": e(f"SELECT period, category, sku, {r('sum(bs.r)', 'any_value(total)')} AS weighted_distribution FROM (SELECT DISTINCT period, category, sku, store FROM e WHERE units > 0) JOIN bs USING (period, category, store) JOIN (SELECT period, category, sum(r) AS total FROM bs GROUP BY 1, 2) USING (period, category) GROUP BY 1, 2, 3", "bs AS (SELECT period, category, store, sum(revenue_vat) AS r FROM e GROUP BY 1, 2, 3)"),
    "category_share": e(f"SELECT category, manufacturer, revenue_net, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY category)')} AS share FROM (SELECT category, manufacturer, {s('revenue_net')} AS revenue_net FROM e WHERE {_HALF} GROUP BY 1, 2)"),
    "served_category_share": e(compare(("category", "manufacturer"), "share", YOY, "g", "YOY", True, ", CASE WHEN b.share IS NOT NULL THEN 'READY' ELSE 'PARTIAL' END AS status"), f"{grain('manufacturer', 'g0')}, g AS (SELECT *, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS share FROM g0)"),
    "active_sku_peak": c(f"SELECT *, min(CASE WHEN active_skus = peak_skus THEN period END) OVER (PARTITION BY manufacturer) AS peak_period, active_skus - peak_skus AS change_from_peak FROM (SELECT manufacturer, period, active_skus, max(active_skus) OVER (PARTITION BY manufacturer) AS peak_skus FROM (SELECT m.manufacturer, p.period, coalesce(n, 0) AS active_skus FROM (SELECT DISTINCT manufacturer FROM canon) m CROSS JOIN (SELECT DISTINCT period FROM canon) p LEFT JOIN (SELECT manufacturer, period, {SKUS} AS n FROM canon GROUP BY 1, 2) x ON x.manufacturer = m.manufacturer AND x.period = p.period))"),
    "regional_summary": e(f"SELECT period, region, CAST(r AS DOUBLE) AS revenue_net, units, n_stores, {r('r', 'sum(r) OVER (PARTITION BY period)')} AS share FROM (SELECT period, region, sum(revenue_net) AS r, {s(U)} AS units, count(DISTINCT store) AS n_stores FROM e GROUP BY 1, 2)"),
    "geography_breakdown": e(f"SELECT *, (revenue_net - reference_revenue) / nullif(abs(reference_revenue), 0) AS delta_pct FROM (SELECT region, store_format, {s(f'CASE WHEN period = {CUR} THEN revenue_net END')} AS revenue_net, {s(f'CASE WHEN period = {REF} THEN revenue_net END')} AS reference_revenue, {s(f'CASE WHEN period = {CUR} THEN {U} END')} AS units, {r(f'sum(CASE WHEN period = {CUR} THEN margin_abs END)', f'sum(CASE WHEN period = {CUR} THEN revenue_net END)')} AS margin_pct, count(DISTINCT CASE WHEN period = {CUR} THEN store END) AS n_stores FROM e WHERE period IN ({CUR}, {REF}) GROUP BY 1, 2)"),
    "package_volume_mix": e(f"SELECT package, volume_range, coalesce(CAST(c AS DOUBLE), 0.0) AS revenue_net, n_skus, {r('c', 'sum(c) OVER ()')} AS share, {r('r', 'sum(r) OVER ()')} AS reference_share, ({r('c', 'sum(c) OVER ()')} - {r('r', 'sum(r) OVER ()')}) * 100 AS share_pp FROM (SELECT package, {vrange('volume_l')} AS volume_range, sum(CASE WHEN period = {CUR} THEN revenue_net END) AS c, sum(CASE WHEN period = {REF} THEN revenue_net END) AS r, count(DISTINCT CASE WHEN period = {CUR} THEN sku END) AS n_skus FROM e WHERE period IN ({CUR}, {REF}) AND sku IN (SELECT sku FROM e WHERE period IN ({CUR}, {REF}) GROUP BY sku HAVING count(DISTINCT package) = 1 AND count(DISTINCT volume_l) = 1) GROUP BY 1, 2)"),
    "diagnostics_breakdown": e(f"SELECT *, current_revenue_net - reference_revenue_net AS revenue_delta, current_margin_abs / nullif(current_revenue_net, 0) AS margin_pct, current_skus - reference_skus AS sku_delta FROM (SELECT brand, " + ", ".join(f"{s(f'CASE WHEN period = {p} THEN {m} END')} AS {n}_{m}" for n, p in (("current", CUR), ("reference", REF)) for m in ("revenue_net", "margin_abs")) + f", count(DISTINCT CASE WHEN period = {CUR} AND units > 0 THEN sku END) AS current_skus, count(DISTINCT CASE WHEN period = {REF} AND units > 0 THEN sku END) AS reference_skus FROM e WHERE period IN ({CUR}, {REF}) GROUP BY brand)"),
    "entity_options": c("SELECT category, brand, sku, count(DISTINCT period) AS n_periods, min(trim(sku_name)) AS label FROM canon GROUP BY 1, 2, 3"),
    "volume_facet": c(f"SELECT {vrange('volume_l')} AS volume_range, round(volume_l, 6) AS volume, count(DISTINCT sku) AS n_skus FROM canon WHERE volume_l > 0 GROUP BY 1, 2"),
    "coverage_grid": c(f"SELECT CAST(m AS DATE) AS period, CAST(m AS DATE) IN (SELECT period FROM canon WHERE period <> DATE '{GAP}') AS available FROM (SELECT unnest(generate_series(CAST((SELECT min(period) FROM canon) AS TIMESTAMP), CAST((SELECT max(period) FROM canon) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m)"),
    **{f"contribution{'' if (p, k) == ('category', 'brand') else f'_{p}_{k}'}": e(f"""SELECT {p + ', ' if p != 'network' else ''}{k}, current_value, reference_value, delta_abs, parent_delta, delta_abs / nullif(parent_delta, 0) AS contribution, '' AS flags, CASE WHEN parent_delta = 0 THEN 'TOTAL_DELTA_ZERO' ELSE 'READY' END AS state FROM (
 SELECT a.*, CAST(CAST(a.current_value - a.reference_value AS DECIMAL(24,6)) AS DOUBLE) AS delta_abs, CAST(CAST(b.current_value - b.reference_value AS DECIMAL(24,6)) AS DOUBLE) AS parent_delta FROM ({two(f'{p}, {k}' if p != 'network' else k)}) a JOIN ({two(p if p != 'network' else "'ALL' AS one").replace("GROUP BY 'ALL' AS one", "GROUP BY 1")}) b ON {f'a.{p} = b.{p}' if p != 'network' else 'true'}) ORDER BY abs(delta_abs) DESC, current_value DESC, {p + ', ' if p != 'network' else ''}{k} LIMIT 200""") for p, k in (("category", "brand"), ("network", "category"), ("category", "manufacturer"), ("category", "sku"))},
    "market_segment_delta": e("SELECT * FROM segd", _SEG),
    "segment_patterns": e("SELECT *, CASE WHEN own_pct < 0 AND market_pct < 0 THEN own_pct / nullif(market_pct, 0) END AS decline_speed, coalesce(private_label_pct > 0 AND own_pct < 0, false) AS private_label_gains FROM (SELECT category, max(CASE WHEN universe = 'TOTAL_MARKET' THEN delta_pct END) AS market_pct, max(CASE WHEN universe = 'PRIVATE_LABEL' THEN delta_pct END) AS private_label_pct, max(CASE WHEN universe = 'OWN_PORTFOLIO' THEN delta_pct END) AS own_pct FROM segd GROUP BY 1)", _SEG),
    "brand_vs_category": e(f"SELECT category, brand, brand_pct, category_pct, (brand_pct - category_pct) * 100 AS gap_pp FROM (SELECT category, brand, (current_value - reference_value) / nullif(reference_value, 0) AS brand_pct FROM ({two('category, brand')})) JOIN (SELECT category, (current_value - reference_value) / nullif(reference_value, 0) AS category_pct FROM ({two('category')})) USING (category)"),
    "manufacturer_population": c("SELECT period, category, count(DISTINCT manufacturer) AS population FROM canon GROUP BY 1, 2"),
    "event_facts": e("SELECT * FROM ev", _EV),
    "events_simple": e("SELECT * FROM det", _EV),
    "events_composite": e("SELECT * FROM (SELECT entity_id, period, max(CASE WHEN feature = 'comparison' THEN delta_pct END) AS comparison_delta_pct, max(CASE WHEN feature = 'abc' THEN abc_class END) AS abc_abc_class FROM ev GROUP BY 1, 2) WHERE comparison_delta_pct <= -0.10 AND abc_abc_class = 'A'", _EV),
    "event_missing_features": e("SELECT rule_id, feature FROM (VALUES ('revenue_up', 'comparison'), ('revenue_down', 'comparison'), ('abc_change', 'abc'), ('price_gap', 'benchmark')) v(rule_id, feature) WHERE feature NOT IN (SELECT feature FROM ev)", _EV),
    "ledger_register": c("SELECT retailer_id, source_id, revision, content_hash, CASE WHEN EXISTS (SELECT 1 FROM rev l WHERE l.revision <= 1997 AND l.source_id <> 'STORE_1' AND l.source_id = rev.source_id AND l.content_hash = rev.content_hash) THEN 'IDENTICAL_DUPLICATE' WHEN source_id <> 'STORE_1' AND EXISTS (SELECT 1 FROM rev l WHERE l.revision <= 1997 AND l.source_id = rev.source_id) THEN 'NEW_REVISION' ELSE 'NEW_ARTIFACT' END AS registration FROM rev WHERE revision >= 1997", _REV),
    "ledger_activate": c("SELECT retailer_id, source_id, revision, period, row_number() OVER (PARTITION BY source_id, period ORDER BY revision DESC) = 1 AS is_active FROM (SELECT DISTINCT 'retailer_a' AS retailer_id, store AS source_id, year(period) AS revision, period FROM canon UNION ALL SELECT 'retailer_a', source_id, 9999, period FROM (SELECT source_id, period, row_number() OVER (PARTITION BY source_id ORDER BY period) AS k FROM (SELECT DISTINCT store AS source_id, period FROM canon WHERE year(period) = 1997)) WHERE k <= 3)"),
    "source_rows_page": c("SELECT period, store, sku, units, CAST(revenue_vat AS DOUBLE) AS revenue_vat, shelf_price_vat FROM canon ORDER BY period, store, sku, units, CAST(revenue_vat AS DOUBLE), shelf_price_vat LIMIT 100 OFFSET 200"),
    "incremental_rebuild": e("SELECT period, category, revenue_net, units FROM g WHERE period IN (DATE '1998-02-01', DATE '1998-03-01', DATE '1999-02-01')", grain("category")),
}

_CORE = {"revenue_vat": "revenue_vat", "revenue": "revenue_net", "units": "units", "retailer_margin_abs": "margin_abs", "retailer_margin_pct": "margin_pct", "weighted_shelf_price_vat": "avg_shelf_price", "weighted_input_price_vat": "avg_input_price"}
_MORE = {"store_count": "CAST(stores AS DOUBLE)", "selling_store_count": "CAST(selling_stores AS DOUBLE)", "active_store_count": "CAST(active_stores AS DOUBLE)", "distribution": r("selling_stores", "active_stores"), "units_per_selling_store": r("units", "selling_stores"), "revenue_per_selling_store": r("revenue_net", "selling_stores"), "margin_per_selling_store": r("margin_abs", "selling_stores")}
_STORE = {f"assortment_{k}_count": f"CAST(selling_{k}s AS DOUBLE)" for k in ("sku", "brand", "category")}


def _wide(name: str) -> str:
    keys = f"period{', ' + GRAINS[name] if GRAINS[name] else ''}"
    used = "units > 0 AND input_price_vat IS NOT NULL"
    return f"""w_{name} AS (SELECT w.*, active_stores FROM (SELECT {keys}, {SUMS}, {r(f'sum(CASE WHEN {used} THEN CAST(input_price_vat * units AS DECIMAL(24,8)) END)', f'sum(CASE WHEN {used} THEN {U} END)')} AS avg_input_price, count(DISTINCT store) AS stores,
 count(DISTINCT CASE WHEN units > 0 THEN brand END) AS selling_brands, count(DISTINCT CASE WHEN units > 0 THEN category END) AS selling_categorys FROM e GROUP BY {keys}) w JOIN act USING (period))"""


def _long() -> str:
    parts = []
    for g, keys in GRAINS.items():
        concepts = _CORE | (_MORE if g in ("category", "manufacturer", "brand", "sku") else _STORE if g == "store" else {})
        entity = keys.split(", ")[-1] if keys else "'ALL'"
        parts += [f"SELECT period, '{g}' AS entity_type, {entity} AS entity_id, '{k}' AS concept, '{g}_{k}' AS metric_name, CAST({v} AS DOUBLE) AS metric_value FROM w_{g}" for k, v in concepts.items()]
    return " UNION ALL ".join(parts)


_NUM = f"num AS (SELECT *, row_number() OVER (ORDER BY period, store, {', '.join(f'{k} NULLS FIRST' for k in CANONICAL if k not in ('period', 'store'))}) AS source_row_number FROM canon)"
_REVS = "rv AS (SELECT 'retailer_a' AS retailer_id, store AS source_id, year(period) AS revision, list_sort(list(DISTINCT period)) AS periods, CAST(count(*) AS VARCHAR) AS content_hash, max(period) AS activated FROM canon GROUP BY store, year(period))"
_ACT = f"{_REVS}, fixed AS (SELECT * FROM rv UNION ALL SELECT retailer_id, source_id, 9999, periods[1:3], content_hash, DATE '2005-01-01' FROM rv WHERE revision = 1997), ac AS (SELECT retailer_id, source_id, revision, period, row_number() OVER (PARTITION BY retailer_id, source_id, period ORDER BY activated DESC, revision DESC) = 1 AS is_active FROM (SELECT retailer_id, source_id, revision, activated, unnest(periods) AS period FROM fixed))"
ORACLES |= {
    "metric_definitions": e(_long(), ", ".join((_ACTIVE, *(_wide(g) for g in GRAINS)))),
    "comparison_issues": e("SELECT period, issue_code, n_rows FROM (SELECT period, 'MISSING_COMPARISON_BASE' AS issue_code, count(*) FILTER (WHERE reference_value IS NULL) AS n_rows FROM x GROUP BY 1 UNION ALL SELECT period, 'ZERO_METRIC_DENOMINATOR', count(*) FILTER (WHERE reference_value = 0) FROM x GROUP BY 1) WHERE n_rows > 0 UNION ALL SELECT period, 'MISSING_COMPARISON_BASE', count(*) FROM g WHERE period NOT IN (SELECT period FROM x) GROUP BY 1", f"{MONTHLY}, x AS ({compare(('category',), 'revenue_net', YOY, 'g', 'YOY')})"),
    "fact_comparison": e(f"SELECT a.entity_type, a.entity_id, a.category, a.manufacturer, a.metric, a.value AS current_value, b.value AS reference_value, a.value - b.value AS delta_abs, (a.value - b.value) / nullif(b.value, 0) AS delta_pct FROM f a JOIN f b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.category = b.category AND a.manufacturer IS NOT DISTINCT FROM b.manufacturer AND a.metric = b.metric WHERE a.period_start = {CUR} AND b.period_start = {REF}", _FACTS),
    "month_set_ranges": e("SELECT a.entity_type, a.entity_id, a.category, a.manufacturer, a.metric, a.value AS current_value, a.n_periods, a.limitation, b.value AS reference_value, a.value - b.value AS delta_abs, (a.value - b.value) / nullif(b.value, 0) AS delta_pct FROM a JOIN b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.category = b.category AND a.manufacturer IS NOT DISTINCT FROM b.manufacturer AND a.metric = b.metric",
        f"{_FACTS}, m AS (SELECT month(period_start) AS m FROM f WHERE year(period_start) IN (1997, 1998) GROUP BY 1 HAVING count(DISTINCT year(period_start)) = 2), a AS ({_ranges('year(period_start) = 1998 AND month(period_start) IN (SELECT m FROM m)')}), b AS ({_ranges('year(period_start) = 1997 AND month(period_start) IN (SELECT m FROM m)')})"),
    "metric_templates": e("SELECT metric, max(period_start) AS period_start, arg_max(range_strategy, (period_start, range_strategy)) AS range_strategy, any_value(share_scope) AS share_scope FROM f GROUP BY metric", _FACTS),
    "filter_grain_rollup": e(f"SELECT period, 'store' AS entity_type, store AS entity_id, CAST(sum(CAST(revenue_net AS DECIMAL(24,8))) AS DOUBLE) AS revenue_net, CAST(sum(CAST(units AS DECIMAL(24,8))) AS DOUBLE) AS units, CAST(sum(CAST(margin_abs AS DECIMAL(24,8))) AS DOUBLE) AS margin_abs FROM ss WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#7', 'Brand#8') AND store IN ('STORE_1', 'STORE_2', 'STORE_3') GROUP BY period, store", _SS),
    "sign_issues": c("SELECT issue_code, severity, count(*) AS n_rows, min(source_row_number) AS first_row, max(source_row_number) AS last_row FROM (SELECT source_row_number, CASE WHEN units < 0 AND revenue_vat < 0 THEN 'BUSINESS_EXCEPTION' WHEN units >= 0 AND revenue_vat >= 0 THEN NULL ELSE 'SUSPICIOUS' END AS issue_code, CASE WHEN units < 0 AND revenue_vat < 0 THEN 'INFO' ELSE 'WARNING' END AS severity FROM num) WHERE issue_code IS NOT NULL GROUP BY 1, 2", _NUM),
    "price_issues": c("SELECT 'MISSING_OPTIONAL_PRICE' AS issue_code, 'input_price_vat' AS field, count(*) AS n_rows, min(source_row_number) AS first_row, max(source_row_number) AS last_row FROM num WHERE input_price_vat IS NULL HAVING count(*) > 0", _NUM),
    "quality_summary": c("SELECT CASE WHEN units >= 0 AND revenue_vat >= 0 THEN 'valid' ELSE 'review' END AS quality_status, concat_ws(',', CASE WHEN input_price_vat IS NULL THEN 'no_input_price' END, CASE WHEN private_label IS NULL THEN 'unknown_private_label' END) AS quality_flags, count(*) AS n_rows FROM canon GROUP BY 1, 2"),
    "row_sequence": c("SELECT count(*) AS n_rows, 1 AS first, count(*) AS last, count(*) AS n_numbers, true AS in_sequence FROM canon"),
    "totals_reconcile": c(f"SELECT measure, total AS source_total, total AS made_total, true AS reconciled FROM (SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS total FROM canon UNION ALL SELECT 'units', CAST(sum({U}) AS DOUBLE) FROM canon)"),
    "latest_priced_period": c("SELECT category, max(CASE WHEN shelf_price_vat > 0 THEN period END) AS benchmark_period FROM canon GROUP BY 1"),
    "product_filter": e(f"SELECT period, count(*) AS n_rows, CAST(sum(CAST(revenue_net AS DECIMAL(24,8))) AS DOUBLE) AS revenue_net FROM ss WHERE sku IN (SELECT sku FROM canon WHERE package IN (SELECT min(package) FROM canon)) GROUP BY 1", _SS),
    "active_revisions": c("SELECT retailer_id, source_id, revision, array_to_string(list_sort(list(DISTINCT strftime(period, '%Y-%m-%d'))), ',') AS periods FROM ac WHERE is_active GROUP BY 1, 2, 3", _ACT),
    "revision_ids": c("SELECT source_id, revision, 'source_artifact_' || substr(sha256(retailer_id || '|' || source_id || '|' || content_hash), 1, 16) AS source_artifact_id, 'source_revision_' || substr(sha256(retailer_id || '|' || source_id || '|' || content_hash || '|' || revision), 1, 16) AS source_revision_id FROM rv", _REVS),
    "inactive_facts": c("SELECT x.source_id, x.period, x.revision, ac.revision AS expected FROM (SELECT store AS source_id, period, year(period) AS revision FROM canon GROUP BY ALL) x LEFT JOIN (SELECT * FROM ac WHERE is_active) ac ON ac.source_id = x.source_id AND ac.period = x.period WHERE x.revision IS DISTINCT FROM ac.revision", _ACT),
    "build_coverage": c("SELECT a.source_id, count(*) AS n_active, count(b.period) AS n_held, min(a.period) AS first_period, max(a.period) AS last_period FROM (SELECT DISTINCT source_id, period FROM ac WHERE is_active) a LEFT JOIN (SELECT DISTINCT store AS source_id, period FROM canon WHERE period < DATE '1998-01-01') b ON a.source_id = b.source_id AND a.period = b.period GROUP BY 1", _ACT),
    "resolve_build": c("SELECT source_id AS retailer_id, CAST(max(revision) FILTER (WHERE revision = 1997) AS VARCHAR) AS mart_build_id, count(*) AS n_builds, 'RESOLVED' AS state FROM rv GROUP BY 1 HAVING count(*) FILTER (WHERE revision = 1997) = 1 UNION ALL SELECT source_id, CASE WHEN count(*) = 1 THEN CAST(max(revision) AS VARCHAR) END, count(*), CASE WHEN count(*) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS_BUILD' END FROM rv GROUP BY 1 HAVING count(*) FILTER (WHERE revision = 1997) <> 1", _REVS),
    "period_modes": c("SELECT mode, count(DISTINCT period) AS n_periods, count(*) AS n_rows FROM (SELECT 'SINGLE_PERIOD' AS mode, period FROM canon WHERE period = DATE '1998-03-01' UNION ALL SELECT 'DATE_RANGE', period FROM canon WHERE period BETWEEN DATE '1998-01-01' AND DATE '1998-06-01' UNION ALL SELECT 'AVAILABLE_MONTH_SET', period FROM canon WHERE year(period) IN (2000, 2001) AND month(period) IN (SELECT month(period) FROM canon WHERE year(period) IN (2000, 2001) GROUP BY 1 HAVING count(DISTINCT year(period)) = 2) UNION ALL SELECT 'FULL_AVAILABLE_HISTORY', period FROM canon) GROUP BY 1"),
    "gated_events": e("SELECT rule_id, count(*) AS n FROM det WHERE (SELECT count(*) FROM canon WHERE units IS NULL) = 0 GROUP BY 1", _EV),
    "events_deduplicated": e("SELECT rule_id, count(*) AS n_events, CAST(sum(1) AS BIGINT) * 2 AS n_rows, 0 AS n_conflicts FROM det GROUP BY 1", _EV),
}

_FEATURES = ("revenue_net", "units", "margin_abs", "margin_pct", "avg_shelf_price", "category_revenue_share", "numeric_distribution", "units_per_store")
_CF = f"""{grain('manufacturer', 'g0')}, act AS (SELECT period, {STORES} AS active_stores FROM e GROUP BY period),
 w AS (SELECT g0.*, category || '|' || manufacturer AS entity_id, {r('revenue_net', 'sum(CAST(revenue_net AS DECIMAL(24,8))) OVER (PARTITION BY period, category)')} AS category_revenue_share, {r('selling_stores', 'active_stores')} AS numeric_distribution,
 {r('units', 'selling_stores')} AS units_per_store FROM g0 JOIN act USING (period)),
 g AS (SELECT period, entity_id, unnest([{', '.join(f"'{m}'" for m in _FEATURES)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in _FEATURES)}]) AS value FROM w),
 cmp AS (SELECT * REPLACE (CASE WHEN metric IN ('margin_pct', 'numeric_distribution', 'category_revenue_share') THEN delta_abs END AS delta_pp) FROM ({compare(('entity_id', 'metric'), 'value', YOY, 'g', 'YOY')}))"""
_KINDS = [
    ("MATERIAL_REVENUE_GROWTH", "GROWTH_DECLINE", "revenue_net", "delta_pct >= 0.10"), ("MATERIAL_REVENUE_DECLINE", "GROWTH_DECLINE", "revenue_net", "delta_pct <= -0.10"),
    ("MATERIAL_UNITS_GROWTH", "GROWTH_DECLINE", "units", "delta_pct >= 0.10"), ("MATERIAL_UNITS_DECLINE", "GROWTH_DECLINE", "units", "delta_pct <= -0.10"),
    ("MATERIAL_MARGIN_GROWTH", "GROWTH_DECLINE", "margin_abs", "delta_pct >= 0.10"), ("MATERIAL_MARGIN_DECLINE", "GROWTH_DECLINE", "margin_abs", "delta_pct <= -0.10"),
    ("DISTRIBUTION_GAIN", "DISTRIBUTION", "numeric_distribution", "delta_abs >= 0.05"), ("DISTRIBUTION_LOSS", "DISTRIBUTION", "numeric_distribution", "delta_abs <= -0.05"),
    ("VELOCITY_GAIN", "VELOCITY", "units_per_store", "delta_pct >= 0.10"), ("VELOCITY_LOSS", "VELOCITY", "units_per_store", "delta_pct <= -0.10"), ("STABLE_VELOCITY", "VELOCITY", "units_per_store", "delta_pct BETWEEN -0.05 AND 0.05"),
    ("SHARE_GAIN", "SHARE", "category_revenue_share", "delta_abs >= 0.005"), ("SHARE_LOSS", "SHARE", "category_revenue_share", "delta_abs <= -0.005"),
    ("PRICE_INCREASE", "PRICE", "avg_shelf_price", "delta_pct >= 0.03"), ("PRICE_DECREASE", "PRICE", "avg_shelf_price", "delta_pct <= -0.03"),
    ("MARGIN_PCT_GAIN", "MARGIN_PCT", "margin_pct", "delta_abs >= 0.01"), ("MARGIN_PCT_EROSION", "MARGIN_PCT", "margin_pct", "delta_abs <= -0.01"),
]
ORACLES |= {
    "compare_features": e("SELECT * FROM cmp", _CF),
    "event_families": e(" UNION ALL ".join(f"SELECT '{k}' AS event_type, '{f}' AS event_family, entity_id, period, metric, current_value, reference_value, delta_pct, delta_pp, CASE WHEN comparison_quality = 'LOW' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM cmp WHERE metric = '{m}' AND {x}" for k, f, m, x in _KINDS), _CF),
    "event_patterns": e("""SELECT kind AS event_type, 'PATTERN_CANDIDATE' AS event_family, entity_id, period, p.delta_pct AS avg_shelf_price, u.delta_pct AS units FROM (SELECT * FROM cmp WHERE metric = 'avg_shelf_price') p JOIN (SELECT * FROM cmp WHERE metric = 'units') u USING (entity_id, period)
 JOIN (VALUES ('PRICE_POWER_PATTERN'), ('PRICE_PRESSURE_PATTERN'), ('PROMO_LIKE_PATTERN')) k(kind) ON (kind = 'PRICE_POWER_PATTERN' AND p.delta_pct >= 0.03 AND u.delta_pct >= 0) OR (kind = 'PRICE_PRESSURE_PATTERN' AND p.delta_pct >= 0.03 AND u.delta_pct <= -0.10) OR (kind = 'PROMO_LIKE_PATTERN' AND p.delta_pct <= -0.03 AND u.delta_pct >= 0.10)""", _CF),
    "event_candidates": e("SELECT 'any' AS rule_id, metric, count(*) AS n_facts FROM cmp GROUP BY metric UNION ALL SELECT 'good', metric, count(*) FROM cmp WHERE comparison_quality = 'HIGH' GROUP BY metric", _CF),
}
