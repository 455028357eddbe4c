"""All registered queries of the retail engine over the canonical sales view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import exact_sum, ratio, volume_filter, volume_range
from ..operators import benchmarking as B
from ..operators import breakdowns as D
from ..operators import definitions as N
from ..operators import economics as E
from ..operators import events as V
from ..operators import governance as G
from ..operators import ingest as I
from ..operators import mart as M
from ..operators import metrics as K
from ..operators import periods as P
from ..operators import portfolio as Q
from ..sources.tables import load_canonical, table
from ..streaming import incremental as S
from . import mart_oracles, mart_queries
from .inputs import based, dealt, enriched, grain_facts, month
from .oracles import CURRENT, GAP, ORACLES, REFERENCE

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def category_month_economics(spark, d):
    return K.grain_metrics(based(spark, d), "category").select("period", "category", "revenue_vat", "revenue_net", "units", "margin_pct", "avg_shelf_price")


@query
def canonical_sales(spark, d):
    return load_canonical(spark, d).withColumn("revenue_vat", F.col("revenue_vat").cast("double"))


@query
def source_profile(spark, d):
    return I.source_profile(load_canonical(spark, d))


@query
def duplicate_grain_rows(spark, d):
    return I.duplicate_grain(load_canonical(spark, d))


@query
def store_alias(spark, d):
    aliases = spark.createDataFrame([("STORE_1", "STORE_1"), ("STORE_2", "STORE_1")], "source_store string, canonical_store string")
    return I.canonical_stores(load_canonical(spark, d), aliases).groupBy("canonical_store").agg(F.count("*").alias("n_rows"), F.countDistinct("store").alias("n_sources"))


@query
def semantic_value_map(spark, d):
    mapped = I.map_values(load_canonical(spark, d), "store_format", {"HYPER": "hypermarket", "SUPER": "supermarket"})
    return mapped.groupBy("store_format", "value_issue").agg(F.count("*").alias("n_rows"))


@query
def period_normalise(spark, d):
    raw = table(spark, d, "lineitem").selectExpr("CAST(year(l_shipdate) AS STRING) AS y", "CASE l_linenumber WHEN 1 THEN '13' WHEN 2 THEN 'march' WHEN 3 THEN NULL ELSE CAST(month(l_shipdate) AS STRING) END AS m")
    return I.normalise_period(raw, "y", "m").groupBy("period", "period_issue").agg(F.count("*").alias("n_rows"))


@query
def type_issues(spark, d):
    raw = table(spark, d, "lineitem").selectExpr("CASE l_linenumber WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE CAST(l_partkey AS STRING) END AS text")
    return raw.groupBy(I.numeric_issue("text").alias("issue")).agg(F.count("*").alias("n_rows"))


@query
def tax_resolution(spark, d):
    rows = E.resolve_tax(load_canonical(spark, d), E.tax_rules(spark))
    return rows.groupBy("period", "category_group", "tax_rule_id", "tax_rate").agg(F.count("*").alias("n_rows"))


@query
def tax_rule_issues(spark, d):
    rules = (("a", "1996-01-01", "1998-12-31", 0.2, "CATEGORY_STANDARD"), ("b", "1998-01-01", None, 0.2, "CATEGORY_STANDARD"), ("c", "1995-01-01", None, 1.5, "CATEGORY_REDUCED"))
    rows = E.resolve_tax(load_canonical(spark, d), E.tax_rules(spark, rules))
    return rows.groupBy("period", "category_group", "tax_issue").agg(F.count("*").alias("n_rows"))


@query
def tax_semantics(spark, d):
    rows = load_canonical(spark, d)
    names = [r["category"] for r in rows.select("category").distinct().orderBy("category").limit(2).collect()]
    rules = rows.select("category", "package").distinct().where(F.col("category").isin(names)).withColumn("tax_group", F.lit("REDUCED"))
    rules = rules.unionByName(rules.where(F.col("category") == names[0]))
    return E.semantic_tax_group(rows, rules, "STANDARD").groupBy("category", "tax_group", "tax_state").agg(F.count("*").alias("n_rows"))


@query
def row_economics(spark, d):
    return enriched(spark, d).groupBy("period", "store", "sku").agg(exact_sum("revenue_net").alias("revenue_net"), exact_sum("input_cost_net").alias("input_cost_net"), exact_sum("margin_abs").alias("margin_abs"), F.max("margin_pct").alias("max_margin_pct"), F.min("markup_pct").alias("min_markup_pct"), F.max("realized_price_vat").alias("max_realized_price"))


@query
def sign_class(spark, d):
    return enriched(spark, d).groupBy("sign_class").agg(F.count("*").alias("n_rows"), exact_sum("revenue_vat").alias("revenue_vat"))


@query
def reconciliation(spark, d):
    source = table(spark, d, "lineitem").agg(F.count("*").alias("source_rows"), F.sum(F.expr("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END").cast("decimal(18,2)")).cast("double").alias("source_units"))
    made = load_canonical(spark, d).agg(F.count("*").alias("n_rows"), F.sum(D.units()).cast("double").alias("units"))
    return source.crossJoin(made).withColumn("reconciled", (F.col("source_rows") == F.col("n_rows")) & (F.col("source_units") == F.col("units")))  # one row each


def _grain(name):
    def run(spark, d):
        return K.grain_metrics(based(spark, d), name).select("period", *[k for k in K.GRAINS[name]], *K.METRICS)

    QUERIES[f"metrics_{name}"] = run


for _name in K.GRAINS:
    _grain(_name)


@query
def active_store_count_broadcast(spark, d):
    return K.distribution(based(spark, d), "brand").select("period", "category", "manufacturer", "brand", "selling_stores", "active_stores")


@query
def numeric_distribution(spark, d):
    return K.distribution(based(spark, d), "brand").select("period", "category", "manufacturer", "brand", "numeric_distribution")


@query
def velocity(spark, d):
    return K.distribution(based(spark, d), "manufacturer").select("period", "category", "manufacturer", "units_per_store", "revenue_per_store")


@query
def metric_share(spark, d):
    return K.category_share(K.grain_metrics(based(spark, d), "brand")).select("period", "category", "manufacturer", "brand", "revenue_net", "share")


@query
def pl_scoped_metrics(spark, d):
    return K.scoped_metrics(based(spark, d))


@query
def market_universe(spark, d):
    rows = based(spark, d)
    parts = [K.market_universe(rows, u).groupBy("period").agg(exact_sum("revenue_net").alias("revenue_net")).withColumn("universe", F.lit(u)) for u in Q.UNIVERSES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def volume_range_filter(spark, d):
    rows = load_canonical(spark, d).where(volume_filter("volume_l", (2.5,), ("gt_0_25_le_0_50", "gt_0_50_le_0_75", "gt_0_75_le_1_00")))
    return rows.groupBy("period", volume_range("volume_l").alias("volume_range")).agg(F.count("*").alias("n_rows"), exact_sum(D.units()).alias("units"))


def _monthly(spark, d):
    return K.grain_metrics(based(spark, d).where(f"period <> date'{GAP}'"), "category").select("period", "category", "revenue_net", "units")


@query
def compare_yoy(spark, d):
    return P.compare(_monthly(spark, d), ("category",), "revenue_net", "YOY")


@query
def compare_mom(spark, d):
    return P.compare(_monthly(spark, d), ("category",), "revenue_net", "MOM")


@query
def compare_previous_available(spark, d):
    return P.compare(_monthly(spark, d), ("category",), "revenue_net", "PREVIOUS_AVAILABLE")


@query
def compare_custom(spark, d):
    return P.compare(_monthly(spark, d), ("category",), "revenue_net", "CUSTOM", REFERENCE)


@query
def coverage(spark, d):
    return P.coverage(load_canonical(spark, d).where(f"period <> date'{GAP}'"), "1998-01-01", "1998-12-01")


@query
def month_set_compare(spark, d):
    return P.month_set_compare(_monthly(spark, d), ("category",), "revenue_net", 1998, 1997)


@query
def abc_batch(spark, d):
    return Q.abc_classes(K.grain_metrics(based(spark, d), "sku"), "revenue_net").select("period", "category", "sku", "revenue_net", "abc_share", "cumulative_share", "abc_class")


@query
def abc_portfolio(spark, d):
    rows = K.grain_metrics(month(based(spark, d)), "manufacturer")
    return Q.abc_portfolio(rows, "revenue_net", ("category",), "manufacturer").select("category", "manufacturer", "revenue_net", "cumulative_share", "abc_class", "limitation")


def _rank(name, by):
    def run(spark, d):
        rows = K.grain_metrics(based(spark, d), name)
        keys = K.GRAINS[name]
        return Q.ranks(rows, "revenue_net", by).select("period", *keys, "revenue_net", "rank", "tie_count", "population")

    QUERIES[f"rank_{name}"] = run


for _name, _by in (("category", ("period",)), ("manufacturer", ("period", "category")), ("brand", ("period", "category")), ("sku", ("period", "category"))):
    _rank(_name, _by)


def _movement(spark, d):
    return Q.movement(K.grain_metrics(based(spark, d), "sku").select("period", "category", "sku", "revenue_net"), ("category", "sku"), "revenue_net", CURRENT, REFERENCE)


@query
def rank_movement(spark, d):
    return _movement(spark, d).select("category", "sku", "current_rank", "reference_rank", "rank_movement", "movement_state")


@query
def share_movement(spark, d):
    return _movement(spark, d).select("category", "sku", "current_share", "reference_share", "share_pp")


@query
def entity_share_cumulative(spark, d):
    return Q.cumulative_share(K.grain_metrics(based(spark, d), "brand"), "revenue_net", ("period", "category"), "brand").select("period", "category", "brand", "share", "cumulative_share")


def _products(spark, d):
    return B.product_table(based(spark, d), CURRENT)


@query
def price_segments(spark, d):
    return B.price_segments(_products(spark, d)).select("category", "sku", "price", "price_segment", "price_rank")


@query
def peers_broad(spark, d):
    rows = _products(spark, d)
    return B.peer_counts(rows, rows, ("category",))


@query
def peers_topn(spark, d):
    rows = _products(spark, d)
    top = B.top_entities(rows, ("revenue_net", "units"), 10)
    return B.peers(rows, rows.join(top, ["category", "sku"], "left_semi"), ("category",))


@query
def peers_direct(spark, d):
    rows = B.price_segments(_products(spark, d))
    return B.peers(rows, rows, ("category", "carbonation", "price_segment"))


@query
def benchmark_rank_percentile(spark, d):
    return B.benchmark_ranks(_products(spark, d), "revenue_net")


@query
def relative_price(spark, d):
    return B.relative_prices(_products(spark, d))


@query
def metric_facts(spark, d):
    return grain_facts(spark, d)


@query
def duplicate_fact_identity(spark, d):
    return M.duplicate_identities(grain_facts(spark, d))


@query
def fact_scan(spark, d):
    return M.scan_facts(grain_facts(spark, d), "1998-01-01", "1998-06-01", ("revenue_net", "units"), ("category",), True).select("period_start", "entity_id", "metric", "value")


@query
def range_aggregate(spark, d):
    return M.range_aggregate(M.scan_facts(grain_facts(spark, d), "1998-01-01", "1998-06-01"))


@query
def scoped_rollup(spark, d):
    """Manufacturers selected by filter, summed to the network for metrics that can be added."""
    rows = M.scan_facts(grain_facts(spark, d), "1998-01-01", "1998-06-01", ("revenue_net", "units"), ("manufacturer",)).where("entity_id in ('MFR_1', 'MFR_2')")
    return rows.groupBy("period_start", "metric").agg(exact_sum(F.col("value").cast("decimal(24,8)")).alias("value"), F.countDistinct("entity_id").alias("n_entities"))


@query
def sku_store_facts(spark, d):
    return M.sku_store_facts(based(spark, d))


@query
def store_universe(spark, d):
    return M.store_universe(load_canonical(spark, d))


@query
def product_store_rollup(spark, d):
    return M.rollup_sku_store(M.sku_store_facts(based(spark, d)), ("category", "store_format"))


@query
def catalog_match(spark, d):
    schema = "metric string, label string, enabled boolean"
    public = spark.createDataFrame([("revenue_net", "Net revenue", True), ("units", "Units", True), ("margin_pct", "Margin", True)], schema)
    private = spark.createDataFrame([("units", "Pieces", False), ("margin_abs", "Margin sum", True)], schema)
    return M.match_catalog(grain_facts(spark, d), public, private)


@query
def provenance(spark, d):
    return M.provenance(grain_facts(spark, d))


@query
def store_format_distribution(spark, d):
    return D.format_distribution(based(spark, d), "brand")


@query
def kpi_period(spark, d):
    return D.kpis(based(spark, d), "brand")


@query
def kpi_range(spark, d):
    return D.kpis(based(spark, d).where("period between date'1998-01-01' and date'1998-06-01'"), "brand", by_period=False)


@query
def kpi_weighted_distribution(spark, d):
    return D.weighted_distribution(based(spark, d), "sku")


@query
def category_share(spark, d):
    rows = K.grain_metrics(based(spark, d).where("period between date'1998-01-01' and date'1998-06-01'").withColumn("period", F.lit("1998-01-01").cast("date")), "manufacturer")
    return K.category_share(rows).select("category", "manufacturer", "revenue_net", "share")


@query
def served_category_share(spark, d):
    shares = K.category_share(K.grain_metrics(based(spark, d), "manufacturer"))
    return P.compare(shares, ("category", "manufacturer"), "share", "YOY").withColumn("status", F.when(F.col("comparable"), "READY").otherwise("PARTIAL"))


@query
def active_sku_peak(spark, d):
    return Q.active_sku_peak(load_canonical(spark, d), ("manufacturer",))


@query
def regional_summary(spark, d):
    return D.regional_summary(based(spark, d))


@query
def geography_breakdown(spark, d):
    return D.geography(based(spark, d), ("region", "store_format"), CURRENT, REFERENCE)


@query
def package_volume_mix(spark, d):
    return D.package_volume_mix(based(spark, d), CURRENT, REFERENCE)


@query
def diagnostics_breakdown(spark, d):
    return D.diagnostics(based(spark, d), "brand", CURRENT, REFERENCE)


@query
def entity_options(spark, d):
    return D.entity_options(load_canonical(spark, d), "sku", ("category", "brand"))


@query
def volume_facet(spark, d):
    return D.volume_facet(load_canonical(spark, d))


@query
def coverage_grid(spark, d):
    rows = load_canonical(spark, d).where(f"period <> date'{GAP}'").select("period").distinct()
    bounds = rows.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = bounds.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period"))
    return grid.join(rows.withColumn("there", F.lit(True)), "period", "left").select("period", F.coalesce("there", F.lit(False)).alias("available"))


@query
def contribution(spark, d):
    return Q.contribution(based(spark, d), "category", "brand", "revenue", CURRENT, REFERENCE)


@query
def market_segment_delta(spark, d):
    return Q.segment_deltas(based(spark, d), "revenue_net", CURRENT, REFERENCE)


@query
def segment_patterns(spark, d):
    return Q.segment_patterns(Q.segment_deltas(based(spark, d), "revenue_net", CURRENT, REFERENCE))


@query
def brand_vs_category(spark, d):
    rows = Q.two_periods(based(spark, d), ("category", "brand"), "revenue_net", CURRENT, REFERENCE)
    whole = Q.two_periods(based(spark, d), ("category",), "revenue_net", CURRENT, REFERENCE).select("category", ratio(F.col("current_value") - F.col("reference_value"), "reference_value").alias("category_pct"))
    own = rows.select("category", "brand", ratio(F.col("current_value") - F.col("reference_value"), "reference_value").alias("brand_pct"))
    return own.join(whole, "category").withColumn("gap_pp", (F.col("brand_pct") - F.col("category_pct")) * 100)


@query
def manufacturer_population(spark, d):
    return load_canonical(spark, d).groupBy("period", "category").agg(F.countDistinct("manufacturer").alias("population"))


def _event_facts(spark, d):
    rows = based(spark, d)
    brands = K.grain_metrics(rows, "manufacturer").select("period", F.concat_ws("|", "category", "manufacturer").alias("entity_id"), "revenue_net")
    compared = P.compare(brands, ("entity_id",), "revenue_net", "YOY")
    abc = Q.abc_classes(brands, "revenue_net", by=("period",), entity="entity_id").select("period", "entity_id", "abc_class")
    past = abc.select(F.add_months("period", 12).alias("period"), "entity_id", F.col("abc_class").alias("reference_abc_class"))
    return V.event_facts(compared, abc.join(past, ["period", "entity_id"], "left"))


@query
def event_facts(spark, d):
    return _event_facts(spark, d)


@query
def events_simple(spark, d):
    return V.detect(_event_facts(spark, d))


@query
def events_composite(spark, d):
    return V.composite(_event_facts(spark, d), [("comparison_delta_pct", "lte", -0.10), ("abc_abc_class", "eq", "A")])


@query
def event_missing_features(spark, d):
    rules = (*V.RULES, ("price_gap", "PRICE_GAP", "benchmark", [("price_index", "gt", 120.0)], "INFO"))
    return V.missing_features(_event_facts(spark, d), rules)


@query
def event_ids(spark, d):
    """Rows only: ids are stable within this engine."""
    events = V.identified(V.detect(_event_facts(spark, d)), "run_a", "retailer_a", "source_a", "rules_v1")
    return events.select("rule_id", "entity_id", "period", "event_id")


def _revisions(spark, d):
    """Each store's months as a source revision; the hash is of what the revision holds."""
    rows = load_canonical(spark, d).groupBy("store", "period").agg(F.count("*").alias("n"))
    return rows.groupBy(F.lit("retailer_a").alias("retailer_id"), F.col("store").alias("source_id"), F.year("period").alias("revision")).agg(
        F.array_sort(F.collect_set("period")).alias("periods"), F.sum("n").cast("string").alias("content_hash"), F.max("period").alias("activated")
    )


@query
def ledger_register(spark, d):
    rows = _revisions(spark, d)
    incoming, ledger = rows.where("revision >= 1997"), rows.where("revision <= 1997 and source_id <> 'STORE_1'")
    return M.register_sources(incoming, ledger).select("retailer_id", "source_id", "revision", "content_hash", "registration")


@query
def ledger_activate(spark, d):
    rows = _revisions(spark, d)
    fix = rows.where("revision = 1997").select("retailer_id", "source_id", F.lit(9999).alias("revision"), F.slice("periods", 1, 3).alias("periods"), "content_hash", F.lit("2005-01-01").cast("date").alias("activated"))
    return M.activate_revisions(rows.unionByName(fix))


@query
def source_rows_page(spark, d):
    rows = load_canonical(spark, d).select("period", "store", "sku", "units", F.col("revenue_vat").cast("double").alias("revenue_vat"), "shelf_price_vat")
    return D.source_page(rows, ("period", "store", "sku", "units", "revenue_vat", "shelf_price_vat"), 100, 2)


@query
def incremental_rebuild(spark, d):
    rows = based(spark, d)
    changed = month(rows, "1998-02-01")
    return S.rebuild(rows, changed, lambda r: K.grain_metrics(r, "category").select("period", "category", "revenue_net", "units"))


def _contribution(parent, child):
    def run(spark, d):
        return Q.contribution(based(spark, d), parent, child, "revenue", CURRENT, REFERENCE)

    QUERIES[f"contribution_{parent}_{child}"] = run


for _pair in (("network", "category"), ("category", "manufacturer"), ("category", "sku")):
    _contribution(*_pair)


@query
def metric_definitions(spark, d):
    """All configured metrics of all grains, in dependency order, one aggregation for each grain."""
    rows, _ = N.calculate_base(based(spark, d), N.standard_definitions(), dealt(spark, d))
    return rows.select("period", "entity_type", "entity_id", "concept", "metric_name", "metric_value")


@query
def comparison_issues(spark, d):
    values = _monthly(spark, d)
    return P.comparison_issues(P.compare(values, ("category",), "revenue_net", "YOY"), values, "YOY")


@query
def fact_comparison(spark, d):
    return M.fact_comparison(grain_facts(spark, d), CURRENT, REFERENCE)


@query
def month_set_ranges(spark, d):
    return M.month_set_ranges(grain_facts(spark, d), 1998, 1997)


@query
def metric_templates(spark, d):
    return M.metric_templates(grain_facts(spark, d))


@query
def filter_grain_rollup(spark, d):
    filters = {"brand": ("Brand#11", "Brand#12", "Brand#7", "Brand#8"), "store": ("STORE_1", "STORE_2", "STORE_3")}
    return N.filtered_rollup(M.sku_store_facts(based(spark, d)), filters)


def _numbered(spark, d):
    """Canonical rows with their row numbers in the source order."""
    return I.numbered(load_canonical(spark, d), ("period", "store"))


def _rows_of(issues, *keys):
    """Issues counted, with the first row that has each and the last."""
    return issues.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"))


@query
def sign_issues(spark, d):
    return _rows_of(G.sign_issues(_numbered(spark, d)), "issue_code", "severity")


@query
def price_issues(spark, d):
    return _rows_of(G.price_issues(_numbered(spark, d)), "issue_code", "field")


@query
def quality_summary(spark, d):
    status = F.when((F.col("units") >= 0) & (F.col("revenue_vat") >= 0), "valid").otherwise("review")
    return G.quality_summary(load_canonical(spark, d), status, [("no_input_price", F.col("input_price_vat").isNull()), ("unknown_private_label", F.col("private_label").isNull())])


@query
def row_sequence(spark, d):
    rows = I.numbered(load_canonical(spark, d), ("period", "store"))
    return G.sequence_issues(rows)


@query
def totals_reconcile(spark, d):
    source = table(spark, d, "lineitem").select(F.expr("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END").alias("units"))
    return G.within_tolerance(source, load_canonical(spark, d), ("units",), 0.005)


@query
def latest_priced_period(spark, d):
    return B.latest_priced_period(load_canonical(spark, d), ("category",), "shelf_price_vat")


@query
def product_filter(spark, d):
    rows = load_canonical(spark, d)
    package = rows.agg(F.min("package")).first()[0]
    kept = G.product_filter(M.sku_store_facts(based(spark, d)), rows.select("sku", "package"), {"package": (package,)})
    return kept.groupBy("period").agg(F.count("*").alias("n_rows"), F.sum(F.col("revenue_net").cast("decimal(24,8)")).cast("double").alias("revenue_net"))


def _activated(spark, d):
    rows = _revisions(spark, d)
    fix = rows.where("revision = 1997").select("retailer_id", "source_id", F.lit(9999).alias("revision"), F.slice("periods", 1, 3).alias("periods"), "content_hash", F.lit("2005-01-01").cast("date").alias("activated"))
    return M.activate_revisions(rows.unionByName(fix))


@query
def active_revisions(spark, d):
    return G.active_revisions(_activated(spark, d)).withColumn("periods", F.array_join(F.transform("periods", lambda p: F.date_format(p, "yyyy-MM-dd")), ","))


@query
def revision_ids(spark, d):
    return G.with_ids(_revisions(spark, d)).select("source_id", "revision", "source_artifact_id", "source_revision_id")


@query
def inactive_facts(spark, d):
    facts = load_canonical(spark, d).select("retailer_id", F.col("store").alias("source_id"), "period", F.year("period").alias("revision"))
    return G.inactive_facts(facts, _activated(spark, d)).drop("retailer_id")


@query
def build_coverage(spark, d):
    builds = load_canonical(spark, d).where("period < date'1998-01-01'").select("retailer_id", F.col("store").alias("source_id"), "period")
    return G.build_coverage(builds, _activated(spark, d)).drop("retailer_id")


@query
def resolve_build(spark, d):
    builds = _revisions(spark, d).select(F.col("source_id").alias("retailer_id"), F.col("revision").cast("string").alias("mart_build_id"), F.when(F.col("revision") == 1997, "APPROVED").otherwise("DRAFT").alias("status"))
    return G.resolve_build(builds)


@query
def period_modes(spark, d):
    rows, out = load_canonical(spark, d).select("period"), None
    for mode, more in (("SINGLE_PERIOD", {"first": CURRENT}), ("DATE_RANGE", {"first": "1998-01-01", "last": "1998-06-01"}), ("AVAILABLE_MONTH_SET", {"years": (2000, 2001)}), ("FULL_AVAILABLE_HISTORY", {})):
        own = G.selected_periods(rows, mode, **more).agg(F.lit(mode).alias("mode"), F.countDistinct("period").alias("n_periods"), F.count("*").alias("n_rows"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def gated_events(spark, d):
    issues = load_canonical(spark, d).where("units is null").select(F.lit("MISSING_UNITS").alias("issue_code"), F.lit("FATAL").alias("severity"))
    return G.gated(V.detect(_event_facts(spark, d)), issues).groupBy("rule_id").agg(F.count("*").alias("n"))


@query
def events_deduplicated(spark, d):
    events = V.identified(V.detect(_event_facts(spark, d)), "run_a", "retailer_a", "source_a", "rules_v1")
    kept = V.deduplicated(events.unionByName(events), ("rule_id", "entity_id", "period", "current_value", "confidence"))
    return kept.groupBy("rule_id").agg(F.count("*").alias("n_events"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("conflict").cast("int")).cast("long").alias("n_conflicts"))


FEATURES = ("revenue_net", "units", "margin_abs", "margin_pct", "avg_shelf_price", "category_revenue_share", "numeric_distribution", "units_per_store")


def _compared_features(spark, d):
    rows = based(spark, d)
    own = K.category_share(K.grain_metrics(rows, "manufacturer")).withColumnRenamed("share", "category_revenue_share")
    active = rows.groupBy("period").agg(K.selling(rows, "store").alias("active_stores"))
    wide = own.join(F.broadcast(active), "period")  # a row a month
    wide = wide.withColumns({"entity_id": F.concat_ws("|", "category", "manufacturer"), "numeric_distribution": ratio("selling_stores", "active_stores"), "units_per_store": ratio("units", "selling_stores")})
    return P.compare_metrics(wide, ("entity_id",), FEATURES, "YOY")


@query
def compare_features(spark, d):
    return _compared_features(spark, d)


@query
def event_families(spark, d):
    return V.detect_families(_compared_features(spark, d))


@query
def event_patterns(spark, d):
    return V.patterns(_compared_features(spark, d))


@query
def event_candidates(spark, d):
    facts = _compared_features(spark, d).withColumns({"feature": F.lit("comparison"), "entity_type": F.lit("manufacturer")})
    wanted = [("any", "comparison", None, None), ("good", "comparison", ["manufacturer", "brand"], ["HIGH"]), ("skus", "comparison", ["sku"], None), ("peers", "benchmark", None, None)]
    rules = spark.createDataFrame(wanted, "rule_id string, feature string, entity_types array<string>, qualities array<string>")
    return V.candidates(facts, F.broadcast(rules)).groupBy("rule_id", "metric").agg(F.count("*").alias("n_facts"))


QUERIES |= mart_queries.QUERIES
ORACLES |= mart_oracles.ORACLES
