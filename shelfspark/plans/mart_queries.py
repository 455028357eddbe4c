"""Queries of the stored mart, of event rules and the signal feed, of benchmark pools, ingestion and lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..operators import benchmarking as B
from ..operators import breakdowns as D
from ..operators import catalog as C
from ..operators import ingest as I
from ..operators import mart as M
from ..operators import metrics as K
from ..operators import periods as P
from ..operators import portfolio as Q
from ..operators import positions as Z
from ..operators import product_store as T
from ..operators import rules as R
from ..operators import signals as X
from ..sources.store import mart_root, open_build
from ..sources.tables import load_canonical
from ..streaming import incremental as S
from ..streaming import ingest_files as W
from .inputs import CONTEXT, based, cells, mart_facts, month
from .oracles import CURRENT

QUERIES: dict = {}
#: The months that windowed queries read.
FIRST, LAST = "1998-01-01", "1998-06-30"


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Columns of facts that tell one fact from another, and its values; the others are the same for many facts.
TELLING = ("period_start", "period_end", "grain_id", "entity_id", "parent_entity_ids", "metric_definition_id", "value", "numerator_value", "denominator_value", "range_aggregation_strategy")


@query
def mart_metric_facts(spark, d):
    """Stored facts of all configured metrics."""
    return mart_facts(spark, d).select(*TELLING)


@query
def mart_fact_descriptions(spark, d):
    """The other columns of the stored facts, counted by month; what names the build and the time of writing is left out."""
    facts = mart_facts(spark, d).drop("source_revision_id", "mart_build_id", "created_at")
    return facts.groupBy("period_start", *[c for c in facts.columns if c not in TELLING], "metric_definition_id").agg(F.count("*").alias("n_facts"))


@query
def mart_fact_scan(spark, d):
    build = open_build(spark, d)
    rows = M.query_facts(mart_facts(spark, d), FIRST, LAST, retailer_id="retailer_a", source_id="source_a", grain_id="category", metric_concept="revenue", mart_build_id=build.mart_build_id)
    return rows.select("retailer_id", "source_id", "period_start", "grain_id", "entity_id", "metric_definition_id", "value")


@query
def mart_parent_scan(spark, d):
    rows = M.read_policy(mart_facts(spark, d), FIRST, LAST, "brand", {"metric_concept": ("revenue", "units")}, {"category": ("ECONOMY", "SMALL"), "manufacturer": ("MFR_1",)})
    return rows.select("period_start", "entity_id", "parent_entity_ids", "metric_concept", "value")


@query
def fact_validation(spark, d):
    facts = mart_facts(spark, d)
    twice = facts.where((F.col("period_start") == F.lit(CURRENT).cast("date")) & (F.col("grain_id") == "network"))
    return M.fact_issues(facts.unionByName(twice), {"retailer_id": ("retailer_a",), "analysis_run_id": ("run_b",)})


FEATURES = ("revenue", "units", "retailer_margin_abs", "retailer_margin_pct", "weighted_shelf_price_vat", "category_revenue_share", "distribution", "velocity")


def _products(spark, d):
    rows = month(based(spark, d))
    active = rows.agg(K.selling(rows, "store").alias("active_stores"))
    products = B.price_segments(B.product_table(rows, CURRENT)).crossJoin(F.broadcast(active))  # one row
    return products.withColumns({
        "units_per_selling_store": ratio("units", "selling_stores"), "numeric_distribution": ratio("selling_stores", "active_stores"),
        "retailer_margin_abs": F.col("margin_abs"), "weighted_shelf_price_vat": F.col("avg_shelf_price"),
    })


def _made_event_facts(spark, d) -> DataFrame:
    """Comparisons and classes of manufacturers over all months, and benchmark features of the SKUs of a month."""
    rows = based(spark, d)
    own = K.category_share(K.grain_metrics(rows, "manufacturer")).withColumnRenamed("share", "category_revenue_share")
    active = rows.groupBy("period").agg(K.selling(rows, "store").alias("active_stores"))
    wide = own.join(F.broadcast(active), "period").select(  # a row a month
        "period", "category", F.concat_ws("|", "category", "manufacturer").alias("entity_id"), F.col("revenue_net").alias("revenue"), "units", F.col("margin_abs").alias("retailer_margin_abs"),
        F.col("margin_pct").alias("retailer_margin_pct"), F.col("avg_shelf_price").alias("weighted_shelf_price_vat"), "category_revenue_share", ratio("selling_stores", "active_stores").alias("distribution"), ratio("units", "selling_stores").alias("velocity"),
    )
    compared = P.compare_metrics(wide, ("category", "entity_id"), FEATURES, "YOY").select(
        "*", F.col("metric").alias("concept"), F.lit("manufacturer").alias("entity_type"), F.lit("YOY").alias("comparison_type"), F.concat_ws(".", F.lit("manufacturer"), "metric", F.lit("v1")).alias("metric_definition_id"), F.lit("v1").alias("metric_definition_version"),
    )
    classes = Q.abc_classes(wide, "revenue", by=("period",), entity="entity_id").select("period", "category", "entity_id", "abc_class")
    past = classes.select(F.add_months("period", 12).alias("period"), F.col("period").alias("reference_period"), "category", "entity_id", F.col("abc_class").alias("reference_abc_class"))
    classes = classes.join(past, ["period", "category", "entity_id"], "left").select("*", F.lit("abc_revenue").alias("abc_metric"), F.lit("manufacturer").alias("entity_type"))
    products = _products(spark, d)
    named = {"target_entity_id": F.col("sku"), "metric_name": F.col("metric"), "metric_value": F.col("value"), "reference_period": F.lit(CURRENT).cast("date"), "benchmark_scope": F.col("scope"), "benchmark_scope_id": F.col("scope_key"), "category": F.split_part("scope_key", F.lit("|"), F.lit(1))}
    marks = B.benchmark_features(products).withColumns(named).withColumn("pool_source", F.when(F.col("scope") == "BROAD", "CATEGORY_POOL").when(F.col("scope") == "TOP_N", "RULE_POOL_UNION").otherwise("DIRECT_DIMENSIONS"))
    return R.comparison_facts(compared, CONTEXT).unionByName(R.abc_facts(classes, CONTEXT)).unionByName(R.benchmark_facts(marks, CONTEXT))


def _event_facts(spark, d) -> DataFrame:
    stored = open_build(spark, d).dataset("event_facts", lambda: _made_event_facts(spark, d))
    return stored.select(*R.FACT_COLUMNS)


def _rules(spark):
    return R.rule_tables(spark, R.STANDARD, CONTEXT["retailer_id"], CONTEXT["rule_version"])


def _events(spark, d) -> DataFrame:
    """The events of the build as stored by month; the rules run only where none are stored."""
    rules, conditions = _rules(spark)
    return X.stored_events(open_build(spark, d), lambda: _made_event_facts(spark, d), lambda facts: R.detect_events(facts, rules, conditions, CONTEXT))


EVENT = ("event_rule_id", "event_type", "event_family", "entity_type", "entity_id", "category", "period", "reference_period", "feature_name", "observed_value", "observed_label", "reference_label", "delta_pct", "delta_pp", "percentile", "benchmark_scope_id", "severity", "confidence")


@query
def event_fact_rows(spark, d):
    """Event facts in their fixed layout, read as stored."""
    return _event_facts(spark, d)


@query
def event_rules(spark, d):
    """Events of all rules of the tables over the stored event facts."""
    rules, conditions = _rules(spark)
    return R.detect_events(_event_facts(spark, d), rules, conditions, CONTEXT).select(*EVENT)


@query
def event_rule_issues(spark, d):
    """Issues of rules that ask for what is not there: no conditions, a feature without facts, a field that facts never have."""
    more = (
        *R.STANDARD, ("bare.v1", "SHARE_GAIN", "SHARE", "comparison", ("revenue",), (), {}), ("stock.v1", "SHARE_GAIN", "SHARE", "comparison", ("stock_days",), (("delta_pct", "gt", 0.0),), {}),
        ("field.v1", "SHARE_GAIN", "SHARE", "comparison", ("revenue",), (("stock_level", "gt", 0.0),), {}), ("other.v1", "SHARE_GAIN", "SHARE", "comparison", ("nothing",), (("delta_pct", "gt", 0.0),), {"retailer_id": "retailer_b"}),
        ("off.v1", "SHARE_GAIN", "SHARE", "comparison", ("nothing",), (("delta_pct", "gt", 0.0),), {"enabled": False}),
    )
    rules, conditions = R.rule_tables(spark, more, CONTEXT["retailer_id"], CONTEXT["rule_version"])
    return R.rule_issues(_event_facts(spark, d), rules, conditions, CONTEXT)


@query
def stored_events(spark, d):
    """Stored events of a window of months; only these months' partitions are read."""
    return _events(spark, d).where(F.col("period").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))).select(*EVENT)


def _feed(spark, d) -> X.Feed:
    return X.feed(_events(spark, d), X.Request("retailer_a", "source_a", date_from=CURRENT, date_to=CURRENT, comparison_mode="NONE", limit=20))


@query
def signal_feed(spark, d):
    return _feed(spark, d).rows.select("signal_type", "place", "severity", "event_type", "event_family", "entity_type", "entity_id", "period", "event_rule_id", "delta_pct", "status")


@query
def signal_feed_status(spark, d):
    return _feed(spark, d).status


@query
def signal_feed_excluded(spark, d):
    return _feed(spark, d).excluded


@query
def benchmark_features(spark, d):
    return B.benchmark_features(_products(spark, d))


@query
def benchmark_prices(spark, d):
    return B.pool_prices(_products(spark, d))


def _product_store(spark, d) -> DataFrame:
    rows = cells(spark, d)
    revision = F.concat_ws("_", F.lit("rev"), F.regexp_replace("region", " ", ""), F.year("period").cast("string"))
    return T.product_store_facts(rows, ("category", "brand", "region", "store_format"), {"source_revision_id": revision, "analysis_run_id": F.concat_ws("_", F.lit("run"), F.lower("store_format"))})


@query
def product_store_quality(spark, d):
    """SKU x store facts rolled up to brands by month, then to categories over all months, with the count of facts by flag."""
    months = T.rolled_up(_product_store(spark, d), ("period", "category", "brand"))
    return T.served(T.rolled_up(months, ("category",)), ("category",)).drop("source_revision_ids", "analysis_run_ids", "latest_revision_id")


@query
def product_store_months(spark, d):
    """The same by month, category and store format."""
    return T.served(T.rolled_up(_product_store(spark, d), ("period", "category", "store_format")), ("period", "category", "store_format")).drop("source_revision_ids", "analysis_run_ids", "latest_revision_id", "latest_period")


@query
def lineage(spark, d):
    """Revisions and runs behind each result, carried from the rows through two roll-ups."""
    months = T.rolled_up(_product_store(spark, d), ("period", "category", "region"))
    return T.served(T.rolled_up(months, ("category", "region")), ("category", "region")).select("category", "region", "metric_concept", "n_facts", "quality_status", "quality_flags", "latest_period", "latest_revision_id", "source_revision_ids", "analysis_run_ids")


PAGE = ("period", "category", "manufacturer", "brand", "sku_name", "store", "sku", "units", "revenue_vat", "shelf_price_vat")


@query
def source_rows_seek(spark, d):
    """The page behind a given row in the scope of a year and two categories."""
    rows = load_canonical(spark, d).withColumn("revenue_vat", F.col("revenue_vat").cast("double"))
    after = ("1998-05-01", "ECONOMY", "MFR_2", "", "", "", "", 0.0, 0.0, 0.0)
    return D.browse(rows.select(*PAGE), PAGE, 100, after, "1998-01-01", "1998-12-01", {"category": ("ECONOMY", "SMALL")})


def _monthly(rows: DataFrame) -> DataFrame:
    return K.grain_metrics(rows, "category").select("period", "category", "revenue_net", "units")


@query
def mart_rebuild(spark, d):
    """A mart by month, a correction of one month written back, and the mart as read behind it: only affected months carry the new build."""
    path = f"{mart_root(spark)}/rebuild-{uuid.uuid4().hex}"
    rows = based(spark, d)
    _monthly(rows).withColumn("mart_build_id", F.lit("build_1")).hint("rebalance", "period").write.partitionBy("period").parquet(path)
    wrong = (F.col("period") == F.lit("1998-02-01").cast("date")) & (F.col("store") == "STORE_1")
    fixed = rows.withColumn("revenue_net", F.when(wrong, F.col("revenue_net") * 2).otherwise(F.col("revenue_net")))
    S.write_back(fixed, rows.where(wrong), lambda r: _monthly(r).withColumn("mart_build_id", F.lit("build_2")), path)
    return spark.read.parquet(path)


@query
def stream_ingest(spark, d):
    """All months as files, one of them twice under another name, taken in micro-batches; then the facts and what the ledger says."""
    root = f"{mart_root(spark)}/stream-{uuid.uuid4().hex}"
    columns = ("period", "store", "sku", "category", "manufacturer", "brand", "units", "revenue_vat")
    rows = load_canonical(spark, d).select(*columns)
    month_files = rows.withColumn("month", F.col("period")).repartition("month")  # a file a month
    month_files.write.partitionBy("month").parquet(f"{root}/landing")
    month_files.where(F.col("month") == F.lit(CURRENT).cast("date")).drop("month").coalesce(1).write.parquet(f"{root}/landing/again")

    def build(r: DataFrame) -> DataFrame:
        return r.groupBy("period", "category").agg(F.sum("revenue_vat").cast("double").alias("revenue_vat"), F.sum(F.col("units").cast("decimal(18,2)")).cast("double").alias("units"), F.countDistinct(F.when(F.col("units") > 0, F.col("store"))).alias("selling_stores"))

    W.ingest_files(spark, f"{root}/landing", root, rows.schema, build, "retailer_a", "source_a", 48)
    entries = W.ledger(spark, root).groupBy().agg(F.count("*").alias("n_files"), F.count(F.when(F.col("registration") == "IDENTICAL_DUPLICATE", 1)).alias("n_duplicates"))
    return spark.read.parquet(f"{root}/facts").crossJoin(F.broadcast(entries))  # one row


@query
def portfolio_positions(spark, d):
    """Ranks, shares and classes of a month by all concepts."""
    return Z.positions(Z.month_set(mart_facts(spark, d), (CURRENT,)))


@query
def portfolio_positions_year(spark, d):
    """The same over the months of a year that are there."""
    return Z.positions(Z.month_set(mart_facts(spark, d), tuple(f"1998-{m:02d}-01" for m in range(1, 13))))


def _catalog(spark):
    public = [("revenue", "Net revenue", ["NONE", "YOY"], "sum_available_periods"), ("units", "Units", ["NONE", "YOY", "MOM"], "sum_available_periods"), ("distribution", "Distribution", ["NONE"], "period_only"), ("retailer_margin_pct", "Margin", ["NONE", "YOY"], "ratio_of_sums"), ("units", "Pieces", ["NONE"], "sum_available_periods")]
    own = lambda concept, definition, **more: tuple({
        "retailer_id": "retailer_a", "source_id": None, "metric_concept": concept, "metric_definition_id": definition, "metric_definition_version": "v1", "metric_config_hash": None, "rule_version": None, "display_label": None, "grain_support": ["category", "brand", "sku"],
        "period_support": ["month"], "comparison_support": [], "private_label_scope_support": ["INCLUDE"], "range_strategy": None, "availability_status": "AVAILABLE", "sort_order": 1, **more,
    }.values())
    private = [
        own("revenue", "category.revenue.v1"), own("revenue", "brand.revenue.v1", metric_config_hash="another"), own("revenue", "sku.revenue.v1", range_strategy="period_only", private_label_scope_support=["ONLY"]), own("units", "category.units.v1", rule_version="rules_v1"), own("units", "category.units.v1"),
        own("units", "brand.units.v1", grain_support=["sku"]), own("units", "sku.units.v1", availability_status="NOT_AVAILABLE", period_support=["week"]), own("units", "store.units.v1", source_id="source_b"), own("distribution", "category.distribution.v1", range_strategy="ratio_of_sums", comparison_support=["NONE", "ODD"]),
        own("nothing", "category.nothing.v1", grain_support=["shelf"]), own("units", "brand.units.v1", grain_support=["shelf", "sku"]), own("revenue", "network.revenue.v1", retailer_id="retailer_b"),
    ]
    return spark.createDataFrame(public, C.PUBLIC), spark.createDataFrame(private, C.PRIVATE)


@query
def catalog_limitations(spark, d):
    """What the effective catalog has to say about the facts of a request."""
    public, private = _catalog(spark)
    public = public.where("default_label <> 'Pieces'")
    own = C.effective_catalog(public, private, "retailer_a", "source_a")
    return C.catalog_limitations(mart_facts(spark, d), own, C.Request("retailer_a", "source_a", "category", ("revenue", "units", "distribution", "velocity"), comparison_mode="YOY"))


def _texts(spark, d) -> DataFrame:
    """Sales as a source gives them, numbers as text, with flaws that follow from the row."""
    rows = I.numbered(load_canonical(spark, d), ("period", "store"))
    flaw = F.pmod(F.col("source_row_number"), F.lit(13))
    return rows.select(
        "source_row_number", F.when(flaw == 0, " ").otherwise(F.col("sku")).alias("sku"), F.when(flaw == 1, "x").when(flaw == 2, F.lit(None)).otherwise(F.year("period").cast("string")).alias("year"),
        F.when(flaw == 3, "n/a").when(flaw == 4, "").otherwise(F.col("units").cast("string")).alias("units"), F.when(flaw == 5, "free").when(flaw == 6, F.lit(None)).otherwise(F.col("shelf_price_vat").cast("string")).alias("shelf_price"), "store_format",
    )


@query
def typing_issues(spark, d):
    """Every value that does not fit its field, with its row."""
    _, issues = I.typed(_texts(spark, d), ("sku",), ("year",), ("units", "shelf_price"), (), ("sku", "units"))
    return issues


@query
def typed_rows(spark, d):
    """The typed fields of all rows, summed up by year."""
    rows, _ = I.typed(_texts(spark, d), ("sku",), ("year",), ("units", "shelf_price"), (), ("sku", "units"))
    return rows.groupBy("year").agg(F.count("*").alias("n_rows"), F.count("units").alias("n_units"), F.count("shelf_price").alias("n_prices"), F.sum(F.col("units").cast("decimal(18,2)")).cast("double").alias("units"))


@query
def unknown_values(spark, d):
    """Rows whose store format a mapping does not know."""
    return I.value_issues(_texts(spark, d), "store_format", {"HYPER": "hypermarket", "SUPER": "supermarket"})


@query
def store_alias_scope(spark, d):
    """Aliases of a context: those of another source take no part, and of two targets the first listed counts."""
    given = [(1, "retailer_a", None, "rules_v1", "STORE_2", "STORE_1"), (2, None, "source_b", None, "STORE_3", "STORE_1"), (3, "retailer_a", "source_a", None, "STORE_4", "STORE_1"), (4, None, None, None, "STORE_4", "STORE_5"), (5, None, None, "rules_v2", "STORE_6", "STORE_1")]
    aliases = spark.createDataFrame(given, "place int, retailer_id string, source_id string, rule_version string, source_store string, canonical_store string")
    own = I.scoped_aliases(aliases, "retailer_a", "source_a", "rules_v1")
    rows = I.canonical_stores(load_canonical(spark, d), own)
    return rows.groupBy("canonical_store").agg(F.count("*").alias("n_rows"), F.countDistinct("store").alias("n_sources"))
