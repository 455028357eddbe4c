"""Mart of metric facts: projection, SKU x store facts, store universe, range aggregation, catalog, ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_sum, ratio

#: The range strategies.
SUM, RATIO, WEIGHTED, RECOMPUTE, SHARE, PERIOD_ONLY, UNSUPPORTED = "sum_available_periods", "ratio_of_sums", "weighted_ratio_of_sums", "recompute_from_components", "recompute_share_scope", "period_only", "unsupported"
#: Metric -> (aggregation, numerator, denominator, share scope).
MEASURES = {
    "revenue_vat": ("sum", None, None, None), "revenue_net": ("sum", None, None, None), "units": ("sum", None, None, None), "margin_abs": ("sum", None, None, None),
    "margin_pct": ("ratio_of_sums", "margin_abs", "revenue_net", None), "avg_shelf_price": ("weighted_average", "priced_value", "priced_units", None),
    "selling_stores": ("distinct_count", None, None, None), "selling_skus": ("distinct_count", None, None, None),
    "category_revenue_share": ("ratio_of_sums", "revenue_net", "category_revenue", "category"),
}


_SCOPED = ("distribution", "velocity", "per_selling_store")


def range_strategy(aggregation, concept, name, has_parts=None, share_scope=None):
    """How a metric is carried over a range; columns or literals.

    Without ``has_parts`` nothing is known of the parts and the answer is the careful one, asked for ABC classes first. With
    it (whether numerator and denominator are there) shares and ratios are carried over by their parts.
    """
    both = F.concat_ws(" ", F.lower(concept), F.lower(name))
    holds = lambda *words: F.coalesce(reduce(lambda a, b: a | b, [F.contains(both, F.lit(w)) for w in words]), F.lit(False))
    kind = F.lower(aggregation)
    careful = (
        F.when(holds("abc", "share", *_SCOPED), PERIOD_ONLY).when(kind == "sum", SUM).when(kind == "ratio_of_sums", RATIO)
        .when(kind == "weighted_average", WEIGHTED).when(kind == "distinct_count", PERIOD_ONLY).otherwise(UNSUPPORTED)
    )
    if has_parts is None:
        return careful
    parts = lambda s: F.when(has_parts, s).otherwise(PERIOD_ONLY)
    return (
        F.when(holds("share"), parts(F.when(F.coalesce(share_scope != "", F.lit(False)), SHARE).otherwise(PERIOD_ONLY))).when(holds(*_SCOPED), PERIOD_ONLY)
        .when(aggregation == "ratio_of_sums", parts(RATIO)).when(aggregation == "weighted_average", parts(WEIGHTED)).otherwise(careful)
    )


#: The columns of stored metric facts with their types, in order.
FACT_SCHEMA = {
    "retailer_id": "string",
    "source_id": "string",
    "source_revision_id": "string",
    "analysis_run_id": "string",
    "mart_build_id": "string",
    "private_label_scope": "string",
    "period_grain": "string",
    "period_start": "date",
    "period_end": "date",
    "business_period_id": "string",
    "grain_id": "string",
    "entity_id": "string",
    "parent_entity_ids": "string",
    "metric_concept": "string",
    "metric_name": "string",
    "metric_definition_id": "string",
    "metric_definition_version": "string",
    "metric_config_hash": "string",
    "semantic_family": "string",
    "semantic_compatibility_version": "string",
    "cross_retailer_comparable": "boolean",
    "value": "double",
    "numerator_value": "double",
    "denominator_value": "double",
    "business_rule_id": "string",
    "denominator_universe_type": "string",
    "store_alias_mapping_version": "string",
    "numerator_metric_name": "string",
    "denominator_metric_name": "string",
    "aggregation": "string",
    "range_aggregation_strategy": "string",
    "share_scope": "string",
    "rule_version": "string",
    "quality_status": "string",
    "quality_flags": "string",
    "created_at": "timestamp",
}
#: What a stored fact is told by, and the keys of its parents.
FACT_IDENTITY = (
    "retailer_id", "source_id", "mart_build_id", "analysis_run_id", "private_label_scope", "period_grain", "period_start", "period_end", "grain_id", "entity_id", "parent_entity_ids",
    "metric_definition_id", "metric_definition_version", "metric_config_hash", "rule_version",
)
PARENT_KEYS = {"brand": "brand", "canonical_product_id": "sku", "canonical_store_id": "store", "category": "category", "manufacturer": "manufacturer"}
#: Columns that a metric row must have before it becomes a fact.
REQUIRED = ("period", "entity_type", "entity_id", "concept", "metric_name", "metric_definition_id", "metric_definition_version", "metric_config_hash", "metric_value", "numerator_value", "denominator_value", "aggregation")


def parent_ids(columns: list[str]):
    """The parents of a row that are there, as a JSON object with its keys in order."""
    pair = lambda k, c: F.concat(F.lit(f'"{k}": '), F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"))
    held = [F.when(F.col(c).isNotNull(), pair(k, c)) for k, c in PARENT_KEYS.items() if c in columns]
    return F.concat(F.lit("{"), F.concat_ws(", ", *held), F.lit("}"))


def stored_facts(metrics: DataFrame, scope: dict[str, str], created_at=None) -> DataFrame:
    """Long metrics as facts of a build in the fixed layout; a missing source column is an error.

    ``scope`` gives retailer_id, source_id, source_revision_id, analysis_run_id, mart_build_id, rule_version and, if it is not
    INCLUDE, private_label_scope. Values are taken as they are; what the layout has and the rows lack is NULL.
    """
    if missing := sorted(set(REQUIRED) - set(metrics.columns)):
        raise ValueError(f"metric rows lack columns: {', '.join(missing)}")
    c, text = F.col, lambda name: F.col(name) if name in metrics.columns else F.lit(None)
    has_parts = c("numerator_value").isNotNull() & c("denominator_value").isNotNull()
    made = {
        "private_label_scope": F.lit(scope.get("private_label_scope", "INCLUDE")), "period_grain": F.lit("month"), "period_start": c("period"), "period_end": F.last_day("period"),
        "business_period_id": F.coalesce(text("business_period_id").cast("string"), F.date_format("period", "yyyy-MM-dd")), "grain_id": c("entity_type"), "parent_entity_ids": parent_ids(metrics.columns), "metric_concept": c("concept"),
        "cross_retailer_comparable": F.lit(False), "value": c("metric_value"), "range_aggregation_strategy": range_strategy(c("aggregation"), c("concept"), c("metric_name"), has_parts, text("share_scope").cast("string")),
        "quality_status": F.lit("valid"), "created_at": F.current_timestamp() if created_at is None else F.lit(created_at),
    } | {k: F.lit(v) for k, v in scope.items()}
    return metrics.select(*[(made[k] if k in made else text(k)).cast(t).alias(k) for k, t in FACT_SCHEMA.items()])


#: Entities with repeated facts that are broadcast, by a long each.
MOST_SUSPECTS = 100_000


def fact_issues(facts: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """``(issue_code, subject, n_rows)``: values outside the build's, facts without revision, identities that stand more than once.

    Facts are gathered by the hash of their entity and month with a list of hashes of their definitions, so a short row an
    entity is shuffled and not one a fact. Entities whose list holds a hash twice are then grouped by the identity itself.
    """
    outside = [F.when(~F.coalesce(F.col(k).isin(*v), F.lit(False)), F.concat(F.lit(f"{k}="), F.coalesce(F.col(k), F.lit("NULL")))) for k, v in allowed.items()]
    codes = F.concat(
        F.transform(F.array_compact(F.array(*outside)) if outside else F.array().cast("array<string>"), lambda x: F.struct(F.lit("OUTSIDE_BUILD").alias("issue_code"), x.alias("subject"))),
        F.when(F.coalesce(F.col("source_revision_id"), F.lit("")) == "", F.array(F.struct(F.lit("MISSING_SOURCE_REVISION").alias("issue_code"), F.lit("source_revision_id").alias("subject")))).otherwise(F.array().cast("array<struct<issue_code:string,subject:string>>")),
    )
    rows = facts.select(F.explode(codes).alias("i")).groupBy("i.issue_code", "i.subject").agg(F.count("*").alias("n_rows"))
    definition = ("metric_definition_id", "metric_definition_version")
    entity = F.xxhash64(*[k for k in FACT_IDENTITY if k not in definition]).alias("e")
    held = facts.select(entity, F.xxhash64(*definition).alias("m")).groupBy("e").agg(F.collect_list("m").alias("held"))
    suspects = held.where(F.size("held") > F.size(F.array_distinct("held"))).select("e")
    few = suspects.limit(MOST_SUSPECTS + 1).collect()
    if len(few) <= MOST_SUSPECTS:
        suspects = F.broadcast(facts.sparkSession.createDataFrame(few, "e long"))
    again = facts.select("*", entity).join(suspects, "e", "left_semi")
    twice = again.groupBy(*FACT_IDENTITY).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return rows.unionByName(twice.select(F.lit("DUPLICATE_IDENTITY").alias("issue_code"), F.concat_ws("|", "grain_id", "entity_id", "metric_definition_id", F.col("period_start").cast("string")).alias("subject"), "n_rows"))


#: The order in which a scan returns facts.
SCAN_ORDER = ("retailer_id", "source_id", "period_start", "grain_id", "entity_id", "metric_definition_id")


def query_facts(facts: DataFrame, first=None, last=None, **equal: str) -> DataFrame:
    """Facts of a scope in a fixed order: equalities on retailer_id, source_id, grain_id, metric_concept, metric_definition_id and mart_build_id, and bounds of the period.

    Scope, build and the first month reach the partitions; months end in their own month, so the last bound does, too.
    """
    known = {"retailer_id", "source_id", "grain_id", "metric_concept", "metric_definition_id", "mart_build_id"}
    if wrong := sorted(set(equal) - known):
        raise ValueError(f"no filter on {', '.join(wrong)}")
    for k, v in equal.items():
        facts = facts.where(F.col(k) == v)
    if first is not None:
        facts = facts.where(F.col("period_start") >= F.lit(first).cast("date"))
    if last is not None:
        bound = F.lit(last).cast("date")
        facts = facts.where((F.col("period_start") <= bound) & (F.col("period_end") <= bound))
    return facts.orderBy(*SCAN_ORDER)


def read_policy(facts: DataFrame, first, last, grain: str, scope: dict[str, tuple] | None = None, parents: dict[str, tuple] | None = None, valid_only: bool = True) -> DataFrame:
    """The main fact scan: a grain and window, lists of values for columns, and lists for parents, which are read from their JSON."""
    out = facts.where(F.col("period_start").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("grain_id") == grain))
    for k, values in (scope or {}).items():
        out = out.where(F.col(k).isin(*values))
    for k, values in (parents or {}).items():
        out = out.where(F.get_json_object("parent_entity_ids", f"$.{k}").isin(*values))
    return out.where("quality_status = 'valid'") if valid_only else out


IDENTITY = ("period_start", "entity_type", "entity_id", "category", "manufacturer", "metric")


def metric_facts(wide: DataFrame) -> DataFrame:
    """One fact per metric with its period bounds, parents, components, share scope and range strategy.

    Metrics whose parts the rows lack get none, and the strategy that goes with that; measures that the rows lack have no facts.
    """
    text = lambda x: "cast(null as string)" if x is None else f"'{x}'"
    part = lambda c: f"cast({c} as double)" if c in wide.columns else "cast(null as double)"
    held = {m: x for m, x in MEASURES.items() if m in wide.columns}
    items = ", ".join(f"'{m}', '{a}', {text(scope)}, cast({m} as double), {part(n)}, {part(d)}" for m, (a, n, d, scope) in held.items())
    for c in ("category", "manufacturer"):
        if c not in wide.columns:
            wide = wide.withColumn(c, F.lit(None).cast("string"))
    rows = wide.select("period", "entity_type", "entity_id", "category", "manufacturer", F.expr(f"stack({len(held)}, {items}) as (metric, aggregation, share_scope, value, numerator, denominator)"))
    has_parts = F.col("numerator").isNotNull() & F.col("denominator").isNotNull()
    rows = rows.withColumn("range_strategy", range_strategy(F.col("aggregation"), F.col("metric"), F.col("metric"), has_parts, F.col("share_scope")))
    return rows.select(
        F.col("period").alias("period_start"), F.last_day("period").alias("period_end"), "entity_type", "entity_id", "category", "manufacturer", "metric", "range_strategy", "share_scope", "value", "numerator", "denominator",
        F.when(F.col("value").isNull(), "null_value").otherwise("valid").alias("quality_status"),
    )


def duplicate_identities(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1")


def scan_facts(facts: DataFrame, first, last, metrics=None, grains=None, valid_only: bool = False) -> DataFrame:
    """Facts of a window; the filters reach the stored partitions."""
    out = facts.where(F.col("period_start").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if metrics:
        out = out.where(F.col("metric").isin(*metrics))
    if grains:
        out = out.where(F.col("entity_type").isin(*grains))
    return out.where("quality_status = 'valid'") if valid_only else out


def range_aggregate(facts: DataFrame) -> DataFrame:
    """Facts over a range by each metric's strategy. A NULL part, and what cannot be carried over, gives NULL with a limitation code."""
    whole = lambda c: F.when(F.count(F.col(c)) == F.count("*"), F.sum(F.col(c).cast("decimal(24,8)")).cast("double"))
    out = facts.groupBy("entity_type", "entity_id", "category", "manufacturer", "metric", "range_strategy").agg(
        whole("value").alias("total"), whole("numerator").alias("num"), whole("denominator").alias("den"), F.count("*").alias("n_periods"),
        (F.coalesce(F.min("share_scope") == F.max("share_scope"), F.lit(False)) & (F.count("share_scope") == F.count("*"))).alias("one_scope"),
    )
    s = F.col("range_strategy")
    by_parts = s.isin(RATIO, WEIGHTED, RECOMPUTE, SHARE)
    code = (
        F.when((s == SUM) & F.col("total").isNull(), "additive_value_missing")
        .when(by_parts & (F.col("num").isNull() | F.col("den").isNull()), "range_components_missing").when(by_parts & (F.col("den") == 0), "zero_range_denominator")
        .when((s == SHARE) & ~F.col("one_scope"), "share_scope_missing_or_mixed").when(s == PERIOD_ONLY, "range_aggregation_period_only")
        .when(~(s == SUM) & ~by_parts, "range_aggregation_unsupported")
    )
    out = out.withColumn("limitation", code)
    value = F.when(F.col("limitation").isNull(), F.when(s == SUM, F.col("total")).when(by_parts, ratio("num", "den")))
    return out.select("entity_type", "entity_id", "category", "manufacturer", "metric", "range_strategy", value.alias("value"), F.when(by_parts, F.col("num")).alias("numerator"), F.when(by_parts, F.col("den")).alias("denominator"), "n_periods", "limitation")


def fact_comparison(facts: DataFrame, current, reference) -> DataFrame:
    """Facts of two periods by identity; only what both have."""
    side = lambda p, name: facts.where(F.col("period_start") == F.lit(p).cast("date")).select("entity_type", "entity_id", "category", "manufacturer", "metric", F.col("value").alias(name))
    a, b = side(current, "current_value"), side(reference, "reference_value")
    on = [a[k].eqNullSafe(b[k]) for k in ("entity_type", "entity_id", "category", "manufacturer", "metric")]
    both = a.join(b, on).select(*[a[k] for k in a.columns], "reference_value")
    delta = F.col("current_value") - F.col("reference_value")
    return both.withColumn("delta_abs", delta).withColumn("delta_pct", ratio(delta, "reference_value"))


def month_set_ranges(facts: DataFrame, current: int, reference: int) -> DataFrame:
    """Two years over the months that both have, each carried over by its strategy, then compared."""
    years = facts.where(F.year("period_start").isin(current, reference))
    months = years.select(F.year("period_start").alias("y"), F.month("period_start").alias("m")).distinct()
    shared = months.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m")
    rows = years.join(F.broadcast(shared), F.month("period_start") == F.col("m"), "left_semi")  # at most twelve months
    side = lambda y: range_aggregate(rows.where(F.year("period_start") == y))
    keys = ("entity_type", "entity_id", "category", "manufacturer", "metric")
    a = side(current).select(*keys, F.col("value").alias("current_value"), "n_periods", "limitation")
    b = side(reference).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("value").alias("reference_value"))
    both = a.join(b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]).select(*a.columns, "reference_value")
    delta = F.col("current_value") - F.col("reference_value")
    return both.withColumn("delta_abs", delta).withColumn("delta_pct", ratio(delta, "reference_value"))


def metric_templates(facts: DataFrame) -> DataFrame:
    """The latest fact of each metric tells how rolled-up rows of it are described."""
    last = F.max(F.struct("period_start", "range_strategy", "share_scope", "entity_type"))
    return facts.groupBy("metric").agg(last.alias("t")).select("metric", F.col("t.period_start").alias("period_start"), F.col("t.range_strategy").alias("range_strategy"), F.col("t.share_scope").alias("share_scope"))


def sku_store_facts(df: DataFrame) -> DataFrame:
    return df.groupBy("period", "sku", "store", "category", "manufacturer", "brand", "store_format", "region").agg(
        exact_sum("revenue_vat").alias("revenue_vat"), exact_sum("revenue_net").alias("revenue_net"),
        exact_sum(F.col("units").cast("decimal(18,2)")).alias("units"), exact_sum("margin_abs").alias("margin_abs"),
        (F.sum("null_margins") if "null_margins" in df.columns else F.sum(F.col("margin_abs").isNull().cast("int")).cast("long")).alias("null_margins"),
    )


def store_universe(df: DataFrame) -> DataFrame:
    """Members by month; a store with two formats is marked."""
    return df.groupBy("period", "store").agg(F.min("store_format").alias("store_format"), F.min("region").alias("region"), (F.countDistinct("store_format") > 1).alias("ambiguous_format"))


def rollup_sku_store(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """SKU x store facts to any grain, with the NULL margins counted."""
    m = [exact_sum(F.col(c).cast("decimal(24,8)")).alias(c) for c in ("revenue_vat", "revenue_net", "units", "margin_abs")]
    out = facts.groupBy("period", *keys).agg(*m, F.sum("null_margins").alias("null_margins"), F.countDistinct("sku").alias("n_skus"), F.countDistinct("store").alias("n_stores"))
    return out.withColumn("margin_pct", ratio("margin_abs", "revenue_net"))


def match_catalog(facts: DataFrame, public: DataFrame, private: DataFrame) -> DataFrame:
    """Facts against the catalog (private entries override public ones); metrics without entry get a limitation."""
    merged = public.join(private.select("metric", F.col("label").alias("own_label"), F.col("enabled").alias("own_enabled")), "metric", "full_outer")
    merged = merged.select("metric", F.coalesce("own_label", "label").alias("label"), F.coalesce("own_enabled", "enabled").alias("enabled"))
    counted = facts.groupBy("metric").agg(F.count("*").alias("n_facts"))
    code = F.when(F.col("label").isNull(), "metric_not_in_catalog").when(~F.col("enabled"), "metric_disabled")
    return counted.join(merged, "metric", "left").withColumn("limitation", code)


def provenance(facts: DataFrame) -> DataFrame:
    """What stands behind each metric: periods, grains, quality states."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return facts.groupBy("metric").agg(F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"), F.countDistinct("period_start").alias("n_periods"), join("entity_type").alias("grains"), join("quality_status").alias("quality"))


def register_sources(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """NEW_ARTIFACT, NEW_REVISION or IDENTICAL_DUPLICATE by retailer, source and content hash."""
    known = ledger.groupBy("retailer_id", "source_id").agg(F.count("*").alias("n_known"))
    same = ledger.select("retailer_id", "source_id", "content_hash").distinct().withColumn("same", F.lit(True))
    rows = incoming.join(known, ["retailer_id", "source_id"], "left").join(same, ["retailer_id", "source_id", "content_hash"], "left")
    state = F.when(F.col("same"), "IDENTICAL_DUPLICATE").when(F.col("n_known") > 0, "NEW_REVISION").otherwise("NEW_ARTIFACT")
    return rows.withColumn("registration", state).drop("same", "n_known")


def activate_revisions(revisions: DataFrame) -> DataFrame:
    """One active revision per scope and period, the latest activated; a partly superseded revision keeps its other periods."""
    rows = revisions.select("retailer_id", "source_id", "revision", "activated", F.explode("periods").alias("period"))
    latest = F.row_number().over(Window.partitionBy("retailer_id", "source_id", "period").orderBy(F.desc("activated"), F.desc("revision")))
    return rows.select("retailer_id", "source_id", "revision", "period", (latest == 1).alias("is_active"))
