"""Event facts, rules, composite rules and the signal feed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rule_condition

#: (rule id, event type, feature, conditions, severity).
RULES = (
    ("revenue_up", "MATERIAL_REVENUE_GROWTH", "comparison", [("delta_pct", "gte", 0.10)], "INFO"),
    ("revenue_down", "MATERIAL_REVENUE_DECLINE", "comparison", [("delta_pct", "lte", -0.10)], "WARNING"),
    ("abc_change", "ABC_CLASS_CHANGE", "abc", [("label_changed", "eq", True)], "INFO"),
)


#: The event types and families.
EVENT_TYPES = (
    "MATERIAL_REVENUE_GROWTH", "MATERIAL_REVENUE_DECLINE", "MATERIAL_UNITS_GROWTH", "MATERIAL_UNITS_DECLINE", "MATERIAL_MARGIN_GROWTH", "MATERIAL_MARGIN_DECLINE", "DISTRIBUTION_GAIN",
    "DISTRIBUTION_LOSS", "VELOCITY_GAIN", "VELOCITY_LOSS", "STABLE_VELOCITY", "SHARE_GAIN", "SHARE_LOSS", "PRICE_INCREASE", "PRICE_DECREASE", "MARGIN_PCT_GAIN", "MARGIN_PCT_EROSION", "ABC_CLASS_CHANGE",
    "PERSISTENT_C_CLASS", "STABLE_SKU", "PEER_OUTPERFORMANCE", "PEER_UNDERPERFORMANCE", "HIGH_VELOCITY_LOW_DISTRIBUTION", "LOW_VELOCITY_HIGH_DISTRIBUTION", "PRICE_POWER_PATTERN", "PRICE_PRESSURE_PATTERN", "PROMO_LIKE_PATTERN",
)
EVENT_FAMILIES = ("GROWTH_DECLINE", "DISTRIBUTION", "VELOCITY", "SHARE", "PRICE", "MARGIN_PCT", "PORTFOLIO", "BENCHMARK", "PATTERN_CANDIDATE")


def event_facts(comparisons: DataFrame, abc: DataFrame) -> DataFrame:
    """Comparisons and ABC labels as one long table of features."""
    left = comparisons.select(F.lit("comparison").alias("feature"), "entity_id", "period", "current_value", "reference_value", "delta_pct", "comparison_quality", F.lit(None).cast("string").alias("abc_class"), F.lit(None).cast("string").alias("reference_abc_class"))
    right = abc.select(F.lit("abc").alias("feature"), "entity_id", "period", "abc_class", "reference_abc_class")
    facts = left.unionByName(right, allowMissingColumns=True)
    return facts.withColumn("label_changed", F.col("abc_class") != F.col("reference_abc_class"))


def event_id(*columns: str):
    """24 hexadecimal digits over the sorted fields, NULLs included."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256), 1, 24)


def detect(facts: DataFrame, rules=RULES) -> DataFrame:
    """All rules in one pass: a fact fires each rule of its feature whose conditions hold; low comparison quality lowers confidence."""
    fired = [
        F.when((F.col("feature") == feature) & rule_condition(conditions, facts.columns), F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("event_type"), F.lit(severity).alias("severity")))
        for rule, kind, feature, conditions, severity in rules
    ]
    out = facts.select("*", F.explode(F.array_compact(F.array(*fired))).alias("e")).select("e.*", "entity_id", "period", "current_value", "reference_value", "delta_pct", "comparison_quality")
    return out.withColumn("confidence", confidence(F.lit("HIGH"), F.col("comparison_quality"), F.lit(None).cast("long")))


#: (event type, family, metric, conditions) over comparisons of many metrics.
FAMILY_RULES = (
    ("MATERIAL_REVENUE_GROWTH", "GROWTH_DECLINE", "revenue_net", [("delta_pct", "gte", 0.10)]), ("MATERIAL_REVENUE_DECLINE", "GROWTH_DECLINE", "revenue_net", [("delta_pct", "lte", -0.10)]),
    ("MATERIAL_UNITS_GROWTH", "GROWTH_DECLINE", "units", [("delta_pct", "gte", 0.10)]), ("MATERIAL_UNITS_DECLINE", "GROWTH_DECLINE", "units", [("delta_pct", "lte", -0.10)]),
    ("MATERIAL_MARGIN_GROWTH", "GROWTH_DECLINE", "margin_abs", [("delta_pct", "gte", 0.10)]), ("MATERIAL_MARGIN_DECLINE", "GROWTH_DECLINE", "margin_abs", [("delta_pct", "lte", -0.10)]),
    ("DISTRIBUTION_GAIN", "DISTRIBUTION", "numeric_distribution", [("delta_pp", "gte", 0.05)]), ("DISTRIBUTION_LOSS", "DISTRIBUTION", "numeric_distribution", [("delta_pp", "lte", -0.05)]),
    ("VELOCITY_GAIN", "VELOCITY", "units_per_store", [("delta_pct", "gte", 0.10)]), ("VELOCITY_LOSS", "VELOCITY", "units_per_store", [("delta_pct", "lte", -0.10)]),
    ("STABLE_VELOCITY", "VELOCITY", "units_per_store", [("delta_pct", "between", (-0.05, 0.05))]),
    ("SHARE_GAIN", "SHARE", "category_revenue_share", [("delta_pp", "gte", 0.005)]), ("SHARE_LOSS", "SHARE", "category_revenue_share", [("delta_pp", "lte", -0.005)]),
    ("PRICE_INCREASE", "PRICE", "avg_shelf_price", [("delta_pct", "gte", 0.03)]), ("PRICE_DECREASE", "PRICE", "avg_shelf_price", [("delta_pct", "lte", -0.03)]),
    ("MARGIN_PCT_GAIN", "MARGIN_PCT", "margin_pct", [("delta_pp", "gte", 0.01)]), ("MARGIN_PCT_EROSION", "MARGIN_PCT", "margin_pct", [("delta_pp", "lte", -0.01)]),
)
#: (event type, conditions) over the changes of an entity's metrics side by side; all must be there.
PATTERN_RULES = (
    ("PRICE_POWER_PATTERN", [("avg_shelf_price", "gte", 0.03), ("units", "gte", 0.0)]),
    ("PRICE_PRESSURE_PATTERN", [("avg_shelf_price", "gte", 0.03), ("units", "lte", -0.10)]),
    ("PROMO_LIKE_PATTERN", [("avg_shelf_price", "lte", -0.03), ("units", "gte", 0.10)]),
)


def detect_families(compared: DataFrame, rules=FAMILY_RULES) -> DataFrame:
    """Rules of all families in one pass over comparisons of many metrics; no shuffle."""
    fired = [F.when((F.col("metric") == metric) & rule_condition(conditions, compared.columns), F.struct(F.lit(kind).alias("event_type"), F.lit(family).alias("event_family"))) for kind, family, metric, conditions in rules]
    out = compared.select("*", F.explode(F.array_compact(F.array(*fired))).alias("e"))
    out = out.withColumn("confidence", confidence(F.lit("HIGH"), F.col("comparison_quality"), F.lit(None).cast("long")))
    return out.select("e.*", "entity_id", "period", "metric", "current_value", "reference_value", "delta_pct", "delta_pp", "confidence")


def patterns(compared: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """Pattern candidates: the relative changes of the named metrics of an entity and period side by side, in one grouping."""
    names = sorted({field for _, conditions in rules for field, _, _ in conditions})
    rows = compared.where(F.col("metric").isin(*names))  # only what the rules look at is shuffled
    wide = rows.groupBy("entity_id", "period").agg(*[F.max(F.when(F.col("metric") == m, F.col("delta_pct"))).alias(m) for m in names])
    fired = [F.when(rule_condition(conditions, wide.columns), F.lit(kind)) for kind, conditions in rules]
    return wide.select(F.explode(F.array_compact(F.array(*fired))).alias("event_type"), F.lit("PATTERN_CANDIDATE").alias("event_family"), "entity_id", "period", *names)


def confidence(own, quality, population):
    """HIGH falls to MEDIUM on a comparison of LOW quality or a population under two."""
    weak = F.coalesce(quality == "LOW", F.lit(False)) | F.coalesce(population < 2, F.lit(False))
    return F.when((own == "HIGH") & weak, "MEDIUM").otherwise(own)


#: What an event id stands for: where it comes from, its rule in its version, and what it is about.
IDENTITY = ("analysis_run_id", "retailer_id", "source_id", "rule_version", "rule_id", "event_config_hash", "event_type", "entity_id", "period")


def identified(events: DataFrame, analysis_run_id: str, retailer_id: str, source_id: str, rule_version: str, rules=RULES) -> DataFrame:
    """Events with the context they were made in and their ids."""
    config = hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:16]
    context = {"analysis_run_id": analysis_run_id, "retailer_id": retailer_id, "source_id": source_id, "rule_version": rule_version, "event_config_hash": config}
    out = events.withColumns({k: F.lit(v) for k, v in context.items()})
    return out.withColumn("event_id", event_id(*IDENTITY))


def deduplicated(events: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """One row for each id; ``conflict`` marks ids whose rows differ in the payload, of which the least stays."""
    held = F.struct(*payload)
    return events.groupBy("event_id").agg(F.min(held).alias("e"), F.count("*").alias("n_rows"), (F.min(held) != F.max(held)).alias("conflict")).select("event_id", "e.*", "n_rows", "conflict")


def vocabulary_issues(rules: DataFrame) -> DataFrame:
    """Issues of rules (rule_id, event_type, event_family): unknown types and families, rule ids that stand more than once."""
    rules = rules.withColumn("n_rules", F.count("*").over(Window.partitionBy("rule_id")))
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    issues = F.array_compact(F.array(F.when(~known("event_type", EVENT_TYPES), "UNKNOWN_EVENT_TYPE"), F.when(~known("event_family", EVENT_FAMILIES), "UNKNOWN_EVENT_FAMILY"), F.when(F.col("n_rules") > 1, "DUPLICATE_EVENT_RULE_ID")))
    return rules.select("rule_id", F.explode(issues).alias("issue_code")).distinct()


def candidates(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts that a rule may look at: its feature, and the entity types and qualities it names (NULL lists take all). Rules are few."""
    rules = rules.select("rule_id", F.col("feature").alias("wanted"), "entity_types", "qualities")
    named = lambda values, c: F.col(values).isNull() | F.coalesce(F.array_contains(values, F.col(c)), F.lit(False))
    return facts.join(rules, (F.col("feature") == F.col("wanted")) & named("entity_types", "entity_type") & named("qualities", "comparison_quality")).drop("wanted", "entity_types", "qualities")


def scope_limitations(columns: list[str], filters: dict[str, tuple], grain: str = "network", private_label_scope: str = "INCLUDE", entity_ids: tuple = ()) -> tuple[str, ...]:
    """Filters that stored events cannot answer; a feed with any of them stays empty instead of ignoring the filter."""
    held, out = set(columns), []
    if private_label_scope != "INCLUDE" and "private_label_scope" not in held:
        out.append("event_private_label_scope_not_materialized")
    if (grain != "network" or entity_ids) and not {"entity_type", "entity_id"} <= held:
        out.append("event_entity_scope_not_materialized")
    for key in ("category", "manufacturer", "brand", "package", "volume", "sku", "store"):
        there = key in held or (key == "volume" and "volume_l" in held) or (key != "category" and grain == key and {"entity_type", "entity_id"} <= held)
        if filters.get(key) and not there:
            out.append(f"event_{key}_scope_not_materialized")
    return tuple(out)


def composite(facts: DataFrame, conditions) -> DataFrame:
    """Features of an entity and month side by side; all must be there and hold."""
    wide = facts.groupBy("entity_id", "period").agg(F.max(F.when(F.col("feature") == "comparison", F.col("delta_pct"))).alias("comparison_delta_pct"), F.max(F.when(F.col("feature") == "abc", F.col("abc_class"))).alias("abc_abc_class"))
    return wide.where(rule_condition(conditions, wide.columns))


def missing_features(facts: DataFrame, rules=RULES) -> DataFrame:
    spark = facts.sparkSession
    wanted = spark.createDataFrame([(r[0], r[2]) for r in rules], "rule_id string, feature string")
    return wanted.join(facts.select("feature").distinct(), "feature", "left_anti").select("rule_id", "feature")


def signal_feed(events: DataFrame, per_type: int = 5) -> DataFrame:
    """The strongest events of each type, and how many each type left out."""
    part = Window.partitionBy("event_type")
    place = F.row_number().over(part.orderBy(F.desc_nulls_last(F.abs("delta_pct")), "entity_id", "period"))
    kind = F.when(F.col("event_type") == "ABC_CLASS_CHANGE", "pattern").otherwise("commercial")
    rows = events.select("*", place.alias("place"), F.count("*").over(part).alias("n"))
    return rows.where(F.col("place") <= per_type).select("event_type", kind.alias("signal_class"), "entity_id", "period", "delta_pct", "place", F.greatest(F.col("n") - per_type, F.lit(0)).alias("excluded"))
