"""Event facts in their fixed layout, and event rules as tables: typed condition rows that facts must satisfy all of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import confidence
from .governance import applicable

#: The columns of event facts with their types, in order.
FACT_COLUMNS = {
    "analysis_run_id": "string",
    "retailer_id": "string",
    "source_id": "string",
    "rule_version": "string",
    "entity_type": "string",
    "entity_id": "string",
    "category": "string",
    "input_source": "string",
    "feature_name": "string",
    "period": "date",
    "reference_period": "date",
    "comparison_type": "string",
    "comparison_quality": "string",
    "observed_value": "double",
    "reference_value": "double",
    "observed_label": "string",
    "reference_label": "string",
    "label_changed": "boolean",
    "delta_abs": "double",
    "delta_pct": "double",
    "delta_pp": "double",
    "metric_definition_id": "string",
    "metric_definition_version": "string",
    "metric_config_hash": "string",
    "benchmark_scope": "string",
    "benchmark_scope_id": "string",
    "pool_source": "string",
    "peer_rule_id": "string",
    "peer_rule_version": "string",
    "peer_config_hash": "string",
    "price_segment_rule_id": "string",
    "price_segment_rule_version": "string",
    "price_segment_config_hash": "string",
    "rank": "double",
    "percentile": "double",
    "population_size": "long",
    "peer_median_price": "double",
}
CONTEXT = ("analysis_run_id", "retailer_id", "source_id", "rule_version")
#: Columns of a fact that conditions may name, and those that features of a composite rule bring along under their own name.
NUMBERS = tuple(k for k, t in FACT_COLUMNS.items() if t in ("double", "long"))
TEXTS = tuple(k for k, t in FACT_COLUMNS.items() if t in ("string", "boolean"))
SIDE_BY_SIDE = ("observed_value", "reference_value", "delta_abs", "delta_pct", "delta_pp", "rank", "percentile", "population_size")
#: What the facts of a composite rule have in common.
TOGETHER = (
    *CONTEXT, "entity_type", "entity_id", "category", "input_source", "period", "reference_period", "comparison_type", "comparison_quality", "benchmark_scope", "benchmark_scope_id", "pool_source",
)
RULE = """rule_id string, retailer_id string, source_id string, rule_version string, enabled boolean, event_type string, event_family string, input_source string, required_features array<string>,
 required_metrics array<string>, entity_types array<string>, comparison_types array<string>, severity string, confidence string, observed_drivers array<string>, hypothesis_candidates array<string>, optional_evidence array<string>"""
CONDITION = "rule_id string, field string, operator string, number double, high double, texts array<string>, numbers array<double>"
#: Rules that are broadcast, under a kilobyte each.
MOST_RULES = 10_000


def _laid_out(rows: DataFrame, source: str, made: dict[str, Column], context: dict[str, str]) -> DataFrame:
    """Rows of a context in the layout of event facts: what is not made and not there is NULL."""
    here = [k for k in CONTEXT if k in rows.columns and k != "rule_version"]
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k) == context[k] for k in here], F.lit(True)))
    version = F.coalesce(F.col("rule_version") if "rule_version" in rows.columns else F.lit(None), F.lit(context["rule_version"]))
    made = {k: F.lit(context[k]) for k in CONTEXT} | {"input_source": F.lit(source)} | made | {"rule_version": version}
    return rows.select(*[(made[k] if k in made else F.col(k) if k in rows.columns else F.lit(None)).cast(t).alias(k) for k, t in FACT_COLUMNS.items()])


def _first(rows: DataFrame, *names: str) -> Column:
    return next((F.col(n) for n in names if n in rows.columns), F.lit(None))


def comparison_facts(rows: DataFrame, context: dict[str, str]) -> DataFrame:
    """Comparisons as event facts: a feature is a concept, or else a metric's name or definition."""
    blank = {k: F.lit(None) for k in ("observed_label", "reference_label", "label_changed", "benchmark_scope", "benchmark_scope_id", "pool_source", "rank", "percentile", "population_size", "peer_median_price")}
    return _laid_out(rows, "comparison", blank | {"feature_name": _first(rows, "concept", "metric_name", "metric_definition_id"), "period": _first(rows, "current_period", "period"), "observed_value": F.col("current_value")}, context)


def abc_facts(rows: DataFrame, context: dict[str, str]) -> DataFrame:
    """ABC classes as event facts: labels, and whether they changed."""
    past = _first(rows, "reference_abc_class")
    blank = {k: F.lit(None) for k in ("observed_value", "reference_value", "delta_abs", "delta_pct", "delta_pp", "comparison_quality", "rank", "percentile", "population_size")}
    made = {"feature_name": _first(rows, "abc_metric", "concept", "metric_definition_id"), "observed_label": F.col("abc_class"), "reference_label": past, "label_changed": F.col("abc_class") != past}
    return _laid_out(rows, "abc", blank | made, context)


def benchmark_facts(rows: DataFrame, context: dict[str, str]) -> DataFrame:
    """Benchmark features as event facts: the period is the one that the peers were taken in, the deltas are those to their median price."""
    made = {
        "entity_id": _first(rows, "entity_id", "target_entity_id"), "entity_type": F.coalesce(_first(rows, "entity_type").cast("string"), F.lit("sku")), "feature_name": F.col("metric_name"),
        "period": _first(rows, "reference_period"), "reference_period": F.lit(None), "observed_value": _first(rows, "metric_value", "target_price"), "reference_value": F.lit(None),
        "delta_abs": _first(rows, "price_vs_peer_median_abs"), "delta_pct": _first(rows, "price_delta_pct_to_peer_median"), "delta_pp": F.lit(None), "comparison_type": F.lit(None), "comparison_quality": F.lit(None), "metric_config_hash": F.lit(None),
    }
    return _laid_out(rows, "benchmark", made, context)


def rule_tables(spark: SparkSession, specs, retailer_id: str, rule_version: str) -> tuple[DataFrame, DataFrame]:
    """(rules, conditions) of specifications: id, type, family, source, features, conditions, and optional columns of the rule by name.

    A condition is (field, operator, value); between takes a pair, in and not_in take a list.
    """
    names = [c.split()[0] for c in RULE.replace("\n", "").split(", ")]
    rules, conditions = [], []
    for rule_id, event_type, family, source, features, held, more in specs:
        own = {"severity": "MEDIUM", "confidence": "HIGH", "enabled": True, "retailer_id": retailer_id, "rule_version": rule_version} | {k: [] for k in names if k.endswith(("s", "evidence")) and k not in ("required_features",)}
        own |= {"rule_id": rule_id, "event_type": event_type, "event_family": family, "input_source": source, "required_features": list(features)} | more
        rules.append(tuple(own.get(n) for n in names))
        for field, operator, value in held:
            values = list(value) if isinstance(value, (list, tuple)) else [value]
            text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
            numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
            conditions.append((rule_id, field, operator, numbers[0] if numbers else None, numbers[1] if operator == "between" else None, [text(v) for v in values if not isinstance(v, (int, float)) or isinstance(v, bool)], numbers))
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(conditions, CONDITION)


def _holds(c: Column, number: Column, text: Column) -> Column:
    """Whether a condition row holds for a field's number or text; NULL does not."""
    op = c["operator"]
    among = F.coalesce(F.array_contains(c["numbers"], number), F.lit(False)) | F.coalesce(F.array_contains(c["texts"], text), F.lit(False))
    met = (
        F.when(op == "gt", number > c["number"]).when(op == "gte", number >= c["number"]).when(op == "lt", number < c["number"]).when(op == "lte", number <= c["number"])
        .when(op == "between", number.between(c["number"], c["high"])).when(op.isin("eq", "in"), among).when(op == "not_in", (number.isNotNull() | text.isNotNull()) & ~among)
    )
    return F.coalesce(met, F.lit(False))


def _all_hold(conditions: Column, number_of, text_of) -> Column:
    """Division: as many conditions hold as the rule has, and it has one."""
    return (F.size(conditions) > 0) & (F.size(F.filter(conditions, lambda c: _holds(c, number_of(c["field"]), text_of(c["field"])))) == F.size(conditions))


def _names(values: Column, value: Column) -> Column:
    """Whether a list takes a value; an empty list takes all."""
    return (F.coalesce(F.size(values), F.lit(0)) <= 0) | F.coalesce(F.array_contains(values, value), F.lit(False))


def _listed(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row for each source with its rules, single and composite apart; rules without conditions are in no list."""
    held = conditions.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("field", "operator", "number", "high", "texts", "numbers"))).alias("conditions"))
    rows = rules.join(held, "rule_id")
    out = rows.groupBy("input_source", (F.size("required_features") > 1).alias("composite")).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rules"))
    return F.broadcast(out) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else out


EVENT_TEXTS = ("event_rule_id", "event_rule_version", "event_type", "event_family", "input_source", "feature_name", "severity", "confidence")


def detect_events(facts: DataFrame, rules: DataFrame, conditions: DataFrame, context: dict[str, str]) -> DataFrame:
    """Events of all rules of a context: relational division of facts by the condition rows of each rule, in place.

    A fact meets the rules of its source as one list, so facts are neither multiplied by rules nor shuffled; only facts of
    rules on several features are first brought together by entity, period and comparison. A condition on a field that is
    not there, or is NULL, does not hold. Rules of other retailers, versions or sources, and disabled ones, fire nothing.
    """
    own = applicable(rules, context["retailer_id"], context["source_id"], context["rule_version"])
    listed = _listed(own, conditions)
    scoped = facts.where(reduce(lambda a, b: a & b, [F.col(k) == context[k] for k in CONTEXT]))
    value = lambda names: lambda field: F.element_at(F.col(names), field)

    single = scoped.join(listed.where("not composite").drop("composite"), "input_source")
    single = single.withColumns({
        "_numbers": F.create_map(*[x for k in NUMBERS for x in (F.lit(k), F.col(k).cast("double"))]), "_texts": F.create_map(*[x for k in TEXTS for x in (F.lit(k), F.col(k).cast("string"))]),
    })
    fits = lambda r: (
        _names(r["required_features"], F.col("feature_name")) & _names(r["entity_types"], F.col("entity_type")) & _names(r["required_metrics"], F.col("metric_definition_id"))
        & _names(r["comparison_types"], F.col("comparison_type")) & _all_hold(r["conditions"], value("_numbers"), value("_texts"))
    )
    fired = single.withColumn("r", F.explode(F.filter("rules", fits))).drop("rules", "_numbers", "_texts")

    # facts of composite rules side by side, as (feature_column, value) entries
    needed = listed.where("composite").select("input_source", F.array_distinct(F.flatten(F.transform("rules", lambda r: r["required_features"]))).alias("features"))
    used = scoped.join(F.broadcast(needed), "input_source").where(F.array_contains("features", F.col("feature_name")))  # a row a source
    entries = F.array(*[F.struct(F.concat("feature_name", F.lit(f"_{k}")).alias("name"), F.col("metric_definition_id").alias("metric"), F.col(k).cast("double").alias("value")) for k in SIDE_BY_SIDE])
    wide = used.withColumn("entries", entries).groupBy(*TOGETHER).agg(F.flatten(F.collect_list("entries")).alias("entries"), F.collect_set(F.struct("feature_name", F.col("metric_definition_id").alias("metric"))).alias("features"))
    wide = wide.join(listed.where("composite").drop("composite"), "input_source")

    def together(r: Column) -> Column:
        mine = F.filter("entries", lambda e: _names(r["required_metrics"], e["metric"]))
        there = F.transform(F.filter("features", lambda f: _names(r["required_metrics"], f["metric"])), lambda f: f["feature_name"])
        number = lambda field: F.array_max(F.transform(F.filter(mine, lambda e: e["name"] == field), lambda e: e["value"]))
        text = lambda field: F.lit(None).cast("string")  # noqa: E731, ARG005
        return F.forall(r["required_features"], lambda f: F.array_contains(there, f)) & _names(r["entity_types"], F.col("entity_type")) & _names(r["comparison_types"], F.col("comparison_type")) & _all_hold(r["conditions"], number, text)

    both = wide.withColumn("r", F.explode(F.filter("rules", together)))
    shown = F.filter("entries", lambda e: e["name"].rlike("_delta_(pct|pp|abs)$") & F.exists(F.col("r.required_features"), lambda f: e["name"].startswith(F.concat(f, F.lit("_")))))
    both = both.withColumn("features_values", F.to_json(F.array_sort(F.array_distinct(F.transform(shown, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))))))
    both = both.select(*TOGETHER, "r", "features_values", F.array_join("r.required_features", "+").alias("feature_name"))
    fired = fired.unionByName(both, allowMissingColumns=True)
    thresholds = F.to_json(F.transform("r.conditions", lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), c["number"].alias("value"), c["high"].alias("high"), c["texts"].alias("texts"))))
    trigger = F.coalesce("features_values", F.to_json(F.struct("observed_value", "reference_value", "observed_label", "reference_label", "delta_abs", "delta_pct", "delta_pp", "rank", "percentile", "population_size")))
    lineage = [k for k in FACT_COLUMNS if k.startswith(("benchmark_", "pool_", "peer_rule", "peer_config", "price_segment"))]
    return fired.select(
        *CONTEXT, F.col("r.rule_id").alias("event_rule_id"), F.col("r.rule_version").alias("event_rule_version"), "r.event_type", "r.event_family", "entity_type", "entity_id", "category", "period", "reference_period", "comparison_type", "comparison_quality",
        "input_source", "feature_name", "observed_value", "reference_value", "observed_label", "reference_label", F.col("observed_label").alias("current_class"), F.col("reference_label").alias("reference_class"), "delta_abs", "delta_pct", "delta_pp",
        "rank", "percentile", "population_size", thresholds.alias("thresholds"), trigger.alias("trigger_values"), "r.severity", confidence(F.col("r.confidence"), F.col("comparison_quality"), F.col("population_size")).alias("confidence"), F.lit(True).alias("is_material"),
        *[F.to_json(f"r.{k}").alias(k) for k in ("observed_drivers", "hypothesis_candidates")], F.to_json("r.optional_evidence").alias("missing_evidence"),
        F.to_json(F.struct("metric_definition_id", "metric_definition_version", "metric_config_hash")).alias("metric_lineage"), F.to_json(F.struct(*lineage)).alias("benchmark_lineage"), *lineage,
    )


#: What an event is told by.
EVENT_IDENTITY = (
    "analysis_run_id", "retailer_id", "source_id", "rule_version", "event_rule_id", "event_rule_version", "event_config_hash", "event_type", "event_family", "entity_type", "entity_id", "period", "reference_period", "input_source", "feature_name",
    "comparison_type", "benchmark_scope_id", "pool_source", "peer_rule_id", "peer_rule_version", "peer_config_hash", "price_segment_rule_id", "price_segment_rule_version", "price_segment_config_hash",
)


def config_digest(rules: DataFrame, conditions: DataFrame) -> str:
    """Identity of a rule configuration, whatever the order of its rows."""
    own = lambda df: F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    row = rules.agg(own(rules).alias("r")).crossJoin(conditions.agg(own(conditions).alias("c"))).select(F.substring(F.sha2(F.concat_ws("|", F.col("r").cast("string"), F.col("c").cast("string")), 256), 1, 16)).first()
    return row[0]


def rule_issues(facts: DataFrame, rules: DataFrame, conditions: DataFrame, context: dict[str, str]) -> DataFrame:
    """``(rule_id, issue_code, severity, subject)`` of a context: rules without conditions, features that no fact of the source has, fields that facts never have."""
    own = applicable(rules, context["retailer_id"], context["source_id"], context["rule_version"])
    scoped = facts.where(reduce(lambda a, b: a & b, [F.col(k) == context[k] for k in CONTEXT]))
    bare = own.join(conditions.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", F.lit("INVALID_EVENT_CONDITION").alias("issue_code"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("subject"))
    wanted = own.select("rule_id", "input_source", F.explode("required_features").alias("subject"))
    there = scoped.select("input_source", F.col("feature_name").alias("subject")).distinct()
    missing = wanted.join(there, ["input_source", "subject"], "left_anti").select("rule_id", F.lit("MISSING_EVENT_FEATURE").alias("issue_code"), F.lit("WARNING").alias("severity"), "subject")
    plain = F.array(*map(F.lit, (*NUMBERS, *TEXTS)))
    beside = F.flatten(F.transform("required_features", lambda f: F.transform(F.array(*map(F.lit, SIDE_BY_SIDE)), lambda k: F.concat(f, F.lit("_"), k))))
    named = own.join(conditions.select("rule_id", "field"), "rule_id").where(~F.array_contains(F.when(F.size("required_features") > 1, beside).otherwise(plain), F.col("field")))
    return bare.unionByName(missing).unionByName(named.select("rule_id", F.lit("MISSING_EVENT_FEATURE").alias("issue_code"), F.lit("WARNING").alias("severity"), F.col("field").alias("subject")).distinct())


def _side(metric: str, field: str, operator: str, value) -> tuple:
    return (f"{metric}_{field}", operator, value)


#: The standard rules: id, type, family, source, features, conditions, other columns. They name all event types.
STANDARD = (
    ("revenue_growth.v1", "MATERIAL_REVENUE_GROWTH", "GROWTH_DECLINE", "comparison", ("revenue",), (("delta_pct", "gte", 0.10),), {"observed_drivers": ["revenue_delta_pct"]}),
    ("revenue_decline.v1", "MATERIAL_REVENUE_DECLINE", "GROWTH_DECLINE", "comparison", ("revenue",), (("delta_pct", "lte", -0.10),), {"severity": "HIGH", "comparison_types": ["YOY", "MOM", "PREVIOUS_AVAILABLE"], "observed_drivers": ["revenue_delta_pct"]}),
    ("units_growth.v1", "MATERIAL_UNITS_GROWTH", "GROWTH_DECLINE", "comparison", ("units",), (("delta_pct", "gte", 0.10),), {"observed_drivers": ["units_delta_pct"]}),
    ("units_decline.v1", "MATERIAL_UNITS_DECLINE", "GROWTH_DECLINE", "comparison", ("units",), (("delta_pct", "lte", -0.10),), {}),
    ("margin_growth.v1", "MATERIAL_MARGIN_GROWTH", "GROWTH_DECLINE", "comparison", ("retailer_margin_abs",), (("delta_pct", "gte", 0.10),), {}),
    ("margin_decline.v1", "MATERIAL_MARGIN_DECLINE", "GROWTH_DECLINE", "comparison", ("retailer_margin_abs",), (("delta_pct", "lte", -0.10),), {"severity": "HIGH"}),
    ("distribution_gain.v1", "DISTRIBUTION_GAIN", "DISTRIBUTION", "comparison", ("distribution",), (("delta_pp", "gte", 0.05),), {}),
    ("distribution_loss.v1", "DISTRIBUTION_LOSS", "DISTRIBUTION", "comparison", ("distribution",), (("delta_pp", "lte", -0.05),), {"severity": "HIGH"}),
    ("velocity_gain.v1", "VELOCITY_GAIN", "VELOCITY", "comparison", ("velocity",), (("delta_pct", "gte", 0.10),), {}),
    ("velocity_loss.v1", "VELOCITY_LOSS", "VELOCITY", "comparison", ("velocity",), (("delta_pct", "lte", -0.10),), {"severity": "HIGH"}),
    ("stable_velocity.v1", "STABLE_VELOCITY", "VELOCITY", "comparison", ("velocity",), (("delta_pct", "between", (-0.05, 0.05)),), {"severity": "INFO"}),
    ("share_gain.v1", "SHARE_GAIN", "SHARE", "comparison", ("category_revenue_share",), (("delta_pp", "gte", 0.02),), {}),
    ("share_loss.v1", "SHARE_LOSS", "SHARE", "comparison", ("category_revenue_share",), (("delta_pp", "lte", -0.02),), {}),
    ("price_increase.v1", "PRICE_INCREASE", "PRICE", "comparison", ("weighted_shelf_price_vat", "velocity", "distribution"), (_side("weighted_shelf_price_vat", "delta_pct", "gte", 0.10), _side("velocity", "delta_pct", "lte", -0.10), _side("distribution", "delta_pp", "between", (-0.02, 0.02))), {}),
    ("price_decrease.v1", "PRICE_DECREASE", "PRICE", "comparison", ("weighted_shelf_price_vat",), (("delta_pct", "lte", -0.10),), {}),
    ("margin_pct_gain.v1", "MARGIN_PCT_GAIN", "MARGIN_PCT", "comparison", ("retailer_margin_pct",), (("delta_pp", "gte", 0.02),), {}),
    ("margin_pct_erosion.v1", "MARGIN_PCT_EROSION", "MARGIN_PCT", "comparison", ("retailer_margin_pct",), (("delta_pp", "lte", -0.02),), {"severity": "HIGH"}),
    ("abc_class_change.v1", "ABC_CLASS_CHANGE", "PORTFOLIO", "abc", ("abc_revenue",), (("label_changed", "eq", True),), {"severity": "INFO"}),
    ("persistent_c.v1", "PERSISTENT_C_CLASS", "PORTFOLIO", "abc", ("abc_revenue",), (("observed_label", "eq", "C"), ("reference_label", "eq", "C")), {"severity": "LOW"}),
    ("stable_sku.v1", "STABLE_SKU", "PORTFOLIO", "comparison", ("revenue", "units"), (_side("revenue", "delta_pct", "between", (-0.05, 0.05)), _side("units", "delta_pct", "between", (-0.05, 0.05))), {"severity": "INFO"}),
    ("peer_outperformance.v1", "PEER_OUTPERFORMANCE", "BENCHMARK", "benchmark", ("revenue_net",), (("percentile", "gte", 0.80),), {"confidence": "MEDIUM"}),
    ("peer_underperformance.v1", "PEER_UNDERPERFORMANCE", "BENCHMARK", "benchmark", ("revenue_net",), (("percentile", "lte", 0.20), ("benchmark_scope", "in", ["BROAD", "TOP_N"])), {"confidence": "MEDIUM"}),
    ("high_velocity_low_distribution.v1", "HIGH_VELOCITY_LOW_DISTRIBUTION", "BENCHMARK", "benchmark", ("units_per_selling_store", "numeric_distribution"), (_side("units_per_selling_store", "percentile", "gte", 0.80), _side("numeric_distribution", "percentile", "lte", 0.50), _side("units_per_selling_store", "population_size", "gte", 2)), {"confidence": "MEDIUM"}),
    ("low_velocity_high_distribution.v1", "LOW_VELOCITY_HIGH_DISTRIBUTION", "BENCHMARK", "benchmark", ("units_per_selling_store", "numeric_distribution"), (_side("units_per_selling_store", "percentile", "lte", 0.20), _side("numeric_distribution", "percentile", "gte", 0.50)), {"confidence": "MEDIUM"}),
    ("price_power.v1", "PRICE_POWER_PATTERN", "PATTERN_CANDIDATE", "comparison", ("weighted_shelf_price_vat", "units"), (_side("weighted_shelf_price_vat", "delta_pct", "gte", 0.03), _side("units", "delta_pct", "gte", 0.0)), {"confidence": "MEDIUM"}),
    ("price_pressure.v1", "PRICE_PRESSURE_PATTERN", "PATTERN_CANDIDATE", "comparison", ("weighted_shelf_price_vat",), (("delta_pct", "gte", 0.10),), {"confidence": "MEDIUM", "hypothesis_candidates": ["PRICE_ELASTICITY"], "optional_evidence": ["promo_calendar", "stock"]}),
    ("promo_like.v1", "PROMO_LIKE_PATTERN", "PATTERN_CANDIDATE", "comparison", ("weighted_shelf_price_vat", "units"), (_side("weighted_shelf_price_vat", "delta_pct", "lte", -0.03), _side("units", "delta_pct", "gte", 0.10)), {"confidence": "MEDIUM", "optional_evidence": ["promo_calendar"]}),
)
