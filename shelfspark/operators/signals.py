"""The signal feed over confirmed events, and where these events come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import volume_filter
from .events import scope_limitations

#: Which families are surfaced as what, and what is never surfaced.
COMMERCIAL_FAMILIES = ("GROWTH_DECLINE", "DISTRIBUTION", "VELOCITY", "SHARE", "PRICE", "MARGIN_PCT")
PATTERN_FAMILIES = ("PATTERN_CANDIDATE",)
NON_SURFACED_TYPES = ("PROMO_LIKE_PATTERN", "ABC_CLASS_CHANGE", "PERSISTENT_C_CLASS")
NON_SURFACED_FAMILIES = ("PORTFOLIO", "BENCHMARK")
SIGNAL_TYPES = ("COMMERCIAL_SIGNAL", "DETERMINISTIC_PATTERN", "DATA_QUALITY_ALERT")
PERIOD_LIMITATIONS = {"AVAILABLE_MONTH_SET": "signals_available_month_set_unsupported", "DATE_RANGE": "signals_date_range_unsupported", "FULL_AVAILABLE_HISTORY": "signals_full_history_unsupported"}
SORT = ("severity", "event_type", "entity_type", "entity_id", "period")


@dataclass(frozen=True)
class Request:
    """What a feed is asked for."""

    retailer_id: str
    source_id: str
    date_from: str | None = None
    date_to: str | None = None
    period_mode: str = "SINGLE_PERIOD"
    grain_id: str = "network"
    entity_ids: tuple[str, ...] = ()
    entity_filters: dict[str, tuple] = field(default_factory=dict)
    comparison_mode: str = "NONE"
    private_label_scope: str = "INCLUDE"
    signal_types: tuple[str, ...] = SIGNAL_TYPES
    limit: int = 50


@dataclass(frozen=True)
class Feed:
    """The rows of a feed, its one-row status and what it left out by type."""

    rows: DataFrame
    status: DataFrame
    excluded: DataFrame


def classified(events: DataFrame) -> Column:
    """The signal type of an event; NULL where it is not surfaced."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in events.columns else F.lit("")
    kind, family = text("event_type"), text("event_family")
    return (
        F.when((text("input_source") == "quality") | (family == "DATA_QUALITY"), "DATA_QUALITY_ALERT")
        .when(kind.isin(*NON_SURFACED_TYPES) | family.isin(*NON_SURFACED_FAMILIES), F.lit(None))
        .when(family.isin(*PATTERN_FAMILIES), "DETERMINISTIC_PATTERN").when(family.isin(*COMMERCIAL_FAMILIES), "COMMERCIAL_SIGNAL")
    )


def scoped(events: DataFrame, request: Request) -> DataFrame:
    """Events of the request's scope; every filter is a condition on columns that are there, so those on months reach stored partitions."""
    held, out = set(events.columns), events
    for name, value in (("retailer_id", request.retailer_id), ("source_id", request.source_id)):
        out = out.where(F.col(name) == value) if name in held else out
    if request.date_from is not None and "period" in held:
        out = out.where(F.col("period") >= F.lit(request.date_from).cast("date"))
    if request.date_to is not None and "period" in held:
        out = out.where(F.col("period") <= F.lit(request.date_to).cast("date"))
    if request.comparison_mode != "NONE" and "comparison_type" in held:
        out = out.where(F.col("comparison_type") == request.comparison_mode)
    if "private_label_scope" in held:
        out = out.where(F.col("private_label_scope") == request.private_label_scope)
    for name in ("category", "manufacturer", "brand", "package", "volume", "sku", "store"):
        values = request.entity_filters.get(name)
        if not values:
            continue
        if name == "volume" and "volume_l" in held:
            out = out.where(volume_filter("volume_l", tuple(v for v in values if not isinstance(v, str)), tuple(v for v in values if isinstance(v, str))))
        elif name in held:
            out = out.where(F.col(name).isin(*values))
        elif name != "category" and request.grain_id == name and {"entity_type", "entity_id"} <= held:
            out = out.where((F.col("entity_type") == name) & F.col("entity_id").isin(*values))
    if request.grain_id != "network" and "entity_type" in held:
        out = out.where(F.col("entity_type") == request.grain_id)
    return out.where(F.col("entity_id").isin(*request.entity_ids)) if request.entity_ids and "entity_id" in held else out


def _closed(events: DataFrame, status: str, limitations: list[str]) -> Feed:
    none = events.where(F.lit(False))
    rows = none.select("*", F.lit(None).cast("string").alias("signal_type"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("status"))
    row = events.sparkSession.range(1).select(F.lit(status).alias("status"), F.lit(0).cast("long").alias("event_count"), F.lit(0).cast("long").alias("surfaced_event_count"), F.lit(",".join(limitations)).alias("limitations"))
    return Feed(rows, row, none.groupBy("event_type").agg(F.count("*").alias("n")))


def feed(events: DataFrame | None, request: Request, spark=None, enabled_rules: int | None = None) -> Feed:
    """Confirmed events as signals: by class, at most ``limit`` of each in a fixed order, with counts of what is never surfaced.

    A request that stored events cannot answer gets no rows instead of ones that ignore it. Classes are kept by their best
    rows in each task first, so no class is sorted as a whole.
    """
    if events is None:
        nothing = spark.createDataFrame([], "event_type string, event_family string, severity string, entity_type string, entity_id string, period date")
        return _closed(nothing, "NOT_CONFIGURED", ["signal_events_path_not_configured"])
    if request.period_mode in PERIOD_LIMITATIONS:
        return _closed(events, "NO_SURFACED_SIGNALS", [PERIOD_LIMITATIONS[request.period_mode]])
    if not events.take(1):
        return _closed(events, "NO_CONFIRMED_EVENTS", ["no_enabled_event_rules" if enabled_rules == 0 else "no_confirmed_events"])
    blocking = list(dict.fromkeys(scope_limitations(events.columns, request.entity_filters, request.grain_id, request.private_label_scope, request.entity_ids)))
    if blocking:
        return _closed(events, "NO_SURFACED_SIGNALS", blocking)
    limits = [] if "private_label_scope" in events.columns else ["event_private_label_scope_not_materialized"]
    own = scoped(events, request).withColumn("signal_type", classified(events))
    order = [F.asc(c) for c in SORT if c in events.columns] + [F.asc(c) for c in ("event_id", "event_rule_id", "feature_name") if c in events.columns]
    asked = own.where(F.col("signal_type").isin(*request.signal_types))
    kept = asked.withColumn("place", F.row_number().over(Window.partitionBy("signal_type").orderBy(*order))).where(F.col("place") <= request.limit)
    low = F.coalesce(F.col("comparison_quality") == "LOW", F.lit(False)) if "comparison_quality" in events.columns else F.lit(False)
    rows = kept.withColumn("status", F.when(low | F.lit(bool(limits)), "PARTIAL").otherwise("READY"))
    counts = own.agg(F.count("*").alias("event_count"), *[F.least(F.count(F.when((F.col("signal_type") == t) & F.lit(t in request.signal_types), 1)), F.lit(request.limit)).alias(t) for t in SIGNAL_TYPES])
    shown = F.col(SIGNAL_TYPES[0]) + F.col(SIGNAL_TYPES[1]) + F.col(SIGNAL_TYPES[2])
    state = F.when(shown > 0, F.lit("PARTIAL" if limits else "READY")).when(F.col("event_count") > 0, "NO_SURFACED_SIGNALS").otherwise("NO_CONFIRMED_EVENTS")
    nothing = F.when(shown > 0, F.lit(None)).when(F.col("event_count") > 0, "no_surfaced_signals_in_scope").otherwise("no_confirmed_events_in_scope")
    status = counts.select(state.alias("status"), "event_count", shown.cast("long").alias("surfaced_event_count"), F.concat_ws(",", F.lit(",".join(limits)) if limits else F.lit(None), nothing).alias("limitations"))
    excluded = own.where("signal_type is null").groupBy(F.coalesce("event_type", "event_family", F.lit("UNKNOWN")).alias("event_type")).agg(F.count("*").alias("n"))
    return Feed(rows, status, excluded)


def stored_events(build, make_facts: Callable[[], DataFrame], detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events of a build as stored by month. Where none are stored the rules run over the stored event facts, which are made first if need be.

    ``event_source`` tells which it was. Facts and events of a build are written once; filters on months and scope reach the partitions.
    """
    if build.has("events"):
        return build.read("events").withColumn("event_source", F.lit("CONFIRMED_EVENT_OUTPUT"))
    facts = build.dataset("event_facts", make_facts)
    return build.dataset("events", lambda: detect(facts)).withColumn("event_source", F.lit("EVENT_FACTS_RUNTIME_MATERIALIZATION"))
