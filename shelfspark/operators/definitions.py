"""Metric definitions as data: dependency order, one aggregation for each grain, long rows with their metadata."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MONEY, ratio
from .metrics import GRAINS

CONDITIONS = {"gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "eq": lambda c, v: c == v}


@dataclass(frozen=True)
class Definition:
    """One metric of one grain. ``condition`` is (column, gt | ge | eq, value); ``broadcast`` names the coarser keys of a count."""

    name: str
    concept: str
    aggregation: str  # sum, ratio_of_sums, weighted_average, distinct_count, derived_ratio
    grain: str
    column: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    weight: str | None = None
    condition: tuple[str, str, object] | None = None
    broadcast: tuple[str, ...] | None = None
    share_scope: str | None = None
    version: str = "v1"

    @property
    def definition_id(self) -> str:
        return f"{self.grain}.{self.concept}.{self.version}"

    @property
    def depends(self) -> tuple[str, ...]:
        return (self.numerator, self.denominator) if self.aggregation == "derived_ratio" else ()


def standard_definitions() -> tuple[Definition, ...]:
    """Core metrics of six grains, stores, distribution and velocity of four, assortment of stores."""
    out: list[Definition] = []
    sold = ("units", "gt", 0)
    for g in GRAINS:
        add = lambda concept, aggregation, **more: out.append(Definition(f"{g}_{concept}", concept, aggregation, g, **more))  # noqa: B023, E731
        for concept, column in (("revenue_vat", "revenue_vat"), ("revenue", "revenue_net"), ("units", "units"), ("retailer_margin_abs", "margin_abs")):
            add(concept, "sum", column=column)
        add("retailer_margin_pct", "ratio_of_sums", numerator="margin_abs", denominator="revenue_net")
        for concept, column in (("weighted_shelf_price_vat", "shelf_price_vat"), ("weighted_input_price_vat", "input_price_vat")):
            add(concept, "weighted_average", column=column, weight="units")
        if g in ("category", "manufacturer", "brand", "sku"):
            add("store_count", "distinct_count", column="store")
            add("selling_store_count", "distinct_count", column="store", condition=sold)
            add("active_store_count", "distinct_count", column="store", condition=sold, broadcast=())
            add("distribution", "derived_ratio", numerator=f"{g}_selling_store_count", denominator=f"{g}_active_store_count")
            for concept, base in (("units_per_selling_store", "units"), ("revenue_per_selling_store", "revenue"), ("margin_per_selling_store", "retailer_margin_abs")):
                add(concept, "derived_ratio", numerator=f"{g}_{base}", denominator=f"{g}_selling_store_count")
        if g == "store":
            for concept, column in (("assortment_sku_count", "sku"), ("assortment_brand_count", "brand"), ("assortment_category_count", "category")):
                add(concept, "distinct_count", column=column, condition=sold)
    return tuple(out)


def config_hash(definitions) -> str:
    return hashlib.sha256(json.dumps([asdict(d) for d in definitions], sort_keys=True, default=str).encode()).hexdigest()[:16]


def resolve(definitions) -> tuple[list[Definition], list[str]]:
    """Definitions in an order in which each stands behind what it depends on, and the names of those that cannot be resolved."""
    waiting, done, order = list(definitions), set(), []
    while ready := [d for d in waiting if set(d.depends) <= done]:
        order += ready
        done |= {d.name for d in ready}
        waiting = [d for d in waiting if d.name not in done]
    return order, [d.name for d in waiting]


#: What the rows of a presence base are told by: a month, a SKU with its attributes, a store with its place.
DIMENSIONS = ("period", "category", "manufacturer", "brand", "sku", "store")


def _name(condition: tuple[str, str, object] | None) -> str:
    """The flag of a condition; sales are what counts ask for most."""
    if condition is None:
        return "present"
    return "sold" if condition == ("units", "gt", 0) else "is_" + "_".join(str(x).replace(".", "_").replace("-", "m") for x in condition)


def _part(column: str, d: Definition, of: str = "") -> str:
    return column + of + ("" if d.condition is None else f"_{_name(d.condition)}")


def row_parts(definitions) -> dict[str, Column]:
    """What all metrics can be made of, by name, of one sales row: amounts add up and flags are joined by OR in every roll-up."""
    out: dict[str, Column] = {}
    for d in definitions:
        met = F.lit(True) if d.condition is None else F.coalesce(CONDITIONS[d.condition[1]](F.col(d.condition[0]), d.condition[2]), F.lit(False))
        amount = lambda c: F.when(met, c.cast(MONEY))  # noqa: B023, E731
        if d.aggregation == "sum":
            out[_part(d.column, d)] = amount(F.col(d.column))
        elif d.aggregation == "ratio_of_sums":
            out |= {_part(c, d): amount(F.col(c)) for c in (d.numerator, d.denominator)}
        elif d.aggregation == "weighted_average":
            used = (F.col(d.weight) > 0) & F.col(d.column).isNotNull()
            out[_part(d.column, d, "_value")] = amount(F.when(used, F.col(d.column) * F.col(d.weight)))
            out[_part(d.column, d, "_weight")] = amount(F.when(used, F.col(d.weight)))
        elif d.aggregation == "distinct_count":
            out[_name(d.condition)] = met
        elif d.aggregation != "derived_ratio":
            raise ValueError(f"no aggregation {d.aggregation}")
    return out


def _flags(definitions) -> list[str]:
    return list(dict.fromkeys(_name(d.condition) for d in definitions if d.aggregation == "distinct_count"))


def presence_rows(df: DataFrame, definitions, dimensions: tuple[str, ...] = DIMENSIONS, more: dict[str, Column] | None = None) -> DataFrame:
    """The parts of the definitions for each sales row: a base that every grain is rolled up from, made without moving rows."""
    return df.select(*dimensions, *[c.alias(k) for k, c in (row_parts(definitions) | (more or {})).items()])


def cells(rows: DataFrame, definitions, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Rows of a base with the same dimensions as one."""
    flags = _flags(definitions)
    return rows.groupBy(*dimensions).agg(*[(F.max(n) if n in flags else F.sum(n)).alias(n) for n in rows.columns if n not in dimensions])


def presence(df: DataFrame, definitions, dimensions: tuple[str, ...] = DIMENSIONS, more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each month, SKU and store with the parts of the definitions."""
    return cells(presence_rows(df, definitions, dimensions, more), definitions, dimensions)


def _counted(definitions) -> list[tuple[Definition, tuple[str, ...], str]]:
    """(definition, keys that it is counted by, flag) of the distinct counts."""
    return [(d, GRAINS[d.grain] if d.broadcast is None else d.broadcast, _name(d.condition)) for d in definitions if d.aggregation == "distinct_count"]


def rolled_up(base: DataFrame, order: list[Definition], near: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row for each month, grain and entity with the parts and counts of all grains side by side, from the base.

    Sums of grains above the SKU come from one GROUPING SETS pass, of which tasks keep an entity's row. For distinct values
    the base is dealt out by month and store: entities and values then meet within a task, so one narrow shuffle serves all
    counts of stores and no set of values is held. SKUs are dealt out by month and SKU, summed and counted in place, and are a
    branch of their own: a filter on the grain leaves the other branches out. ``near`` gives the base dealt out by "store" and
    "sku" with the column that deals it, where this is cheaper than dealing the base itself. Counts by coarser keys are joined back.
    """
    keys = tuple(k for k in DIMENSIONS if k != "period")
    grains, counted, flags = list(dict.fromkeys(d.grain for d in order)), _counted(order), _flags(order)
    sums = [n for n in row_parts(order) if n not in flags]
    slots = list(dict.fromkeys((by, d.column, f) for d, by, f in counted))
    label = lambda by: "+".join(by)
    texts = lambda by: [(F.col(k) if k in by else F.lit(None)).cast("string").alias(k) for k in keys]
    dealt = lambda k: (near or {}).get(k) or (base.repartition("period", k), k)
    seen = lambda c, f: (F.col(f) & F.col(c).isNotNull()).cast("int")

    def counts(by: tuple[str, ...], column: str) -> DataFrame:
        """Distinct values of a column by entity, a column for each slot."""
        own = {k: f for k, (b, c, f) in enumerate(slots) if (b, c) == (by, column)}
        rows, key = base, ()
        if by and "store" in (*by, column):
            rows, k = dealt("store")
            key = (k,)
            rows = rows.groupBy("period", *key, *keys).agg(*[F.max(f).alias(f) for f in flags])  # the same for all counts, so it is shuffled once
        values = rows.groupBy("period", *dict.fromkeys((*key, *by, column))).agg(*[F.max(f).alias(f) for f in own.values()])
        return values.groupBy("period", *by).agg(*[F.sum(seen(column, f)).cast("double").alias(f"count{k}") for k, f in own.items()])

    fine, coarse = [g for g in grains if "sku" in GRAINS[g]], [g for g in grains if "sku" not in GRAINS[g]]
    out = None
    if coarse:
        gid = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        named = None
        for g in coarse:
            named = (F if named is None else named).when(F.col("gid") == gid(GRAINS[g]), g)
        rows = base.groupingSets([("period", *[k for k in keys if k in GRAINS[g]]) for g in coarse], "period", *keys).agg(F.grouping_id().alias("gid"), *[F.sum(n).alias(n) for n in sums])
        rows = rows.select("period", named.alias("grain"), *[F.col(k).cast("string").alias(k) for k in keys], *sums)
        for g in coarse:
            for column in dict.fromkeys(c for b, c, _ in slots if b == GRAINS[g]):
                rows = rows.unionByName(counts(GRAINS[g], column).select("*", F.lit(g).alias("grain"), *[x for k, x in zip(keys, texts(GRAINS[g]), strict=True) if k not in GRAINS[g]]), allowMissingColumns=True)
        here = [f"count{k}" for k, (b, _, _) in enumerate(slots) if b in [GRAINS[g] for g in coarse] and f"count{k}" in rows.columns]
        out = rows.groupBy("period", "grain", *keys).agg(*[F.sum(n).alias(n) for n in sums], *[F.sum(n).alias(n) for n in here])
    for g in fine:
        by, own = GRAINS[g], [(k, c, f) for k, (b, c, f) in enumerate(slots) if b == GRAINS[g]]
        rows, key = dealt("sku")
        columns = [c for c in dict.fromkeys(c for _, c, _ in own) if c not in by]
        cells = rows.groupBy("period", *dict.fromkeys((key, *by, *columns))).agg(*[F.sum(n).alias(n) for n in sums], *[F.max(f).alias(f) for f in flags])
        held = [(F.sum(seen(c, f)) if len(columns) < 2 else F.size(F.collect_set(F.when(F.col(f), F.col(c))))).cast("double").alias(f"count{k}") for k, c, f in own]
        rows = cells.groupBy("period", *dict.fromkeys((key, *by))).agg(*[F.sum(n).alias(n) for n in sums], *held)
        rows = rows.select("period", F.lit(g).alias("grain"), *texts(by), *sums, *[f"count{k}" for k, _, _ in own])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    for by in dict.fromkeys(d.broadcast for d, _, _ in counted if d.broadcast is not None):
        for column in dict.fromkeys(c for b, c, _ in slots if b == by):
            side = counts(by, column)
            side = side.select("period", *by, *[F.col(c).alias(c.replace("count", "all")) for c in side.columns if c.startswith("count")])
            out = out.join(F.broadcast(side) if not by else side, ["period", *by], "left")  # without keys there is a row a month
    place = {slot: k for k, slot in enumerate(slots)}
    counted = {d.name: F.coalesce(F.col(f"{'count' if d.broadcast is None else 'all'}{place[by, d.column, f]}"), F.lit(0.0)) for d, by, f in counted}
    return out.select("period", "grain", *keys, *sums, *[c.alias(n) for n, c in counted.items()])


def _value(d: Definition) -> tuple[Column, Column | None, Column | None]:
    """Value, numerator and denominator of a metric from rolled-up parts."""
    total = lambda c: F.col(c).cast("double")
    if d.aggregation == "sum":
        return F.coalesce(total(_part(d.column, d)), F.lit(0.0)), None, None
    if d.aggregation == "distinct_count":
        return F.col(d.name), None, None
    if d.aggregation == "ratio_of_sums":
        n, m = total(_part(d.numerator, d)), total(_part(d.denominator, d))
    else:
        n, m = total(_part(d.column, d, "_value")), total(_part(d.column, d, "_weight"))
    return ratio(n, m), n, m


def calculate_base(base: DataFrame, definitions, near: dict[str, tuple[DataFrame, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Long metrics with metadata from a presence base, and MISSING_METRIC_DEPENDENCY issues. Grains that lack a key column have it NULL."""
    order, missing = resolve(definitions)
    return described(rolled_up(base, order, near), definitions), [f"MISSING_METRIC_DEPENDENCY:{name}" for name in missing]


def described(rows: DataFrame, definitions) -> DataFrame:
    """Long metrics with metadata from rolled-up rows."""
    order, _ = resolve(definitions)
    held: dict[str, tuple[Column, Column | None, Column | None]] = {}
    for d in order:
        if d.aggregation == "derived_ratio":
            n, m = held[d.numerator][0], held[d.denominator][0]
            held[d.name] = ratio(n, m), n, m
        else:
            held[d.name] = _value(d)
    names = ("concept", "metric_name", "metric_definition_id", "metric_definition_version", "aggregation", "share_scope", "numerator_metric_name", "denominator_metric_name")

    def item(d: Definition) -> Column:
        parents = (d.numerator, d.denominator) if d.aggregation in ("derived_ratio", "ratio_of_sums") else (None, None)
        texts = (d.concept, d.name, d.definition_id, d.version, d.aggregation, d.share_scope, *parents)
        numbers = [F.lit(None) if c is None else c for c in held[d.name]]
        return F.struct(*[F.lit(t).cast("string").alias(n) for n, t in zip(names, texts, strict=True)], *[c.cast("double").alias(n) for n, c in zip(("metric_value", "numerator_value", "denominator_value"), numbers, strict=True)])

    items, entity = None, None
    for grain in dict.fromkeys(d.grain for d in order):
        own, keys = F.array(*[item(d) for d in order if d.grain == grain]), GRAINS[grain]
        items = (F if items is None else items).when(F.col("grain") == grain, own)
        entity = (F if entity is None else entity).when(F.col("grain") == grain, F.col(keys[-1]) if keys else F.lit("ALL"))
    keys = [k for k in DIMENSIONS if k != "period"]
    rows = rows.select("period", *keys, F.col("grain").alias("entity_type"), entity.alias("entity_id"), F.lit(config_hash(definitions)).alias("metric_config_hash"), F.explode(items).alias("m"))
    return rows.select("period", *keys, "entity_type", "entity_id", "metric_config_hash", "m.*")


def calculate(df: DataFrame, definitions) -> tuple[DataFrame, list[str]]:
    """calculate_base over sales rows."""
    return calculate_base(presence(df, resolve(definitions)[0]), definitions)


#: The order of the grains that filters select.
FILTER_GRAINS = ("category", "manufacturer", "brand", "sku", "store")


def effective_grain(requested: str, filters: dict[str, tuple]) -> tuple[str, bool]:
    """The last selected filter in this order becomes the grain if it stands behind the requested one; whether SKU x store facts are needed.

    They are for package and volume filters, and where a product grain or filter meets a store filter or grain.
    """
    used = [g for g in FILTER_GRAINS if filters.get(g)]
    place = FILTER_GRAINS.index(requested) if requested in FILTER_GRAINS else -1
    grain = used[-1] if used and FILTER_GRAINS.index(used[-1]) > place else requested
    products = FILTER_GRAINS[:-1]
    filtered_product, filtered_store = any(g in products for g in used), "store" in used
    both = (filtered_store and (requested in products or filtered_product)) or (requested == "store" and filtered_product)
    return grain, bool(filters.get("package") or filters.get("volume")) or both


def filtered(df: DataFrame, filters: dict[str, tuple]) -> DataFrame:
    """OR within a filter, AND across filters."""
    for key, values in filters.items():
        if values:
            df = df.where(F.col(key).isin(*values))
    return df


def filtered_rollup(facts: DataFrame, filters: dict[str, tuple], requested: str = "network") -> DataFrame:
    """Additive measures of SKU x store facts under filters, at the grain that the filters and the request come to."""
    grain, _ = effective_grain(requested, filters)
    keys = GRAINS[grain]
    money = [F.sum(F.col(c).cast(MONEY)).cast("double").alias(c) for c in ("revenue_net", "units", "margin_abs")]
    rows = filtered(facts, filters).groupBy("period", *keys).agg(*money)
    return rows.select("period", F.lit(grain).alias("entity_type"), (F.col(keys[-1]) if keys else F.lit("ALL")).alias("entity_id"), "revenue_net", "units", "margin_abs")
