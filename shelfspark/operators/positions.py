"""Category positions from stored facts: ranks, shares and portfolio classes of entities for several concepts in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import MONEY, ratio

#: Rank, share and class concepts: grain and basis, basis and whether it runs up.
RANKS = {
    "category_rank_revenue": ("category", "revenue"),
    "category_rank_units": ("category", "units"),
    "category_rank_margin_abs": ("category", "retailer_margin_abs"),
    "manufacturer_rank_revenue": ("manufacturer", "revenue"),
    "manufacturer_rank_units": ("manufacturer", "units"),
    "manufacturer_rank_margin_abs": ("manufacturer", "retailer_margin_abs"),
    "brand_rank_revenue": ("brand", "revenue"),
    "brand_rank_units": ("brand", "units"),
    "brand_rank_margin_abs": ("brand", "retailer_margin_abs"),
    "sku_rank_revenue": ("sku", "revenue"),
    "sku_rank_units": ("sku", "units"),
    "sku_rank_margin_abs": ("sku", "retailer_margin_abs"),
}
SHARES = {
    "entity_revenue_share": ("revenue", False),
    "entity_units_share": ("units", False),
    "entity_margin_share": ("retailer_margin_abs", False),
    "entity_cumulative_revenue_share": ("revenue", True),
    "entity_cumulative_units_share": ("units", True),
    "entity_cumulative_margin_share": ("retailer_margin_abs", True),
}
CLASSES = {
    "manufacturer_abc_revenue": ("manufacturer", "revenue"),
    "manufacturer_abc_units": ("manufacturer", "units"),
    "manufacturer_abc_margin_abs": ("manufacturer", "retailer_margin_abs"),
    "sku_abc_revenue": ("sku", "revenue"),
    "sku_abc_units": ("sku", "units"),
    "sku_abc_margin_abs": ("sku", "retailer_margin_abs"),
}
GRAINS = ("category", "manufacturer", "brand", "sku")
BASES = ("revenue", "units", "retailer_margin_abs")


def month_set(facts: DataFrame, months: tuple[str, ...]) -> DataFrame:
    """Facts of the given months; they reach the stored partitions."""
    return facts.where(F.col("period_start").isin(*[F.lit(m).cast("date") for m in months]))


def positions(facts: DataFrame) -> DataFrame:
    """``(concept_id, grain_id, universe, entity_id, value, rank, tie_count, population, share, cumulative_share, abc_class, limitation)`` of facts of one month or a set of months, which are added up.

    An entity's universe is its category, a category's are all categories. Ranks leave gaps behind ties, and ties run by
    entity id; shares and their running sums are NULL without a positive total. A class goes by the running share after the entity
    (0.8 and 0.95), the first is A and zero is C; a universe with a negative value, or without a positive total, has none.
    Entities with a month without a value are left out, as nothing is known of their sum.
    """
    rows = facts.where(F.col("grain_id").isin(*GRAINS) & F.col("metric_concept").isin(*BASES))
    universe = F.when(F.col("grain_id") == "category", "ALL").otherwise(F.get_json_object("parent_entity_ids", "$.category"))
    # brands and manufacturers of a name stand apart by their parents
    known = rows.groupBy("grain_id", universe.alias("universe"), "entity_id", "parent_entity_ids", F.col("metric_concept").alias("basis")).agg(F.sum(F.col("value").cast(MONEY)).alias("v"), F.count_if(F.col("value").isNull()).alias("missing")).where("missing = 0")
    key = ("grain_id", "universe", "basis")
    part, ties = Window.partitionBy(*key), Window.partitionBy(*key, "v")
    order = part.orderBy(F.desc("v"), "entity_id", "parent_entity_ids")
    total, running = F.sum("v").over(part), F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = known.select(
        *key, "entity_id", "parent_entity_ids", F.col("v").cast("double").alias("value"), F.rank().over(part.orderBy(F.desc("v"))).alias("rank"), F.count("*").over(ties).alias("tie_count"), F.count("*").over(part).alias("population"),
        F.row_number().over(order).alias("place"), (F.min("v").over(part) < 0).alias("negative"), (total > 0).alias("positive"), F.when(total > 0, ratio("v", total)).alias("share"), F.when(total > 0, ratio(running, total)).alias("cumulative_share"),
    )
    label = F.when(F.col("value") == 0, "C").when((F.col("place") == 1) | (F.col("cumulative_share") <= 0.8), "A").when(F.col("cumulative_share") <= 0.95, "B").otherwise("C")
    refused = F.when(F.col("negative"), "abc_negative_contribution_semantics_unsupported").when(~F.col("positive"), "abc_positive_universe_required")
    fits = lambda grain, basis: (F.col("basis") == basis) & (F.col("grain_id") == grain if grain else F.col("grain_id") != "category")
    nothing = {"rank": "int", "tie_count": "long", "population": "long", "share": "double", "cumulative_share": "double", "abc_class": "string", "limitation": "string"}

    def item(concept: str, when: Column, **held: Column) -> Column:
        cells = [(held[c] if c in held else F.lit(None)).cast(t).alias(c) for c, t in nothing.items()]
        return F.when(when, F.struct(F.lit(concept).alias("concept_id"), *cells))

    items = [item(k, fits(g, b), rank=F.col("rank"), tie_count=F.col("tie_count"), population=F.col("population")) for k, (g, b) in RANKS.items()]
    items += [item(k, fits(None, b), **{"cumulative_share" if up else "share": F.col("cumulative_share" if up else "share")}, population=F.col("population")) for k, (b, up) in SHARES.items()]
    items += [item(k, fits(g, b), abc_class=F.when(refused.isNull(), label), limitation=refused, population=F.col("population"), cumulative_share=F.when(refused.isNull(), F.col("cumulative_share"))) for k, (g, b) in CLASSES.items()]
    return placed.select("grain_id", "universe", "entity_id", "parent_entity_ids", "value", F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*", "grain_id", "universe", "entity_id", "parent_entity_ids", "value")
