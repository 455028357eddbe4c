"""Configured metrics by grain, shares, distribution and velocity, private-label scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_sum, ratio

#: Grain -> its columns; the last one is the entity.
GRAINS = {
    "network": (),
    "category": ("category",),
    "manufacturer": ("category", "manufacturer"),
    "brand": ("category", "manufacturer", "brand"),
    "sku": ("category", "manufacturer", "brand", "sku"),
    "store": ("store",),
}
SCOPE = ("retailer_id", "source_id", "analysis_run_id", "period")


def sold(df: DataFrame):
    """Whether a row stands for a sale: sales rows tell by their units, rows of a presence base by their flag."""
    return F.col("sold") if "sold" in df.columns else F.col("units") > 0


def priced(df: DataFrame):
    """(value, units) that average prices come from; a presence base holds both."""
    if "priced_value" in df.columns:
        return F.col("priced_value"), F.col("priced_units")
    price = (F.col("shelf_price_vat") * F.col("units")).cast("decimal(24,8)")
    return F.when(sold(df), price), F.when(sold(df), F.col("units").cast("decimal(18,2)"))


def base_parts() -> dict:
    """What a presence base holds beside the parts of the configured metrics, of one sales row; all of it adds up."""
    value, units = (F.when(F.col("units") > 0, c) for c in ((F.col("shelf_price_vat") * F.col("units")).cast("decimal(24,8)"), F.col("units").cast("decimal(18,2)")))
    return {"priced_value": value, "priced_units": units, "n_rows": F.lit(1).cast("long"), "null_margins": F.col("margin_abs").isNull().cast("long"), "return_rows": (F.col("units") < 0).cast("long")}


def sums(df: DataFrame, one: str | None = None):
    """The core sums; all metrics of a grain come from one aggregation. ``one`` names the dimension that a group has one of."""
    price, priced_units = priced(df)
    return [
        exact_sum("revenue_vat").alias("revenue_vat"),
        exact_sum("revenue_net").alias("revenue_net"),
        exact_sum(F.col("units").cast("decimal(18,2)")).alias("units"),
        exact_sum("margin_abs").alias("margin_abs"),
        ratio(F.sum("margin_abs"), F.sum("revenue_net")).alias("margin_pct"),
        ratio(F.sum(price), F.sum(priced_units)).alias("avg_shelf_price"),
        F.sum(price).cast("double").alias("priced_value"),
        F.sum(priced_units).cast("double").alias("priced_units"),
        selling(df, "store", one).alias("selling_stores"),
        selling(df, "sku", one).alias("selling_skus"),
    ]


def selling(df: DataFrame, dimension: str, one: str | None = None):
    """Distinct values with sales; in a group of one value no distinct count is needed."""
    if dimension == one:
        return F.coalesce(F.max(F.when(sold(df), 1)), F.lit(0)).cast("long")
    return F.countDistinct(F.when(sold(df), F.col(dimension)))


def grain_metrics(df: DataFrame, grain: str) -> DataFrame:
    keys = GRAINS[grain]
    entity = F.col(keys[-1]) if keys else F.lit("ALL")
    out = df.groupBy("period", *keys).agg(*sums(df, keys[-1] if keys else None))
    return out.withColumn("entity_type", F.lit(grain)).withColumn("entity_id", entity)


METRICS = ("revenue_vat", "revenue_net", "units", "margin_abs", "margin_pct", "avg_shelf_price", "selling_stores", "selling_skus")


def category_share(metrics: DataFrame, value: str = "revenue_net") -> DataFrame:
    """Share of each entity in its category and month; NULL on a zero total."""
    total = F.sum(F.col(value).cast("decimal(24,8)")).over(Window.partitionBy("period", "category"))
    return metrics.withColumn("share", ratio(value, total))


def distribution(df: DataFrame, grain: str) -> DataFrame:
    """Selling stores over the stores active in the month, and units and revenue per selling store."""
    own = grain_metrics(df, grain)
    active = df.groupBy("period").agg(selling(df, "store").alias("active_stores"))
    out = own.join(active, "period")
    return out.select(
        "period", *GRAINS[grain], "selling_stores", "active_stores",
        ratio("selling_stores", "active_stores").alias("numeric_distribution"),
        ratio("units", "selling_stores").alias("units_per_store"),
        ratio("revenue_net", "selling_stores").alias("revenue_per_store"),
    )


def private_label_scope(df: DataFrame, scope: str, keep_unknown: bool = False) -> DataFrame:
    """INCLUDE, EXCLUDE or ONLY private label. An unknown flag passes INCLUDE, and EXCLUDE only with keep_unknown."""
    flag = F.col("private_label")
    if scope == "INCLUDE":
        return df
    if scope == "ONLY":
        return df.where(flag)
    return df.where(~F.coalesce(flag, F.lit(False)) if keep_unknown else flag == F.lit(False))


def scoped_metrics(df: DataFrame, scopes=("INCLUDE", "EXCLUDE", "ONLY")) -> DataFrame:
    """Category metrics by scope; the active stores stay those of the whole market."""
    active = df.groupBy("period").agg(selling(df, "store").alias("active_stores"))
    flag = F.col("private_label")
    own = F.array_compact(F.array(*[x for x in (F.lit("INCLUDE") if "INCLUDE" in scopes else None, F.when(flag == F.lit(False), "EXCLUDE") if "EXCLUDE" in scopes else None, F.when(flag, "ONLY") if "ONLY" in scopes else None) if x is not None]))
    by = df.select("*", F.explode(own).alias("scope")).groupBy("period", "scope", "category").agg(
        exact_sum("revenue_net").alias("revenue_net"), exact_sum(F.col("units").cast("decimal(18,2)")).alias("units"),
        selling(df, "store").alias("selling_stores"),
    )
    return by.join(active, "period").withColumn("numeric_distribution", ratio("selling_stores", "active_stores"))


def market_universe(df: DataFrame, universe: str) -> DataFrame:
    conditions = {"TOTAL_MARKET": F.lit(True), "MARKET_EX_PRIVATE_LABEL": F.col("private_label") == F.lit(False), "PRIVATE_LABEL": F.col("private_label"), "OWN_PORTFOLIO": F.col("is_own")}
    return df.where(conditions[universe])
