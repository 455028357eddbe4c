"""KPIs, geography, package and volume mix, diagnostics, facets, source-row pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_sum, ratio, volume_range
from .metrics import selling, sold


def units():
    return F.col("units").cast("decimal(18,2)")


def kpis(df: DataFrame, entity: str, by_period: bool = True) -> DataFrame:
    """Velocity, distribution and price per litre; without periods the stores are distinct over the whole range."""
    keys = ("period",) if by_period else ()
    litres = (units() * F.col("volume_l").cast("decimal(10,3)")).cast("decimal(24,8)")
    own = df.groupBy(*keys, entity).agg(
        exact_sum(units()).alias("units"), exact_sum("revenue_vat").alias("revenue_vat"),
        selling(df, "store").alias("selling_stores"),
        ratio(F.sum(F.when(F.col("volume_l") > 0, F.col("revenue_vat"))), F.sum(F.when(F.col("volume_l") > 0, litres))).alias("price_per_litre"),
    )
    market = df.groupBy(*keys).agg(selling(df, "store").alias("active_stores"))
    out = own.join(market, list(keys)) if keys else own.crossJoin(F.broadcast(market))  # one row
    return out.withColumn("velocity", ratio("units", "selling_stores")).withColumn("distribution", ratio("selling_stores", "active_stores"))


def weighted_distribution(df: DataFrame, entity: str) -> DataFrame:
    """Category revenue of the stores that sell the entity, over the category's revenue."""
    by_store = df.groupBy("period", "category", "store").agg(F.sum("revenue_vat").alias("r"))
    sells = df.where(sold(df)).select("period", "category", entity, "store").distinct()
    reach = sells.join(by_store, ["period", "category", "store"]).groupBy("period", "category", entity).agg(F.sum("r").alias("reached"))
    total = by_store.groupBy("period", "category").agg(F.sum("r").alias("total"))
    return reach.join(total, ["period", "category"]).select("period", "category", entity, ratio("reached", "total").alias("weighted_distribution"))


def format_distribution(df: DataFrame, entity: str) -> DataFrame:
    """Selling stores over all stores of each format; every entity of a month has a row for every format of it, zero without sales."""
    universe = df.groupBy("period", "store_format").agg(F.countDistinct("store").alias("format_stores"))
    own = df.groupBy("period", "store_format", entity).agg(selling(df, "store").alias("n"))
    entities = own.select("period", entity).distinct()
    grid = entities.join(universe, "period")  # formats of a month are a few
    out = grid.join(own, ["period", "store_format", entity], "left").withColumn("selling_stores", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return out.withColumn("numeric_distribution", ratio("selling_stores", "format_stores"))


def regional_summary(df: DataFrame) -> DataFrame:
    region = F.when(F.coalesce(F.trim("region"), F.lit("")) == "", "UNKNOWN_REGION").otherwise(F.col("region"))
    rows = df.groupBy("period", region.alias("region")).agg(F.sum("revenue_net").alias("r"), exact_sum(units()).alias("units"), F.countDistinct("store").alias("n_stores"))
    share = ratio("r", F.sum("r").over(Window.partitionBy("period")))
    return rows.select("period", "region", F.col("r").cast("double").alias("revenue_net"), "units", "n_stores", share.alias("share"))


def geography(df: DataFrame, dims: tuple[str, ...], current, reference) -> DataFrame:
    """Sums, margin and stores of a month by place, against a reference month (percent of its size)."""
    c, r = F.lit(current).cast("date"), F.lit(reference).cast("date")
    now, then = F.col("period") == c, F.col("period") == r
    rows = df.where(F.col("period").isin(c, r))
    for d in dims:
        rows = rows.where(F.trim(d) != "")
    out = rows.groupBy(*dims).agg(
        exact_sum(F.when(now, F.col("revenue_net"))).alias("revenue_net"), exact_sum(F.when(then, F.col("revenue_net"))).alias("reference_revenue"),
        exact_sum(F.when(now, units())).alias("units"), ratio(F.sum(F.when(now, F.col("margin_abs"))), F.sum(F.when(now, F.col("revenue_net")))).alias("margin_pct"),
        F.countDistinct(F.when(now, F.col("store"))).alias("n_stores"),
    )
    return out.withColumn("delta_pct", ratio(F.col("revenue_net") - F.col("reference_revenue"), F.abs("reference_revenue")))


def package_volume_mix(df: DataFrame, current, reference) -> DataFrame:
    """Sums and shares by package and volume range; only SKUs with one package and one volume count."""
    rows = df.where(F.col("period").isin(F.lit(current).cast("date"), F.lit(reference).cast("date")))
    one = rows.groupBy("sku").agg(F.countDistinct("package").alias("p"), F.countDistinct("volume_l").alias("v"), F.max("volume_l").alias("m")).where("p = 1 and v = 1").select("sku")
    rows = rows.join(one, "sku", "left_semi").withColumn("volume_range", volume_range("volume_l"))
    now, then = F.col("period") == F.lit(current).cast("date"), F.col("period") == F.lit(reference).cast("date")
    out = rows.groupBy("package", "volume_range").agg(F.sum(F.when(now, F.col("revenue_net"))).alias("c"), F.sum(F.when(then, F.col("revenue_net"))).alias("r"), F.countDistinct(F.when(now, F.col("sku"))).alias("n_skus"))
    everything = Window.partitionBy()  # packages by ranges: a few rows
    c, r = ratio("c", F.sum("c").over(everything)), ratio("r", F.sum("r").over(everything))
    return out.select("package", "volume_range", F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("revenue_net"), "n_skus", c.alias("share"), r.alias("reference_share"), ((c - r) * 100).alias("share_pp"))


def diagnostics(df: DataFrame, entity: str, current, reference) -> DataFrame:
    c, r = F.lit(current).cast("date"), F.lit(reference).cast("date")
    now, then = F.col("period") == c, F.col("period") == r
    out = df.where(F.col("period").isin(c, r)).groupBy(entity).agg(
        *[exact_sum(F.when(k, F.col(m))).alias(f"{n}_{m}") for n, k in (("current", now), ("reference", then)) for m in ("revenue_net", "margin_abs")],
        F.countDistinct(F.when(now & sold(df), F.col("sku"))).alias("current_skus"), F.countDistinct(F.when(then & sold(df), F.col("sku"))).alias("reference_skus"),
    )
    return out.withColumn("revenue_delta", F.col("current_revenue_net") - F.col("reference_revenue_net")).withColumn("margin_pct", ratio("current_margin_abs", "current_revenue_net")).withColumn("sku_delta", F.col("current_skus") - F.col("reference_skus"))


def entity_options(df: DataFrame, entity: str, parents: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*parents, entity).agg(F.countDistinct("period").alias("n_periods"), F.min(F.trim("sku_name")).alias("label"))


def volume_facet(df: DataFrame) -> DataFrame:
    return df.where("volume_l > 0").groupBy(volume_range("volume_l").alias("volume_range"), F.round("volume_l", 6).alias("volume")).agg(F.countDistinct("sku").alias("n_skus"))


def seek_page(df: DataFrame, order: tuple[str, ...], size: int, after: tuple | None = None) -> DataFrame:
    """The next page behind a row of a total order, which is given by its values; a page has at most 100 rows.

    Every task keeps its first rows behind the key only, so any page costs what the first one does. NULLs come first, as in
    an ascending order. The first conditions are on the leading columns, so a leading month reaches stored partitions.
    """
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            kind = dict(df.dtypes)[c]
            key = F.lit(v).cast(kind)
            behind = behind | (same & (F.col(c).isNotNull() if v is None else F.col(c) > key))
            same = same & F.col(c).eqNullSafe(key)
        first = dict(df.dtypes)[order[0]]
        df = df.where(F.coalesce(behind, F.lit(False)))
        df = df if after[0] is None else df.where(F.col(order[0]) >= F.lit(after[0]).cast(first))
    return df.orderBy(*order).limit(min(size, 100))


def browse(df: DataFrame, order: tuple[str, ...], size: int, after: tuple | None = None, first=None, last=None, filters: dict[str, tuple] | None = None) -> DataFrame:
    """A page of the source rows of a scope (window of months, lists of values) with the number of rows in the scope."""
    if first is not None:
        df = df.where(F.col("period") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col("period") <= F.lit(last).cast("date"))
    for name, values in (filters or {}).items():
        df = df.where(F.col(name).isin(*values)) if values else df
    total = df.agg(F.count("*").alias("total_count"))
    return seek_page(df, order, size, after).crossJoin(F.broadcast(total))  # one row


def source_page(df: DataFrame, order: tuple[str, ...], size: int, page: int) -> DataFrame:
    """One page of source rows in a total order; a page has at most 100 rows."""
    return df.orderBy(*order).offset(size * page).limit(min(size, 100))
