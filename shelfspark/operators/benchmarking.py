"""Price segments, peer groups, ranks and relative prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, volume_range

SEGMENTS = ("ECONOMY", "MID", "PREMIUM")


def price_segments(prices: DataFrame, by: tuple[str, ...] = ("category",), least: int = 3) -> DataFrame:
    """Bucket by cheaper competitors, so ties stay together; NULL and non-positive prices and small groups get labels of their own."""
    good = F.col("price") > 0
    part = Window.partitionBy(*by, good)
    n = F.count("*").over(part)
    rank = F.rank().over(part.orderBy("price"))
    bucket = F.least(F.floor((rank - 1) * len(SEGMENTS) / n), F.lit(len(SEGMENTS) - 1)).cast("int")
    names = F.array(*map(F.lit, SEGMENTS))
    label = F.when(F.col("price").isNull(), "UNCLASSIFIED_PRICE_NULL").when(~good, "UNCLASSIFIED_PRICE_INVALID").when(n < least, "INSUFFICIENT_POPULATION").otherwise(F.get(names, bucket))
    return prices.select("*", label.alias("price_segment"), F.when(good, rank).alias("price_rank"))


def latest_priced_period(rows: DataFrame, keys: tuple[str, ...] = ("category",), price: str = "price") -> DataFrame:
    """The last period in which anything of a group has a positive price; groups without one have NULL."""
    return rows.groupBy(*keys).agg(F.max(F.when(F.col(price) > 0, F.col("period"))).alias("benchmark_period"))


def top_entities(products: DataFrame, metrics: tuple[str, ...], n: int) -> DataFrame:
    """Union over metrics of the n best SKUs of each category."""
    out = None
    for m in metrics:
        best = F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last(m), "sku"))
        own = products.select("category", "sku", best.alias("place")).where(F.col("place") <= n).select("category", "sku")
        out = own if out is None else out.union(own)
    return out.distinct()


def peers(products: DataFrame, pool: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(target, peer) pairs that share the dimensions; no target is its own peer and own products are no peers."""
    left = products.select(*on, F.col("sku").alias("target"))
    right = pool.where(~F.col("is_own")).select(*on, F.col("sku").alias("peer"))
    return left.join(right, list(on)).where("target <> peer").select("target", "peer").distinct()


def peer_counts(products: DataFrame, pool: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(target, n_peers): how many rows peers() has for each target; pairs are made only for SKUs that stand in several groups."""
    rivals = pool.where(~F.col("is_own") & F.col("sku").isNotNull()).select(*on, "sku").distinct()
    targets = products.where(F.col("sku").isNotNull()).select(*on, F.col("sku").alias("target")).distinct()
    many = targets.groupBy("target").agg(F.count("*").alias("n_groups")).where("n_groups > 1").select("target")
    groups = rivals.groupBy(*on).agg(F.count("*").alias("n"))
    itself = rivals.select(*on, F.col("sku").alias("target"), F.lit(1).alias("itself"))
    one = targets.join(many, "target", "left_anti").join(groups, list(on)).join(itself, [*on, "target"], "left")
    one = one.select("target", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("n_peers")).where("n_peers > 0")
    several = products.join(many.withColumnRenamed("target", "sku"), "sku", "left_semi")
    return one.unionByName(peers(several, pool, on).groupBy("target").agg(F.count("*").alias("n_peers")))


def benchmark_ranks(products: DataFrame, metric: str, ascending: bool | Column = False, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """Rank and mid-rank percentile of each SKU among the competitors of its group and itself, without making pairs.

    Among competitors the rank comes from a window; an own product ranks one behind the competitors that beat it.
    """
    v = F.col(metric)
    order = F.when(F.lit(ascending) if isinstance(ascending, bool) else ascending, v).otherwise(-v)
    part = Window.partitionBy(*by)
    rival = F.when(~F.col("is_own") & v.isNotNull(), 1).otherwise(0)
    before = part.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*by, metric)
    upto, ties, n = F.sum(rival).over(before), F.sum(rival).over(same), F.sum(rival).over(part)
    own = F.when(F.col("is_own"), 1).otherwise(0)
    rows = products.where(v.isNotNull()).select(*by, "sku", "is_own", v.alias("value"), (upto - ties + 1).alias("rank"), (ties + own).alias("ties"), (n + own).alias("population"))
    mid = F.col("rank") + (F.col("ties") - 1) / F.lit(2.0)
    return rows.withColumn("percentile", F.when(F.col("population") > 1, 1 - (mid - 1) / (F.col("population") - 1)))


#: The metrics that products are benchmarked by.
BENCHMARK_METRICS = ("revenue_net", "units", "units_per_selling_store", "retailer_margin_abs", "numeric_distribution", "weighted_shelf_price_vat")
#: The metrics whose best products make the TOP_N pool, how many of each, and what direct peers share.
RANKING_METRICS = ("revenue_net", "units", "units_per_selling_store")
TOP_N = 10
DIRECT = ("category", "carbonation", "volume_band", "price_segment", "package")


def pooled(products: DataFrame, ranking: tuple[str, ...] = RANKING_METRICS, n: int = TOP_N, direct: tuple[str, ...] = DIRECT) -> DataFrame:
    """Each product once for each scope: scope, scope_key, and whether it is in the pool that targets of this key are held against.

    BROAD: the competitors of the category. TOP_N: those among the best n of it by any ranking metric, ties to the smaller
    SKU. DIRECT: products that share all dimensions; one without any of them is in no group.
    """
    rival = ~F.coalesce("is_own", F.lit(False))
    best = [F.row_number().over(Window.partitionBy("category", rival & F.col(m).isNotNull()).orderBy(F.desc(m), "sku")) for m in ranking]
    top = reduce(lambda a, b: a | b, [rival & F.col(m).isNotNull() & (F.col(f"_place{k}") <= n) for k, m in enumerate(ranking)])
    rows = products.select("*", *[c.alias(f"_place{k}") for k, c in enumerate(best)])
    key = lambda dims: F.concat_ws("|", *[F.col(c).cast("string") for c in dims])
    scope = lambda name, dims, member: F.struct(F.lit(name).alias("scope"), key(dims).alias("scope_key"), member.alias("in_pool"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in direct])
    scopes = F.array_compact(F.array(scope("BROAD", ("category",), rival), scope("TOP_N", ("category",), top), F.when(whole, scope("DIRECT", direct, F.lit(True)))))
    return rows.select(*products.columns, F.explode(scopes).alias("s")).select("s.*", *products.columns)


def pool_ranks(rows: DataFrame, lower_first: Column) -> DataFrame:
    """Adds rank, percentile and population_size of ``value`` in the pool of (scope, scope_key, metric) and the row itself, without pairs.

    Better members are counted by a window; a row outside the pool stands one behind those that beat it. The population
    counts members without a value, ranks and percentiles do not; a row without value keeps its place with both NULL. Rows
    that are alone have no peers and are left out.
    """
    v, by = F.col("value"), ("scope", "scope_key", "metric")
    member = F.when(F.col("in_pool") & v.isNotNull(), 1).otherwise(0)
    part = Window.partitionBy(*by)
    upto = F.sum(member).over(part.orderBy(F.when(lower_first, v).otherwise(-v)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties, n, size = F.sum(member).over(Window.partitionBy(*by, "value")), F.sum(member).over(part), F.sum(F.col("in_pool").cast("int")).over(part)
    out = rows.withColumns({"_upto": upto, "_ties": ties, "_n": n, "_size": size}).where("_size > cast(in_pool as int)")
    extra = F.when(F.col("in_pool"), 0).otherwise(1)
    rank = F.when(v.isNotNull(), F.col("_upto") - F.col("_ties") + 1)
    n, ties = F.col("_n") + extra, F.col("_ties") + extra
    percentile = F.when(n > 1, 1 - (rank + (ties - 1) / F.lit(2.0) - 1) / (n - 1))
    return out.withColumns({"rank": rank, "percentile": percentile, "population_size": F.col("_size") + extra}).drop("_upto", "_ties", "_n", "_size")


def benchmark_features(products: DataFrame, metrics: tuple[str, ...] = BENCHMARK_METRICS) -> DataFrame:
    """``(scope, scope_key, sku, metric, value, rank, percentile, population_size)`` of every product for each metric in each scope; cheaper is better."""
    items = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    rows = pooled(products).select("scope", "scope_key", "in_pool", "sku", F.expr(f"stack({len(metrics)}, {items}) as (metric, value)"))
    ranked = pool_ranks(rows, F.col("metric") == "weighted_shelf_price_vat")
    return ranked.select("scope", "scope_key", "sku", "metric", "value", "rank", "percentile", "population_size")


def pool_prices(products: DataFrame) -> DataFrame:
    """Price of every product against the median of its peers' valid prices in each scope, the product itself left out.

    Leaving one price out moves the median among the middle three places only. Without peers' prices or without a price of
    its own a product has NULLs and the issues say so; population_size counts its peers.
    """
    rows = pooled(products).select("scope", "scope_key", "in_pool", "sku", "price")
    key = ("scope", "scope_key")
    part = Window.partitionBy(*key, F.col("in_pool") & F.coalesce(F.col("price") > 0, F.lit(False)))
    valid = F.col("in_pool") & F.coalesce(F.col("price") > 0, F.lit(False))
    size = F.sum(F.col("in_pool").cast("int")).over(Window.partitionBy(*key)) - F.col("in_pool").cast("int")
    rows = rows.withColumns({"i": F.when(valid, F.row_number().over(part.orderBy("price", "sku")) - 1), "population_size": size})
    counted = rows.withColumn("n", F.count("i").over(Window.partitionBy(*key)))
    half = F.floor(F.col("n") / 2)
    at = lambda k: F.max(F.when(F.col("i") == half + k, F.col("price"))).over(Window.partitionBy(*key))
    out = counted.withColumns({"a": at(-1), "b": at(0), "c": at(1)}).where("population_size > 0")
    odd = F.col("n") % 2 == 1
    whole = F.when(odd, F.col("b")).otherwise((F.col("a") + F.col("b")) / 2)
    low, high = F.when(F.col("i") > half - 1, F.col("a")).otherwise(F.col("b")), F.when(F.col("i") > half, F.col("b")).otherwise(F.col("c"))
    without = F.when(F.col("n") > 1, F.when(odd, (low + high) / 2).otherwise(low))
    median = F.when(F.col("price").isNotNull(), F.when(F.col("i").isNull(), whole).otherwise(without))
    out = out.withColumn("peer_median_price", median)
    usable = F.nullif("peer_median_price", F.lit(0.0))
    delta = F.when(usable.isNotNull(), F.col("price") - F.col("peer_median_price"))
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("peer_median_price").isNull(), "EMPTY_DIRECT_PEER_GROUP"), F.when(usable.isNull(), "ZERO_PEER_MEDIAN"))), ",")
    return out.select(
        *key, "sku", "price", "peer_median_price", delta.alias("price_vs_peer_median_abs"), (100 * F.col("price") / usable).alias("price_index_to_peer_median"), (F.col("price") / usable - 1).alias("price_delta_pct_to_peer_median"),
        "population_size", issues.alias("issues"),
    )


def relative_prices(products: DataFrame) -> DataFrame:
    """Price against the median of the category's competitors, the target itself left out.

    Leaving one price out moves the median among the middle prices only, so three places of the sorted competitors are
    enough and neither pairs nor lists are made.
    """
    rows = products.where("price > 0").select("category", "sku", "is_own", "price")
    rivals = rows.where(~F.col("is_own"))
    part = Window.partitionBy("category")
    placed = rivals.select("category", "sku", "price", (F.row_number().over(part.orderBy("price", "sku")) - 1).alias("i"), F.count("*").over(part).alias("n"))
    half = F.floor(F.col("n") / 2)
    at = lambda k: F.max(F.when(F.col("i") == half + k, F.col("price")))
    middle = placed.groupBy("category").agg(F.max("n").alias("n"), at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"))
    rows = rows.join(placed.select("category", "sku", "i"), ["category", "sku"], "left").join(middle, "category", "left")
    odd, half = F.col("n") % 2 == 1, F.floor(F.col("n") / 2)
    own = F.when(odd, F.col("b")).otherwise((F.col("a") + F.col("b")) / 2)
    low = F.when(F.col("i") > half - 1, F.col("a")).otherwise(F.col("b"))
    high = F.when(F.col("i") > half, F.col("b")).otherwise(F.col("c"))
    without = F.when(F.col("n") > 1, F.when(odd, (low + high) / 2).otherwise(low))
    rows = rows.withColumn("peer_median", F.when(F.col("i").isNull(), own).otherwise(without))
    delta = F.col("price") - F.col("peer_median")
    return rows.select("category", "sku", "price", "peer_median", delta.alias("price_delta"), (ratio("price", "peer_median") * 100).alias("price_index"), ratio(delta, "peer_median").alias("price_delta_pct"))


def product_table(df: DataFrame, period) -> DataFrame:
    """One row per SKU of a month with the measures and dimensions that peers are built on."""
    from .metrics import sums

    own = df.where(F.col("period") == F.lit(period).cast("date"))
    first = [F.first(c).alias(c) for c in ("is_own", "carbonation", "package", "volume_l")]
    rows = own.groupBy("category", "sku").agg(*first, *sums(own))
    return rows.withColumn("price", F.col("avg_shelf_price")).withColumn("volume_band", volume_range("volume_l"))
