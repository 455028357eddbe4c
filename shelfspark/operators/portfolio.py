"""ABC classes, ranks, shares, movements, contribution and market segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_sum, ratio


def abc_classes(skus: DataFrame, value: str, by: tuple[str, ...] = ("period", "category"), entity: str = "sku") -> DataFrame:
    """A for the first row and up to 80 % of the running share, B up to 95 %, else C; zero and negative values apart."""
    exact = F.col(value).cast("decimal(24,8)")
    positive = F.when(exact > 0, exact)
    whole = Window.partitionBy(*by)
    run = whole.orderBy(F.desc_nulls_last(positive), entity)
    total = F.sum(positive).over(whole)
    running = F.sum(positive).over(run.rowsBetween(Window.unboundedPreceding, 0))
    out = skus.select("*", ratio(positive, total).alias("abc_share"), F.when(positive.isNotNull(), ratio(running, total)).alias("cumulative_share"), F.row_number().over(run).alias("place"))
    label = (
        F.when(exact < 0, "NEGATIVE_OR_CORRECTION").when(F.coalesce(exact == 0, F.lit(True)), "UNCLASSIFIED")
        .when((F.col("place") == 1) | (F.col("cumulative_share") <= 0.8), "A").when(F.col("cumulative_share") <= 0.95, "B").otherwise("C")
    )
    return out.withColumn("abc_class", label).drop("place")


def abc_portfolio(values: DataFrame, value: str, by: tuple[str, ...], entity: str) -> DataFrame:
    """Portfolio classes: the first row A, zero always C, else by the running share after the row (0.8 and 0.95).

    A group that holds a negative value gets no classes; its rows say so.
    """
    exact = F.col(value).cast("decimal(24,8)")
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.desc(exact), entity)
    total, negative = F.sum(exact).over(whole), F.min(exact).over(whole) < 0
    rows = values.select("*", negative.alias("refused"), F.row_number().over(order).alias("place"), ratio(F.sum(exact).over(order.rowsBetween(Window.unboundedPreceding, 0)), total).alias("running"))
    label = F.when(exact == 0, "C").when((F.col("place") == 1) | (F.col("running") <= 0.8), "A").when(F.col("running") <= 0.95, "B").otherwise("C")
    kept = lambda c: F.when(~F.col("refused"), c)
    out = rows.withColumns({"cumulative_share": kept(F.col("running")), "abc_class": kept(label), "limitation": F.when(F.col("refused"), "abc_negative_values_not_applicable")})
    return out.drop("refused", "place", "running")


def ranks(values: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Competition rank, rows with the same value, and population."""
    whole = Window.partitionBy(*by)
    return values.select("*", F.rank().over(whole.orderBy(F.desc(value))).alias("rank"), F.count("*").over(Window.partitionBy(*by, value)).alias("tie_count"), F.count("*").over(whole).alias("population"))


def movement(values: DataFrame, keys: tuple[str, ...], value: str, current, reference) -> DataFrame:
    """Rank and share of two months side by side; entities of one side only are NEW or EXITED."""
    def side(p, name):
        own = ranks(values.where(F.col("period") == F.lit(p).cast("date")), value, keys[:-1])
        total = F.sum(F.col(value).cast("decimal(24,8)")).over(Window.partitionBy(*keys[:-1]))
        return own.select(*keys, F.col("rank").alias(f"{name}_rank"), ratio(value, total).alias(f"{name}_share"))

    both = side(current, "current").join(side(reference, "reference"), list(keys), "full_outer")
    move = F.col("reference_rank") - F.col("current_rank")
    state = F.when(F.col("reference_rank").isNull(), "NEW").when(F.col("current_rank").isNull(), "EXITED").when(move > 0, "IMPROVED").when(move < 0, "DECLINED").otherwise("UNCHANGED")
    return both.select("*", move.alias("rank_movement"), ((F.col("current_share") - F.col("reference_share")) * 100).alias("share_pp"), state.alias("movement_state"))


def cumulative_share(values: DataFrame, value: str, by: tuple[str, ...], entity: str) -> DataFrame:
    exact = F.col(value).cast("decimal(24,8)")
    whole = Window.partitionBy(*by)
    total = F.sum(exact).over(whole)
    running = F.sum(exact).over(whole.orderBy(F.desc(value), entity).rowsBetween(Window.unboundedPreceding, 0))
    return values.select("*", ratio(value, total).alias("share"), ratio(running, total).alias("cumulative_share"))


def two_periods(df: DataFrame, keys: tuple[str, ...], value: str, current, reference, condition=None) -> DataFrame:
    """Exact sums of two months in one pass."""
    c, r = F.lit(current).cast("date"), F.lit(reference).cast("date")
    x = F.col(value) if condition is None else F.when(condition, F.col(value))
    return df.where(F.col("period").isin(c, r)).groupBy(*keys).agg(exact_sum(F.when(F.col("period") == c, x)).alias("current_value"), exact_sum(F.when(F.col("period") == r, x)).alias("reference_value"))


#: The pairs whose parts add up, and the concepts that do.
PARENT_CHILD = (("network", "category"), ("category", "manufacturer"), ("category", "brand"), ("category", "sku"))
ADDITIVE = ("revenue_vat", "revenue", "units", "retailer_margin_abs")
#: Columns of sales rows that hold concepts under names of their own.
CONCEPT_COLUMNS = {"revenue": "revenue_net", "retailer_margin_abs": "margin_abs"}
TOLERANCE = 1e-6


def contribution(df: DataFrame, parent: str, child: str, value: str, current, reference, limit: int = 200) -> DataFrame:
    """Share of each child's delta in its parent's for an additive concept, largest deltas first; the parent is summed apart and must reconcile."""
    if (parent, child) not in PARENT_CHILD or value not in ADDITIVE:
        raise ValueError("NOT_APPLICABLE_PARENT_CHILD_SCOPE")
    value = CONCEPT_COLUMNS.get(value, value)
    up = () if parent == "network" else (parent,)
    rows = two_periods(df, (*up, child), value, current, reference)
    whole = two_periods(df, up, value, current, reference).select(*up, F.col("current_value").alias("parent_current"), F.col("reference_value").alias("parent_reference"))
    exact = lambda a, b: (F.col(a) - F.col(b)).cast("decimal(24,6)")
    rows = rows.withColumn("delta_abs", exact("current_value", "reference_value").cast("double"))
    rows = rows.join(whole, list(up)) if up else rows.crossJoin(F.broadcast(whole))  # one row
    rows = rows.withColumn("parent_delta", exact("parent_current", "parent_reference").cast("double")).withColumn("contribution", ratio("delta_abs", "parent_delta"))
    part = Window.partitionBy(*up)
    rows = rows.withColumn("delta", F.col("current_value") - F.col("reference_value"))
    off = lambda c, total: F.abs(F.sum(F.col(c).cast("decimal(24,8)")).over(part).cast("double") - F.col(total)) > TOLERANCE * F.greatest(F.lit(1.0), F.abs(F.col(total)) / 1e6)
    flags = F.array_compact(F.array(F.when(off("current_value", "parent_current"), "RECONCILIATION_CURRENT_WARNING"), F.when(off("reference_value", "parent_reference"), "RECONCILIATION_REFERENCE_WARNING"), F.when(off("delta", "parent_delta"), "RECONCILIATION_DELTA_WARNING")))
    rows = rows.withColumn("flags", F.array_join(flags, ",")).withColumn("state", F.when(F.col("parent_delta") == 0, "TOTAL_DELTA_ZERO").otherwise("READY"))
    return rows.drop("parent_current", "parent_reference", "delta").orderBy(F.desc(F.abs("delta_abs")), F.desc("current_value"), *up, child).limit(limit)


UNIVERSES = ("TOTAL_MARKET", "MARKET_EX_PRIVATE_LABEL", "PRIVATE_LABEL", "OWN_PORTFOLIO")


def segment_deltas(df: DataFrame, value: str, current, reference) -> DataFrame:
    """Current and reference of each market universe by category."""
    flag = F.col("private_label")
    own = F.array_compact(F.array(F.lit("TOTAL_MARKET"), F.when(flag == F.lit(False), "MARKET_EX_PRIVATE_LABEL"), F.when(flag, "PRIVATE_LABEL"), F.when(F.col("is_own"), "OWN_PORTFOLIO")))
    rows = two_periods(df.select("*", F.explode(own).alias("universe")), ("category", "universe"), value, current, reference)
    delta = F.col("current_value") - F.col("reference_value")
    state = F.when(F.col("reference_value") == 0, "ZERO_REFERENCE_DENOMINATOR").otherwise("READY")
    return rows.select("*", delta.alias("delta_abs"), ratio(delta, "reference_value").alias("delta_pct"), state.alias("state"))


def segment_patterns(deltas: DataFrame) -> DataFrame:
    """Per category: how much faster private label declines than the market, and whether it grows while the own portfolio falls."""
    pct = lambda u: F.max(F.when(F.col("universe") == u, F.col("delta_pct")))
    rows = deltas.groupBy("category").agg(pct("TOTAL_MARKET").alias("market_pct"), pct("PRIVATE_LABEL").alias("private_label_pct"), pct("OWN_PORTFOLIO").alias("own_pct"))
    both = (F.col("own_pct") < 0) & (F.col("market_pct") < 0)
    return rows.select("*", F.when(both, ratio("own_pct", "market_pct")).alias("decline_speed"), F.coalesce((F.col("private_label_pct") > 0) & (F.col("own_pct") < 0), F.lit(False)).alias("private_label_gains"))


def active_sku_peak(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Active SKUs by month, the peak month (earliest on ties) and the change from it; months without sales count zero."""
    periods, entities = df.select("period").distinct(), df.select(*by).distinct()
    grid = entities.crossJoin(F.broadcast(periods))  # months are few
    counts = df.groupBy(*by, "period").agg(F.countDistinct(F.when(F.col("units") > 0, F.col("sku"))).alias("n"))
    rows = grid.join(counts, [*by, "period"], "left").withColumn("active_skus", F.coalesce("n", F.lit(0))).drop("n")
    peak = Window.partitionBy(*by)
    best = F.max("active_skus").over(peak)
    rows = rows.withColumn("peak_skus", best)
    return rows.withColumn("peak_period", F.min(F.when(F.col("active_skus") == F.col("peak_skus"), F.col("period"))).over(peak)).withColumn("change_from_peak", F.col("active_skus") - F.col("peak_skus"))
