"""Period comparisons, coverage and matched month sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio

#: Concepts whose change is told in points; so are those that end in _share.
POINT_METRICS = ("distribution", "retailer_margin_pct")
#: Columns of wide tables that hold these concepts under names of their own.
POINT_COLUMNS = {"margin_pct": "retailer_margin_pct", "numeric_distribution": "distribution", "share": "category_share"}


def in_points(metric: str) -> bool:
    concept = POINT_COLUMNS.get(metric, metric)
    return concept in POINT_METRICS or concept.endswith("_share")


def comparison_quality(kind: str, months):
    """HIGH for a year or a month exactly, MEDIUM over a gap to the last available period, else LOW."""
    if kind in ("YOY", "MOM"):
        return F.when(months == (12 if kind == "YOY" else 1), "HIGH").otherwise("LOW")
    return F.when(months > 1, "MEDIUM").otherwise("LOW") if kind == "PREVIOUS_AVAILABLE" else F.lit("LOW")


def references(periods: DataFrame, kind: str, custom=None) -> DataFrame:
    """``(period, reference_period)`` of the periods that have one; periods are months in the data, one row each."""
    if kind == "YOY":
        wanted = periods.select("period", F.add_months("period", -12).alias("reference_period"))
    elif kind == "MOM":
        wanted = periods.select("period", F.add_months("period", -1).alias("reference_period"))
    elif kind == "CUSTOM":
        wanted = periods.select("period", F.lit(custom).cast("date").alias("reference_period"))
    else:  # PREVIOUS_AVAILABLE: the months are few, the latest earlier one is an aggregate over pairs of months
        earlier = periods.select(F.col("period").alias("earlier"))
        return periods.join(earlier, F.col("earlier") < F.col("period")).groupBy("period").agg(F.max("earlier").alias("reference_period"))
    there = periods.select(F.col("period").alias("reference_period"))
    return wanted.join(there, "reference_period", "left_semi")


def compare(values: DataFrame, keys: tuple[str, ...], metric: str, kind: str, custom=None) -> DataFrame:
    """Each row of a period that has a reference period against that period: deltas, quality and comparability.

    Keys match NULL to NULL. A row is dealt to its own period and to those that refer to it, and both sides meet in one
    grouping, so the values are not joined with themselves. Deltas in points are plain differences.
    """
    refs = references(values.select("period").distinct(), kind, custom)  # one row a month
    dealt = refs.groupBy("reference_period").agg(F.collect_list("period").alias("users"))
    rows = values.select("period", *keys, F.col(metric).cast("double").alias("v")).join(F.broadcast(dealt.withColumnRenamed("reference_period", "period")), "period", "left")
    own, past = F.array(F.struct(F.col("period").alias("p"), F.lit(0).alias("side"))), F.transform("users", lambda u: F.struct(u.alias("p"), F.lit(1).alias("side")))
    rows = rows.select(F.explode(F.concat(own, F.coalesce(past, F.array().cast("array<struct<p: date, side: int>>")))).alias("x"), *keys, "v")
    side = lambda k: F.max(F.when(F.col("x.side") == k, F.struct("v")))
    both = rows.groupBy(F.col("x.p").alias("period"), *keys).agg(side(0).alias("now"), side(1).alias("then")).where("now is not null")
    both = both.join(F.broadcast(refs), "period").select("period", *keys, "reference_period", F.col("now.v").alias("current_value"), F.col("then.v").alias("reference_value"))
    delta = F.col("current_value") - F.col("reference_value")
    months = (F.year("period") - F.year("reference_period")) * 12 + F.month("period") - F.month("reference_period")
    points = in_points(metric)
    return both.select(
        "period", *keys, "reference_period", "current_value", "reference_value", delta.alias("delta_abs"), ratio(delta, "reference_value").alias("delta_pct"),
        (delta if points else F.lit(None).cast("double")).alias("delta_pp"), F.col("reference_value").isNotNull().alias("comparable"), months.alias("month_gap"),
        (months == 1).alias("is_contiguous"), (F.month("period") == F.month("reference_period")).alias("same_calendar_month"), comparison_quality(kind, months).alias("comparison_quality"),
    )


def compare_metrics(wide: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], kind: str, custom=None) -> DataFrame:
    """Several metrics of a wide table compared in one grouping; each metric's name tells whether its delta is in points."""
    items = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = wide.select("period", *keys, F.expr(f"stack({len(metrics)}, {items}) as (metric, value)"))
    points = F.col("metric").isin(*[m for m in metrics if in_points(m)])
    return compare(long, (*keys, "metric"), "value", kind, custom).withColumn("delta_pp", F.when(points, F.col("delta_abs")))


def comparison_issues(compared: DataFrame, values: DataFrame, kind: str, custom=None) -> DataFrame:
    """Rows without base, rows with a zero base, and periods without a reference period, counted by period."""
    missing = compared.groupBy("period").agg(F.sum(F.col("reference_value").isNull().cast("int")).alias("MISSING_COMPARISON_BASE"), F.sum((F.col("reference_value") == 0).cast("int")).alias("ZERO_METRIC_DENOMINATOR"))
    rows = missing.select("period", F.expr("stack(2, 'MISSING_COMPARISON_BASE', MISSING_COMPARISON_BASE, 'ZERO_METRIC_DENOMINATOR', ZERO_METRIC_DENOMINATOR) as (issue_code, n_rows)")).where("n_rows > 0")
    alone = values.groupBy("period").agg(F.count("*").alias("n_rows")).join(F.broadcast(references(values.select("period").distinct(), kind, custom)), "period", "left_anti")
    return rows.unionByName(alone.select("period", F.lit("MISSING_COMPARISON_BASE").alias("issue_code"), "n_rows"))


def coverage(df: DataFrame, first: str, last: str) -> DataFrame:
    """Every month of a window with whether the data has it, and the window's coverage ratio."""
    spark = df.sparkSession
    wanted = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 month)) as period")
    have = df.select("period").distinct().withColumn("available", F.lit(True))
    grid = wanted.join(have, "period", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    total = grid.agg(F.count("*").alias("expected"), F.sum(F.col("available").cast("int")).cast("long").alias("present"))
    status = F.when(F.col("present") == F.col("expected"), "COMPLETE").when(F.col("present") == 0, "MISSING").otherwise("PARTIAL")
    return grid.crossJoin(total).select("period", "available", "expected", "present", ratio("present", "expected").alias("coverage_ratio"), status.alias("coverage_status"))  # one total row


def month_set_compare(values: DataFrame, keys: tuple[str, ...], metric: str, current: int, reference: int) -> DataFrame:
    """Two years over the months that both have; sums are compared."""
    months = values.select(F.year("period").alias("y"), F.month("period").alias("m")).where(F.col("y").isin(current, reference)).distinct()
    shared = months.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m")
    rows = values.where(F.year("period").isin(current, reference)).withColumn("m", F.month("period")).join(F.broadcast(shared), "m", "left_semi")  # at most twelve months
    exact = F.col(metric).cast("decimal(24,8)")
    side = lambda y: F.sum(F.when(F.year("period") == y, exact)).cast("double")
    out = rows.groupBy(*keys).agg(side(current).alias("current_value"), side(reference).alias("reference_value"), F.countDistinct("m").alias("n_months"))
    delta = F.col("current_value") - F.col("reference_value")
    return out.withColumn("delta_abs", delta).withColumn("delta_pct", ratio(delta, "reference_value"))
