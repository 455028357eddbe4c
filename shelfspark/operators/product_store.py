"""SKU x store facts of the concepts that can be recomputed, rolled up to any grain with their quality mix, metadata and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MONEY, ratio
from .mart import PERIOD_ONLY, RATIO, RECOMPUTE, SUM, WEIGHTED

#: The concepts that SKU x store facts can be rolled up for. Concept -> (strategy, value column, numerator, denominator) of a presence base.
CONCEPTS = {
    "revenue_vat": (SUM, "revenue_vat", None, None),
    "revenue": (SUM, "revenue_net", None, None),
    "units": (SUM, "units", None, None),
    "retailer_margin_abs": (SUM, "margin_abs", None, None),
    "retailer_margin_pct": (RATIO, None, "margin_abs", "revenue_net"),
    "weighted_shelf_price_vat": (WEIGHTED, None, "shelf_price_vat_value", "shelf_price_vat_weight"),
    "weighted_input_price_vat": (WEIGHTED, None, "input_price_vat_value", "input_price_vat_weight"),
}
#: Flags that facts may carry, each told by a condition on a row of the base; a fact with a blocking one is not valid.
FLAGS = {"missing_margin": "null_margins > 0", "returns": "return_rows > 0", "unknown_private_label": "private_label is null"}
BLOCKING = ("missing_margin",)
_SUMS = ("value", "numerator", "denominator")
#: What adds up in every roll-up: facts, NULLs of each part, sums, facts that are not valid, and facts with each flag.
COUNTERS = ("n_facts", *[f"null_{c}" for c in _SUMS], "n_invalid", *[f"flag_{f}" for f in FLAGS])


def product_store_facts(base: DataFrame, keep: tuple[str, ...], context: dict[str, Column]) -> DataFrame:
    """One row for each row of the base and concept, ready to be rolled up: sums, counters, metadata, and sets of revisions and runs.

    ``context`` gives columns source_revision_id and analysis_run_id.
    """
    number = lambda c: F.lit(None).cast(MONEY) if c is None else F.col(c).cast(MONEY)
    items = [
        F.struct(F.lit(k).alias("metric_concept"), F.lit(s).alias("strategy"), number(v).alias("value"), number(n).alias("numerator"), number(d).alias("denominator"))
        for k, (s, v, n, d) in CONCEPTS.items()
    ]
    flags = {f"flag_{f}": F.coalesce(F.expr(c), F.lit(False)).cast("long") for f, c in FLAGS.items()}
    invalid = F.greatest(*[flags[f"flag_{f}"] for f in BLOCKING], F.lit(0).cast("long"))
    rows = base.select("period", *keep, F.explode(F.array(*items)).alias("m"), *[c.alias(k) for k, c in flags.items()], invalid.alias("n_invalid"), *[F.array(c.cast("string")).alias(k) for k, c in context.items()])
    return rows.select(
        "period", *keep, "m.*", F.lit(1).cast("long").alias("n_facts"), *[F.col(f"m.{c}").isNull().cast("long").alias(f"null_{c}") for c in _SUMS], "n_invalid", *flags,
        F.struct("period", *[F.col(k)[0].alias(k) for k in context]).alias("latest"), *context,
    )


def rolled_up(rows: DataFrame, keys: tuple[str, ...], sets: tuple[str, ...] = ("source_revision_id", "analysis_run_id")) -> DataFrame:
    """Rows of product_store_facts at coarser keys; the result can be rolled up again and comes out the same by any way.

    Sums and counters add up, the latest row describes the result, and sets of revisions and runs are united. Sets are as
    large as the number of different revisions behind a result. Rows of equal sets are added up first, by numbers and dates
    only, which tasks keep in a table; structs and sets would have them sort all rows.
    """
    first, *others = [c for c in rows.schema["latest"].dataType.names]
    rows = rows.groupBy(*keys, "metric_concept", "strategy", *sets, *[F.col(f"latest.{c}").alias(f"latest_{c}") for c in others]).agg(*[F.sum(c).alias(c) for c in (*_SUMS, *COUNTERS)], F.max(f"latest.{first}").alias(f"latest_{first}"))
    rows = rows.withColumn("latest", F.struct(*[F.col(f"latest_{c}").alias(c) for c in (first, *others)])).drop(*[f"latest_{c}" for c in (first, *others)])
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return rows.groupBy(*keys, "metric_concept", "strategy").agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.sum(c).alias(c) for c in COUNTERS], F.max("latest").alias("latest"), *united)


def served(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rolled-up rows as they are served: value by strategy, quality status and flags, the count of facts with each flag, lineage.

    A single fact keeps its value; else a NULL among the parts gives NULL, and so does a zero denominator.
    """
    s, one = F.col("strategy"), F.col("n_facts") == 1
    whole = (F.col("null_numerator") == 0) & (F.col("null_denominator") == 0)
    by_parts = s.isin(RATIO, WEIGHTED, RECOMPUTE)
    value = F.when(s == SUM, F.when(F.col("null_value") == 0, F.col("value").cast("double"))).when(by_parts, F.when(whole | one, ratio("numerator", "denominator"))).when(s == PERIOD_ONLY, F.lit(None))
    part = lambda c: F.when(by_parts & (whole | one), F.col(c).cast("double"))
    held = [F.when(F.col(f"flag_{f}") > 0, F.concat(F.lit(f"{f}="), F.col(f"flag_{f}").cast("string"))) for f in sorted(FLAGS)]
    names = [F.when(F.col(f"flag_{f}") > 0, F.lit(f)) for f in sorted(FLAGS)]
    return rows.select(
        *keys, "metric_concept", value.alias("value"), part("numerator").alias("numerator_value"), part("denominator").alias("denominator_value"), "n_facts", *[f"null_{c}" for c in _SUMS],
        F.when(F.col("n_invalid") == 0, "valid").otherwise("mixed").alias("quality_status"), F.concat_ws(",", *names).alias("quality_flags"), F.concat_ws(",", *held).alias("flag_counts"),
        F.col("latest.period").alias("latest_period"), F.col("latest.source_revision_id").alias("latest_revision_id"), F.array_join("source_revision_id", ",").alias("source_revision_ids"), F.array_join("analysis_run_id", ",").alias("analysis_run_ids"),
    )
