"""Checks and records around the tables: scopes, rule applicability, issue rows, gates, revisions, builds, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKING = ("FATAL", "ERROR")
ISSUE = "issue_code string, severity string, subject string"


def in_context(df: DataFrame, retailer_id: str, source_id: str, analysis_run_id: str) -> DataFrame:
    """Rows of one retailer, source and run; nothing of another one mixes in."""
    return df.where((F.col("retailer_id") == retailer_id) & (F.col("source_id") == source_id) & (F.col("analysis_run_id") == analysis_run_id))


def applicable(rules: DataFrame, retailer_id: str, source_id: str, rule_version: str) -> DataFrame:
    """Enabled rules of the retailer and version, for this source or for any."""
    return rules.where(F.coalesce("enabled", F.lit(True)) & (F.col("retailer_id") == retailer_id) & (F.col("rule_version") == rule_version) & (F.col("source_id").isNull() | (F.col("source_id") == source_id)))


def mapping_issues(spark, columns: list[str], mapping: dict[str, str], required: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """Issues of a column mapping: unknown sources and targets, missing required targets, targets that stand more than once."""
    targets = list(mapping.values())
    rows = [("UNKNOWN_SOURCE_COLUMN", "FATAL", s) for s in mapping if s not in columns] + [("UNKNOWN_TARGET_COLUMN", "FATAL", t) for t in dict.fromkeys(targets) if t not in allowed]
    rows += [("MISSING_REQUIRED_TARGET", "FATAL", r) for r in required if r not in targets] + [("DUPLICATE_TARGET", "FATAL", t) for t in dict.fromkeys(targets) if targets.count(t) > 1]
    return spark.createDataFrame(rows, ISSUE)


def require(issues: DataFrame, severities: tuple[str, ...] = ("FATAL",)) -> None:
    """Raise when an issue of these severities is there; one row is fetched."""
    if found := issues.where(F.upper("severity").isin(*severities)).limit(1).collect():
        raise ValueError(f"{found[0]['issue_code']}: {found[0]['subject']}")


def gated(events: DataFrame, issues: DataFrame) -> DataFrame:
    """No events while an upstream issue blocks."""
    blocked = issues.where(F.upper("severity").isin(*BLOCKING)).agg((F.count("*") > 0).alias("blocked"))
    return events.crossJoin(F.broadcast(blocked)).where("not blocked").drop("blocked")  # one row


def sign_issues(df: DataFrame, row: str = "source_row_number") -> DataFrame:
    """An issue for each row whose units and revenue are not both sales."""
    u, r = F.col("units"), F.col("revenue_vat")
    code = F.when((u < 0) & (r < 0), "BUSINESS_EXCEPTION").when((u >= 0) & (r >= 0), F.lit(None)).otherwise("SUSPICIOUS")
    return df.select(code.alias("issue_code"), F.when(code == "SUSPICIOUS", "WARNING").otherwise("INFO").alias("severity"), F.col(row).alias("source_row_number")).where("issue_code is not null")


def price_issues(df: DataFrame, fields: tuple[str, ...] = ("shelf_price_vat", "input_price_vat"), row: str = "source_row_number") -> DataFrame:
    """An issue for each row without an optional price; one for the table where the column is absent."""
    spark, there = df.sparkSession, [f for f in fields if f in df.columns]
    absent = spark.createDataFrame([("MISSING_OPTIONAL_PRICE", f, None) for f in fields if f not in there], "issue_code string, field string, source_row_number long")
    named = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in there])) if there else F.array().cast("array<string>")
    rows = df.select(F.lit("MISSING_OPTIONAL_PRICE").alias("issue_code"), F.explode(named).alias("field"), F.col(row).cast("long").alias("source_row_number"))
    return rows.unionByName(absent)


def quality_summary(df: DataFrame, status: Column, flags: list[tuple[str, Column]]) -> DataFrame:
    """Rows by status and the flags they carry."""
    held = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flags])), ",")
    return df.groupBy(status.alias("quality_status"), held.alias("quality_flags")).agg(F.count("*").alias("n_rows"))


def within_tolerance(source: DataFrame, made: DataFrame, measures: tuple[str, ...], tolerance: float) -> DataFrame:
    """One row for each measure: both totals and whether they agree within the tolerance, and the row counts."""
    total = lambda df, name: df.agg(F.count("*").cast("double").alias("rows"), *[F.sum(F.col(m).cast("decimal(24,8)")).cast("double").alias(m) for m in measures])  # noqa: E731, ARG005
    names = ("rows", *measures)
    side = lambda df, name: total(df, name).select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + f") as (measure, {name})"))
    both = side(source, "source_total").join(side(made, "made_total"), "measure")  # a row a measure
    return both.withColumn("reconciled", F.abs(F.col("source_total") - F.col("made_total")) <= tolerance)


def sequence_issues(df: DataFrame, row: str = "source_row_number") -> DataFrame:
    """Whether row numbers run from one to the number of rows, each once."""
    counts = df.agg(F.count("*").alias("n_rows"), F.min(row).alias("first"), F.max(row).alias("last"), F.countDistinct(row).alias("n_numbers"))
    good = (F.col("first") == 1) & (F.col("last") == F.col("n_rows")) & (F.col("n_numbers") == F.col("n_rows"))
    return counts.withColumn("in_sequence", F.coalesce(good, F.col("n_rows") == 0))


def product_filter(facts: DataFrame, products: DataFrame, filters: dict[str, tuple]) -> DataFrame:
    """Facts of the SKUs that product filters select; the SKUs stay a table."""
    from .definitions import filtered

    return facts.join(filtered(products, filters).select("sku").distinct(), "sku", "left_semi")


def digest(*columns: str) -> Column:
    """Sixteen hexadecimal digits over the named values in order, NULL as an empty text."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def with_ids(revisions: DataFrame) -> DataFrame:
    """Artifact ids stand for the bytes of a source, revision ids for these bytes in a version."""
    return revisions.withColumns({
        "source_artifact_id": F.concat(F.lit("source_artifact_"), digest("retailer_id", "source_id", "content_hash")),
        "source_revision_id": F.concat(F.lit("source_revision_"), digest("retailer_id", "source_id", "content_hash", "revision")),
    })


def active_revisions(activated: DataFrame) -> DataFrame:
    """Revisions that are active for any period, with these periods."""
    rows = activated.where("is_active").groupBy("retailer_id", "source_id", "revision")
    return rows.agg(F.array_sort(F.collect_set("period")).alias("periods"))


def resolve_build(builds: DataFrame, explicit: str | None = None) -> DataFrame:
    """(retailer_id, mart_build_id, state): the explicit build, else the only approved one, else the only one; NULL if none or many."""
    rows = builds if explicit is None else builds.where(F.col("mart_build_id") == explicit)
    only = lambda c: F.when(F.countDistinct(F.when(c, F.col("mart_build_id"))) == 1, F.max(F.when(c, F.col("mart_build_id"))))
    found = F.coalesce(only(F.col("status") == "APPROVED"), only(F.lit(True)))
    out = rows.groupBy("retailer_id").agg(found.alias("mart_build_id"), F.countDistinct("mart_build_id").alias("n_builds"))
    return out.withColumn("state", F.when(F.col("mart_build_id").isNotNull(), "RESOLVED").otherwise("AMBIGUOUS_BUILD"))


def revision_conflicts(facts: DataFrame) -> DataFrame:
    """Periods whose facts come from two revisions."""
    return facts.groupBy("retailer_id", "source_id", "period").agg(F.countDistinct("revision").alias("n_revisions")).where("n_revisions > 1")


def inactive_facts(facts: DataFrame, activated: DataFrame) -> DataFrame:
    """Fact groups whose revision is not the active one of their period."""
    active = activated.where("is_active").select("retailer_id", "source_id", "period", F.col("revision").alias("expected"))
    rows = facts.select("retailer_id", "source_id", "period", "revision").distinct().join(active, ["retailer_id", "source_id", "period"], "left")
    return rows.where(~F.col("revision").eqNullSafe(F.col("expected")))


def build_coverage(builds: DataFrame, activated: DataFrame) -> DataFrame:
    """Active periods by source, and how many of them a build holds."""
    active = activated.where("is_active").select("retailer_id", "source_id", "period").distinct()
    held = builds.select("retailer_id", "source_id", "period").distinct().withColumn("there", F.lit(1))
    rows = active.join(held, ["retailer_id", "source_id", "period"], "left").groupBy("retailer_id", "source_id")
    return rows.agg(F.count("*").alias("n_active"), F.count("there").alias("n_held"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def selected_periods(df: DataFrame, mode: str, first=None, last=None, years: tuple[int, ...] = ()) -> DataFrame:
    """SINGLE_PERIOD, DATE_RANGE, AVAILABLE_MONTH_SET (months that all years have) or FULL_AVAILABLE_HISTORY."""
    p = F.col("period")
    if mode == "SINGLE_PERIOD":
        return df.where(p == F.lit(first).cast("date"))
    if mode == "DATE_RANGE":
        return df.where(p.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if mode == "AVAILABLE_MONTH_SET":
        rows = df.where(F.year(p).isin(*years))
        sets = [rows.where(F.year(p) == y).select(F.month(p).alias("m")).distinct() for y in years]
        return rows.join(F.broadcast(reduce(DataFrame.intersect, sets)), F.month(p) == F.col("m"), "left_semi")  # at most twelve months
    return df


def canonical_write(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Canonical rows with their types and order; missing optional columns are stored as NULL."""
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]).write.mode("overwrite").parquet(path)


def write_governed(df: DataFrame, path: str, partitions: tuple[str, ...]) -> None:
    """Store universe, ledger and build records: the partitions in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
