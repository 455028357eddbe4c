"""Ingestion: mapping, typing, periods, aliases, profile and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONTHS = {n: k for k, n in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), 1)}  # fixed values


def map_columns(raw: DataFrame, mapping: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Rename source columns to targets; unknown sources, double targets and missing required targets are errors."""
    targets = list(mapping.values())
    if len(set(targets)) < len(targets) or set(mapping) - set(raw.columns) or set(required) - set(targets):
        raise ValueError("mapping does not fit the source")
    return raw.select(*[F.col(s).alias(t) for s, t in mapping.items()])


def normalise_period(df: DataFrame, year: str, month: str, out: str = "period") -> DataFrame:
    """Month start from year and month (number, digits or English name); NULL and an issue where they make none."""
    y = F.expr(f"try_cast({year} as int)")
    named = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    m = F.coalesce(F.expr(f"try_cast({month} as int)"), F.try_element_at(named, F.lower(F.trim(F.col(month).cast("string")))))
    good = F.coalesce(y.between(1, 9999) & m.between(1, 12), F.lit(False))
    issue = F.when(y.isNull() | ~y.between(1, 9999), "invalid_year").when(~good, "invalid_month")
    return df.withColumn(out, F.when(good, F.make_date(y, m, F.lit(1)))).withColumn("period_issue", issue)


def numeric_issue(text: str):
    """NULL for a number; ``missing`` for NULL or blank text, ``invalid_number`` otherwise."""
    c = F.col(text)
    return F.when(c.isNull() | (F.trim(c) == ""), "missing").when(F.expr(f"try_cast({text} as double)").isNull(), "invalid_number")


def map_values(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Known values are mapped, NULL stays, unknown ones become NULL with an issue."""
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column))
    return df.withColumn("value_issue", F.when(F.col(column).isNotNull() & mapped.isNull(), "unknown_value")).withColumn(column, mapped)


def canonical_stores(df: DataFrame, aliases: DataFrame, store: str = "store") -> DataFrame:
    """Adds canonical_store: the alias's target, else the store itself. Aliases ``(source_store, canonical_store)`` are few and checked."""
    if aliases.groupBy("source_store").agg(F.countDistinct("canonical_store").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a source store has two canonical stores")
    right = aliases.distinct().withColumnRenamed("source_store", store)
    return df.join(right, store, "left").withColumn("canonical_store", F.coalesce("canonical_store", store))


def source_profile(df: DataFrame) -> DataFrame:
    """One row: rows, periods, stores, SKUs and NULL counts."""
    nulls = [F.sum(F.col(c).isNull().cast("int")).cast("long").alias(f"null_{c}") for c in ("volume_l", "private_label", "input_price_vat")]
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("period").alias("n_periods"), F.countDistinct("store").alias("n_stores"), F.countDistinct("sku").alias("n_skus"), *nulls)


def duplicate_grain(df: DataFrame, grain: tuple[str, ...] = ("period", "retailer_id", "store", "sku")) -> DataFrame:
    return df.groupBy(*grain).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def numbered(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds source_row_number from one up in the order of ``by`` and then of all columns, the same on every run.

    Groups are counted first and rows are numbered within their group. A group starts behind the groups before it of the same
    first key and behind all earlier first keys, so no task holds more than a group or the groups of one first key.
    """
    first, rest = by[0], by[1:]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    parts = counted.groupBy(first).agg(F.sum("n").alias("n")).select(first, before(Window.orderBy(first)).alias("_base"))  # a row a first key
    starts = counted.select(*by, before(Window.partitionBy(first).orderBy(*rest)).alias("_start")) if rest else counted.select(*by, F.lit(0).alias("_start"))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    starts = starts.join(F.broadcast(parts), same(starts, parts, (first,)), "left").select(*[starts[k] for k in by], (F.col("_base") + F.col("_start")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*by).orderBy(*[c for c in df.columns if c not in by]))
    numbered_ = df.withColumn("_within", within)
    joined = numbered_.join(starts, same(numbered_, starts, by)).select(*[numbered_[c] for c in numbered_.columns], "_offset")
    return joined.withColumn("source_row_number", F.col("_offset") + F.col("_within")).drop("_within", "_offset")


def _issue(code, field: str):
    return F.struct(code.alias("issue_code") if not isinstance(code, str) else F.lit(code).alias("issue_code"), F.lit(field).alias("field"))


def typed(df: DataFrame, strings=(), integers=(), numbers=(), booleans=(), required: tuple[str, ...] = (), row: str = "source_row_number") -> tuple[DataFrame, DataFrame]:
    """Fields with their types, and the issues ``(issue_code, field, source_row_number)`` of values that did not fit; fields that are not there are skipped.

    Blank required strings keep their text; integers are always required; blank or wrong numbers become NULL. Both tables
    come from the rows as they are, without a shuffle.
    """
    there = lambda names: [c for c in names if c in df.columns]
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    as_type = lambda c, t: F.expr(f"try_cast(trim(cast(`{c}` as string)) as {t})")
    issues = [F.when(blank(c), _issue("blank_required_string", c)) for c in there(strings) if c in required]
    issues += [F.when(blank(c), _issue("null_integer_value", c)).when(as_type(c, "bigint").isNull(), _issue("invalid_integer_value", c)) for c in there(integers)]
    for c in there(numbers):
        wrong = _issue("invalid_numeric_value", c)
        issues.append(F.when(blank(c), _issue("null_numeric_value", c) if c in required else F.lit(None)).when(as_type(c, "double").isNull(), wrong))
    made = {c: F.col(c).cast("string") for c in there(strings)} | {c: as_type(c, "bigint") for c in there(integers)} | {c: as_type(c, "double") for c in there(numbers)} | {c: as_type(c, "boolean") for c in there(booleans)}
    listed = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<struct<issue_code:string,field:string>>")
    return df.withColumns(made), df.select(F.explode(listed).alias("i"), F.col(row).cast("long").alias("source_row_number")).select("i.*", "source_row_number")


def value_issues(df: DataFrame, column: str, values: dict[str, str], row: str = "source_row_number") -> DataFrame:
    """``(issue_code, field, source_value, source_row_number)`` of values that a mapping does not know; NULL is no value."""
    c = F.col(column)
    return df.where(c.isNotNull() & ~c.isin(*values)).select(F.lit("unknown_value").alias("issue_code"), F.lit(column).alias("field"), c.cast("string").alias("source_value"), F.col(row).cast("long").alias("source_row_number"))


def mapping_issue_rows(spark, columns: list[str], mapping: dict[str, str], required: tuple[str, ...], allowed: tuple[str, ...], unmapped: tuple[str, ...] = ()) -> DataFrame:
    """``(issue_code, severity, subject)`` of a column mapping, source columns that nothing maps and nobody lists included."""
    targets = list(mapping.values())
    rows = [("unknown_source_column", "ERROR", c) for c in mapping if c not in columns] + [("unknown_canonical_target", "ERROR", t) for t in dict.fromkeys(targets) if t not in allowed]
    rows += [("missing_required_mapping", "ERROR", t) for t in required if t not in targets] + [("duplicate_target_mapping", "ERROR", t) for t in dict.fromkeys(targets) if targets.count(t) > 1]
    rows += [("unmapped_source_column", "WARNING", c) for c in columns if c not in mapping and c not in unmapped]
    return spark.createDataFrame(rows, "issue_code string, severity string, subject string")


def alias_issues(aliases: DataFrame) -> DataFrame:
    """Source stores ``(source_store, canonical_store)`` of a scope with more than one canonical store."""
    counted = aliases.groupBy("source_store").agg(F.countDistinct("canonical_store").alias("n"))
    return counted.where("n > 1").select(F.lit("conflicting_store_alias").alias("issue_code"), "source_store")


def scoped_aliases(aliases: DataFrame, retailer_id: str, source_id: str, rule_version: str) -> DataFrame:
    """Aliases of a context (NULL scopes take any), one canonical store for each source store: the first listed by ``place``."""
    for name, value in (("retailer_id", retailer_id), ("source_id", source_id), ("rule_version", rule_version)):
        aliases = aliases.where(F.col(name).isNull() | (F.col(name) == value))
    return aliases.groupBy("source_store").agg(F.min(F.struct("place", "canonical_store")).alias("first")).select("source_store", F.col("first.canonical_store").alias("canonical_store"))


def alias_version(aliases: DataFrame) -> DataFrame:
    """One row: the number of aliases and 16 digits that stand for them, whatever their order."""
    own = F.conv(F.substring(F.sha2(F.concat_ws("|", "source_store", "canonical_store"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return aliases.agg(F.count("*").alias("n_aliases"), F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(own), F.lit(0)).cast("string")), 256), 1, 16).alias("alias_mapping_version"))
