"""Tax resolution, retailer economics and row quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MONEY, ratio

#: rule_id, valid_from, valid_to (NULL: open), rate, category_group.
TAX_RULES = (
    ("reduced", "1995-01-01", None, 0.10, "CATEGORY_REDUCED"),
    ("std_1", "1995-01-01", "1998-12-31", 0.20, "CATEGORY_STANDARD"),
    ("std_2", "1999-01-01", None, 0.22, "CATEGORY_STANDARD"),
)


#: Rules that are broadcast, some 50 bytes each.
MOST_RULES = 50_000


def tax_rules(spark, rules=TAX_RULES) -> DataFrame:
    raw = spark.createDataFrame(list(rules), "rule_id string, valid_from string, valid_to string, rate double, category_group string")
    return raw.select("rule_id", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "rate", F.col("category_group").alias("rule_group"))


def resolve_tax(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds tax_rule_id, tax_rate and tax_issue. A row needs exactly one rule with its group and month.

    The rules of a group go to its rows as one list and are held against the month in place, so the sales are read once and
    rows are never multiplied or regrouped. The lists are broadcast up to MOST_RULES rules.
    """
    own = rules.groupBy(F.col("rule_group").alias("category_group")).agg(F.array_sort(F.collect_list(F.struct("rule_id", "rate", "valid_from", "valid_to"))).alias("rules"))
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        own = F.broadcast(own)
    fits = F.filter("rules", lambda r: (F.col("period") >= r["valid_from"]) & (r["valid_to"].isNull() | (F.col("period") <= r["valid_to"])))
    n, one = F.coalesce(F.size("fits"), F.lit(0)), F.get("fits", F.lit(0))
    n = F.greatest(n, F.lit(0))  # the size of a missing list is -1 or NULL
    valid = F.coalesce((n == 1) & one["rate"].between(0, 0.9999999), F.lit(False))
    issue = F.when(n == 0, "no_matching_tax_rule").when(n > 1, "multiple_matching_tax_rules").when(~valid, "invalid_tax_rate")
    out = df.join(own, "category_group", "left").withColumn("fits", fits)
    return out.select(*df.columns, F.when(n == 1, one["rule_id"]).alias("tax_rule_id"), F.when(valid, one["rate"]).alias("tax_rate"), issue.alias("tax_issue"))


def add_economics(df: DataFrame) -> DataFrame:
    """Net values and row economics; amounts that are summed later are exact decimals."""
    net = lambda c: F.col(c).cast("double") / (1 + F.col("tax_rate"))
    out = df.withColumns({"revenue_net": net("revenue_vat").cast(MONEY), "shelf_price_net": net("shelf_price_vat"), "input_price_net": net("input_price_vat")})
    out = out.withColumn("input_cost_net", (F.col("input_price_net") * F.col("units")).cast(MONEY))
    out = out.withColumn("margin_abs", (F.col("revenue_net") - F.col("input_cost_net")).cast(MONEY))
    return out.withColumns(
        {
            "margin_pct": ratio("margin_abs", "revenue_net"),
            "markup_pct": ratio("margin_abs", "input_cost_net"),
            "realized_price_vat": F.when(F.col("units") > 0, ratio("revenue_vat", "units")),
            "shelf_price_delta_vat": F.col("shelf_price_vat") - F.when(F.col("units") > 0, ratio("revenue_vat", "units")),
            "sign_class": sign_class(),
        }
    )


def sign_class():
    u, r = F.col("units"), F.col("revenue_vat")
    return F.when((u >= 0) & (r >= 0), "SALE").when((u < 0) & (r < 0), "RETURN_OR_CORRECTION").otherwise("SUSPICIOUS")


def enriched_of(rows: DataFrame) -> DataFrame:
    return add_economics(resolve_tax(rows, tax_rules(rows.sparkSession)))


def load_enriched(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import load_canonical

    return enriched_of(load_canonical(spark, sf_dir))


def semantic_tax_group(df: DataFrame, rules: DataFrame, default: str | None) -> DataFrame:
    """Tax group by exact (category, package); two matches are ambiguous, none falls to the default."""
    counted = rules.groupBy("category", "package").agg(F.count("*").alias("n"), F.min("tax_group").alias("tax_group"))
    out = df.join(counted, ["category", "package"], "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(n > 1, "ambiguous").when(n == 1, "matched").when(F.lit(default is not None), "default").otherwise("unknown")
    return out.withColumn("tax_state", state).withColumn("tax_group", F.when(n == 1, F.col("tax_group")).when(n == 0, F.lit(default))).drop("n")
