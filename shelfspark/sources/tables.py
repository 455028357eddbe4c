"""Sources and sinks: given tables, the canonical sales view, partitioned facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One expression per canonical column over lineitem, part, supplier, nation and region.
CANONICAL = {
    "retailer_id": "'retailer_a'",
    "source_id": "'source_a'",
    "analysis_run_id": "'run_a'",
    "period": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "store": "concat('STORE_', CAST(l_suppkey AS STRING))",
    "store_format": "CASE l_suppkey % 3 WHEN 0 THEN 'HYPER' WHEN 1 THEN 'SUPER' ELSE 'CONVENIENCE' END",
    "region": "r_name",
    "sku": "concat('SKU_', CAST(l_partkey AS STRING))",
    "sku_name": "p_name",
    "category": "p_type",
    "brand": "p_brand",
    "manufacturer": "concat('MFR_', CAST(CAST(substring(p_brand, 7) AS INT) % 5 AS STRING))",
    "package": "split_part(p_name, ' ', 2)",
    "carbonation": "split_part(p_name, ' ', 1)",
    "volume_l": "CASE WHEN p_size = 50 THEN NULL ELSE p_size / CAST(10 AS DOUBLE) END",
    "private_label": "CASE WHEN CAST(substring(p_brand, 7) AS INT) <= 5 THEN true WHEN CAST(substring(p_brand, 7) AS INT) = 25 THEN NULL ELSE false END",
    "is_own": "CAST(substring(p_brand, 7) AS INT) IN (7, 8, 9)",
    "units": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END",
    "revenue_vat": "(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1 ELSE 1 END) * CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))",
    "shelf_price_vat": "l_extendedprice / l_quantity * (1 + l_tax)",
    "input_price_vat": "CASE WHEN p_size = 49 THEN NULL ELSE p_retailprice END",
    "category_group": "CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'CATEGORY_REDUCED' ELSE 'CATEGORY_STANDARD' END",
}


#: Stores that are broadcast with their regions, about a hundred bytes each.
MOST_STORES = 500_000


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows with their part and the region of their store; nation and region have fixed sizes."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("supplier").join(F.broadcast(t("nation")), F.expr("s_nationkey = n_nationkey")).join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey")).select("s_suppkey", "r_name")
    places = F.broadcast(places) if t("supplier").count() <= MOST_STORES else places
    return t("lineitem").join(t("part"), F.expr("l_partkey = p_partkey")).join(places, F.expr("l_suppkey = s_suppkey"))


def load_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical sales row per lineitem row; column pruning reaches the scans."""
    return joined(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in CANONICAL.items()])


#: What the canonical columns are made of beside the month, and the columns that tell SKUs and stores.
RAW = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "r_name")
KEYS = {"sku": "l_partkey", "store": "l_suppkey"}


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as they are stored: the month and the columns that the canonical ones are made of, a few bytes a row."""
    return joined(spark, sf_dir).selectExpr(f"{CANONICAL['period']} AS period", *RAW)


def canonical_of(raw: DataFrame) -> DataFrame:
    """Canonical rows of stored sales; ``sku_key`` and ``store_key`` are the columns that these are dealt out by."""
    return raw.selectExpr(*[f"{'period' if c == 'period' else e} AS {c}" for c, e in CANONICAL.items()], *[f"{k} AS {c}_key" for c, k in KEYS.items()])


#: Layout of stored metric facts.
FACT_PARTITIONS = ("retailer_id", "source_id", "period_grain", "period_start", "mart_build_id")


def write_facts(facts: DataFrame, path: str) -> None:
    """Partitioned facts; only the partitions in ``facts`` are replaced."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FACT_PARTITIONS).parquet(path)


def read_facts(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Facts with the given columns and types, missing ones as NULL, in that order."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
