"""The stored mart: pruned reads, write-back, ingestion with restart, seek pages, roll-ups that merge."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import breakdowns, definitions, ingest, mart, product_store
from shelfspark.plans import inputs, mart_queries, registry
from shelfspark.sources import store
from shelfspark.streaming import incremental, ingest_files

SF = "/root/testdata/sf0.001"


def d(text):
    return dt.date.fromisoformat(text)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def whole_plans(spark):
    held = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", held)


def test_stored_reads_are_pruned_and_leave_the_sales_alone(spark, whole_plans):
    for name in ("mart_fact_scan", "fact_scan", "stored_events"):
        registry.QUERIES[name](spark, SF).count()
        text = plan(registry.QUERIES[name](spark, SF))
        held = [line for line in text.splitlines() if "PartitionFilters" in line]
        assert held and all("period_start" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in held), name
        assert "lineitem" not in text, name


def test_all_grains_come_from_the_stored_base(spark):
    build = store.open_build(spark, SF)
    rows, missing = definitions.calculate_base(inputs.based(spark, SF, build), definitions.standard_definitions())
    assert not missing and "lineitem" not in plan(rows)


def test_counts_and_sums_of_hand_rows(spark):
    """Brands of one name in two categories, a store without sales, and a NULL SKU, which is no value to count."""
    rows = [
        ("c", "m", "b", "s1", "t1", 1.0), ("c", "m", "b", "s2", "t1", 2.0), ("c", "m", "b", "s1", "t2", -1.0), ("e", "m", "b", "s3", "t1", 4.0), ("e", "m", "x", "s4", "t3", 0.0), ("e", "m", "x", None, "t3", 1.0),
    ]
    df = spark.createDataFrame([(d("2026-01-01"), *r) for r in rows], "period date, category string, manufacturer string, brand string, sku string, store string, units double")
    for c in ("revenue_vat", "revenue_net", "margin_abs", "shelf_price_vat", "input_price_vat"):
        df = df.withColumn(c, F.col("units"))
    out, _ = definitions.calculate(df, definitions.standard_definitions())
    got = {(r["entity_type"], r["category"], r["entity_id"], r["concept"]): r["metric_value"] for r in out.collect()}
    assert got["network", None, "ALL", "units"] == 7.0 and got["category", "c", "c", "units"] == 2.0 and got["brand", "e", "b", "units"] == 4.0
    assert got["brand", "c", "b", "store_count"] == 2.0 and got["brand", "c", "b", "selling_store_count"] == 1.0 and got["brand", "c", "b", "active_store_count"] == 2.0 and got["brand", "c", "b", "distribution"] == 0.5
    assert got["store", None, "t1", "assortment_sku_count"] == 3.0 and got["store", None, "t1", "assortment_brand_count"] == 1.0 and got["store", None, "t1", "assortment_category_count"] == 2.0
    assert got["store", None, "t3", "assortment_sku_count"] == 0.0 and got["store", None, "t3", "assortment_brand_count"] == 1.0 and got["store", None, "t2", "assortment_sku_count"] == 0.0
    assert got["sku", "e", None, "units"] == 1.0 and got["category", "e", "e", "units_per_selling_store"] == 2.5


def test_a_build_is_written_once_and_whole(spark, tmp_path):
    build = store.Build(spark, str(tmp_path), "mart_build_x", "source_revision_x")
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(d("2026-01-01"), "a"), (d("2026-02-01"), "b")], "period date, k string")

    for _ in range(2):
        assert sorted(r["k"] for r in build.dataset("t", make).collect()) == ["a", "b"]
    assert made == [1]
    assert [r["k"] for r in build.read("t").where(F.col("period") == F.lit("2026-02-01").cast("date")).collect()] == ["b"]
    other = store.Build(spark, str(tmp_path), "mart_build_y", "source_revision_y")
    other.write("t", make())  # broke off: no record
    assert not other.has("t") and other.dataset("t", make).count() == 2 and other.has("t") and len(made) == 3
    assert build.read("t").count() == 2
    empty = build.dataset("e", lambda: make().where("k = 'z'"))
    assert empty.count() == 0 and empty.columns == ["period", "k"]


def test_identity_of_sources_follows_their_files(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / f"{n}.parquet"))
    first = store.content_hash(spark, str(tmp_path), ("a", "b"))
    assert first == store.content_hash(spark, str(tmp_path), ("a", "b"))
    spark.range(6).coalesce(1).write.mode("append").parquet(str(tmp_path / "b.parquet"))
    assert first != store.content_hash(spark, str(tmp_path), ("a", "b"))


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_write_back_leaves_other_months_files_alone(spark, tmp_path):
    path = str(tmp_path / "mart")
    months = [d(f"2025-{m:02d}-01") for m in range(1, 13)] + [d("2026-01-01"), d("2026-02-01")]
    rows = spark.createDataFrame([(m, f"s{k}", float(k)) for m in months for k in range(3)], "period date, store string, v double")
    build = lambda r: r.groupBy("period").agg(F.sum("v").alias("v"))
    build(rows).write.partitionBy("period").parquet(path)
    before = files_of(path)
    fixed = rows.withColumn("v", F.when(F.col("period") == F.lit("2025-01-01").cast("date"), 10.0).otherwise(F.col("v")))
    incremental.write_back(fixed, rows.where("period = date'2025-01-01'"), build, path)
    after = files_of(path)
    touched = {"period=2025-01-01", "period=2025-02-01", "period=2026-01-01"}
    assert {k.split("/")[0] for k in set(before) ^ set(after)} == touched
    assert all(before[k] == after[k] for k in set(before) & set(after)) and len(set(before) & set(after)) == 11
    got = {str(r["period"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 14 and got["2025-01-01"] == 30.0 and got["2025-02-01"] == 3.0


SALES = "period date, store string, v double"


def land(spark, path, name, rows):
    spark.createDataFrame(rows, SALES).coalesce(1).write.parquet(f"{path}/{name}")


def monthly(rows):
    return rows.groupBy("period").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


def test_ingestion_takes_content_once_and_survives_a_failure(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "state")
    land(spark, landing, "a", [(d("2026-01-01"), "s", 1.0), (d("2026-01-01"), "t", 2.0)])
    schema = spark.createDataFrame([], SALES).schema
    fail = [True]

    def build(rows):
        if fail[0]:
            fail[0] = False
            rows.count()
            raise RuntimeError("lost between canonical rows and ledger")
        return monthly(rows)

    go = lambda: ingest_files.ingest_files(spark, landing, root, schema, build, "r", "s", 2)
    with pytest.raises(Exception, match="lost between"):
        go()
    assert not ingest_files.exists(spark, f"{root}/ledger")
    go()
    facts = lambda: {str(r["period"]): (r["v"], r["n"]) for r in spark.read.parquet(f"{root}/facts").collect()}
    assert facts() == {"2026-01-01": (3.0, 2)}
    land(spark, landing, "b", [(d("2026-01-01"), "t", 2.0), (d("2026-01-01"), "s", 1.0)])  # the same rows in another order and file
    land(spark, landing, "c", [(d("2026-02-01"), "s", 5.0)])
    land(spark, landing, "d", [(d("2026-02-01"), "s", 5.0)])
    go()
    assert facts() == {"2026-01-01": (3.0, 2), "2026-02-01": (5.0, 1)}
    states = sorted(r["registration"] for r in ingest_files.ledger(spark, root).collect())
    assert states == ["IDENTICAL_DUPLICATE", "IDENTICAL_DUPLICATE", "NEW_ARTIFACT", "NEW_REVISION"]
    go()
    assert facts() == {"2026-01-01": (3.0, 2), "2026-02-01": (5.0, 1)} and ingest_files.ledger(spark, root).count() == 4


def test_a_batch_run_again_replaces_what_it_wrote(spark, tmp_path):
    root = str(tmp_path / "state")
    rows = spark.createDataFrame([(d("2026-01-01"), "s", 1.0, "f1")], SALES + ", file string")
    for _ in range(2):
        ingest_files.ingest_batch(rows, 7, root, ("period", "store", "v"), monthly, "r", "s")
    assert spark.read.parquet(f"{root}/canonical").count() == 1 and ingest_files.ledger(spark, root).count() == 1


def test_seek_pages_walk_the_whole_order(spark):
    rows = [(k % 3 if k % 5 else None, k % 4, k) for k in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(3)
    order, got, after = ("a", "b", "c"), [], None
    while page := [tuple(r) for r in breakdowns.seek_page(df, order, 7, after).collect()]:
        got += page
        after = page[-1]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    one = breakdowns.browse(spark.createDataFrame([(d("2026-01-01"), "x"), (d("2026-02-01"), "y"), (d("2026-02-01"), "z")], "period date, k string"), ("period", "k"), 500, None, "2026-02-01", None, {"k": ("y", "z")})
    assert [tuple(r) for r in one.collect()] == [(d("2026-02-01"), "y", 2), (d("2026-02-01"), "z", 2)]


def test_roll_ups_merge_by_any_way(spark):
    rows = mart_queries._product_store(spark, SF)
    direct = product_store.served(product_store.rolled_up(rows, ("category",)), ("category",))
    twice = product_store.served(product_store.rolled_up(product_store.rolled_up(rows, ("period", "category", "region")), ("category",)), ("category",))
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_rolled_up_values_are_never_invented(spark):
    base = [(d("2026-01-01"), "c", 1.0, 1.0, 1.0, 0.4, 2.0, 1.0, 2.0, 1.0, 0, 0, False, "r1"), (d("2026-02-01"), "c", 2.0, 3.0, 1.0, None, 4.0, 1.0, None, None, 1, 1, None, "r2"), (d("2026-01-01"), "e", 2.0, 0.0, 0.0, 1.0, 4.0, 1.0, None, None, 0, 0, True, "r1")]
    names = "period date, category string, revenue_vat double, revenue_net double, units double, margin_abs double, shelf_price_vat_value double, shelf_price_vat_weight double, input_price_vat_value double, input_price_vat_weight double, null_margins int, return_rows int, private_label boolean, rev string"
    rows = product_store.product_store_facts(spark.createDataFrame(base, names), ("category",), {"source_revision_id": F.col("rev"), "analysis_run_id": F.lit("run")})
    got = {(r["category"], r["metric_concept"]): r for r in product_store.served(product_store.rolled_up(rows, ("category",)), ("category",)).collect()}
    assert got["c", "revenue"]["value"] == 4.0 and got["c", "retailer_margin_abs"]["value"] is None and got["c", "retailer_margin_pct"]["value"] is None
    assert got["c", "weighted_shelf_price_vat"]["value"] == 3.0 and got["c", "weighted_input_price_vat"]["value"] is None
    assert got["e", "retailer_margin_pct"]["value"] is None and got["e", "retailer_margin_pct"]["denominator_value"] == 0.0
    r = got["c", "units"]
    assert (r["quality_status"], r["quality_flags"], r["flag_counts"]) == ("mixed", "missing_margin,returns,unknown_private_label", "missing_margin=1,returns=1,unknown_private_label=1")
    assert (r["source_revision_ids"], r["latest_revision_id"], r["latest_period"], r["n_facts"]) == ("r1,r2", "r2", d("2026-02-01"), 2)
    assert got["e", "units"]["quality_status"] == "valid" and got["e", "units"]["flag_counts"] == ""


def test_range_strategies(spark):
    cases = {  # aggregation, concept, parts there, share scope -> without and with knowledge of parts
        ("sum", "revenue", False, None): (mart.SUM, mart.SUM), ("ratio_of_sums", "margin_pct", True, None): (mart.RATIO, mart.RATIO), ("ratio_of_sums", "margin_pct", False, None): (mart.RATIO, mart.PERIOD_ONLY),
        ("ratio_of_sums", "revenue_share", True, "category"): (mart.PERIOD_ONLY, mart.SHARE), ("ratio_of_sums", "revenue_share", True, None): (mart.PERIOD_ONLY, mart.PERIOD_ONLY),
        ("sum", "abc_revenue", False, None): (mart.PERIOD_ONLY, mart.PERIOD_ONLY), ("derived_ratio", "distribution", True, None): (mart.PERIOD_ONLY, mart.PERIOD_ONLY), ("median", "price", False, None): (mart.UNSUPPORTED, mart.UNSUPPORTED),
        ("ratio_of_sums", "abc_share", True, "category"): (mart.PERIOD_ONLY, mart.SHARE), ("weighted_average", "price", True, None): (mart.WEIGHTED, mart.WEIGHTED), ("distinct_count", "store_count", False, None): (mart.PERIOD_ONLY, mart.PERIOD_ONLY),
    }
    df = spark.createDataFrame([(*k,) for k in cases], "a string, c string, p boolean, s string")
    rows = df.select("*", mart.range_strategy(F.col("a"), F.col("c"), F.lit("")).alias("x"), mart.range_strategy(F.col("a"), F.col("c"), F.lit(""), F.col("p"), F.col("s")).alias("y")).collect()
    assert {(r["a"], r["c"], r["p"], r["s"]): (r["x"], r["y"]) for r in rows} == cases


def test_fact_layout_and_validation(spark):
    metrics = "period date, category string, sku string, entity_type string, entity_id string, concept string, metric_name string, metric_definition_id string, metric_definition_version string, metric_config_hash string, metric_value double, numerator_value double, denominator_value double, aggregation string"
    df = spark.createDataFrame([(d("2024-02-01"), 'a"b', "s1", "sku", "s1", "revenue", "sku_revenue", "sku.revenue.v1", "v1", "h", 2.0, None, None, "sum")], metrics)
    scope = {"retailer_id": "r", "source_id": "s", "source_revision_id": "", "analysis_run_id": "run", "mart_build_id": "b", "rule_version": "v"}
    facts = mart.stored_facts(df, scope)
    row = facts.first()
    assert facts.columns == list(mart.FACT_SCHEMA) and len(facts.columns) == 36
    assert (row["period_end"], row["business_period_id"], row["parent_entity_ids"], row["range_aggregation_strategy"], row["private_label_scope"]) == (d("2024-02-29"), "2024-02-01", '{"canonical_product_id": "s1", "category": "a\\"b"}', mart.SUM, "INCLUDE")
    issues = {(r["issue_code"], r["subject"], r["n_rows"]) for r in mart.fact_issues(facts.unionByName(facts), {"retailer_id": ("q",)}).collect()}
    assert issues == {("OUTSIDE_BUILD", "retailer_id=r", 2), ("MISSING_SOURCE_REVISION", "source_revision_id", 2), ("DUPLICATE_IDENTITY", "sku|s1|sku.revenue.v1|2024-02-01", 2)}
    assert mart.fact_issues(mart.stored_facts(df, scope | {"source_revision_id": "x"}), {"retailer_id": ("r",)}).count() == 0
    with pytest.raises(ValueError, match="lack columns: concept"):
        mart.stored_facts(df.drop("concept"), scope)
    with pytest.raises(ValueError, match="no filter on colour"):
        mart.query_facts(facts, colour="red")


def test_row_numbers_run_over_groups(spark):
    rows = [(d("2026-01-01"), "b", 2), (d("2026-01-01"), "a", 9), (None, None, 1), (d("2026-02-01"), "a", 3), (d("2026-01-01"), "a", 4), (d("2026-01-01"), None, 7)]
    got = ingest.numbered(spark.createDataFrame(rows, "period date, store string, v int"), ("period", "store")).orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in got] == [1, 2, 3, 4, 5, 6] and [r["v"] for r in got] == [1, 7, 4, 9, 2, 3]
    one = ingest.numbered(spark.createDataFrame([(2, "x"), (1, "y"), (2, "a")], "k int, v string"), ("k",)).orderBy("source_row_number").collect()
    assert [r["v"] for r in one] == ["y", "a", "x"]
