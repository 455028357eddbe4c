"""What queries shuffle and store for each sales row, the making of what they read included."""

import re

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import mart, product_store
from shelfspark.plans import mart_queries, registry
from shelfspark.sources import store

SF, N_ROWS = "/root/testdata/sf0.001", 6000


def written(spark):
    """Shuffled records and bytes of the stages so far."""
    gateway = spark.sparkContext._gateway
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    stages = {(found.apply(k).stageId(), found.apply(k).attemptId()): (found.apply(k).shuffleWriteRecords(), found.apply(k).shuffleWriteBytes()) for k in range(found.size())}
    return stages


def costs(spark, tmp_path, name):
    """(records, bytes) shuffled and rows stored by a query in a fresh mart, each for a sales row."""
    spark.conf.set("spark.shelfspark.mart.dir", str(tmp_path))
    try:
        before = written(spark)
        registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        new = [x for k, x in written(spark).items() if k not in before]
        build = store.open_build(spark, SF)
        stored = sum(build.read(p.name).agg(F.count("*")).first()[0] for p in tmp_path.iterdir() if p.name != "builds")
    finally:
        spark.conf.unset("spark.shelfspark.mart.dir")
    return sum(x[0] for x in new) / N_ROWS, sum(x[1] for x in new) / N_ROWS, stored / N_ROWS


#: Query -> most records and bytes shuffled, and rows stored.
MOST = {
    "catalog_limitations": (15, 1000, 3),
    "product_filter": (4, 300, 1.1),
    "compare_features": (9, 520, 1.1),
    "event_families": (9, 520, 1.1),
    "fact_comparison": (11, 550, 5),
    "metrics_brand": (5, 400, 1.1),
    "category_share": (2, 200, 1.1),
    "month_set_compare": (2, 200, 1.1),
    "served_category_share": (3, 250, 1.1),
    "events_deduplicated": (5, 300, 1.1),
    "store_format_distribution": (4, 250, 1.1),
    "metric_templates": (11, 550, 5),
    "portfolio_positions": (15, 1000, 3),
    "mart_fact_descriptions": (20, 1200, 3),
    "fact_validation": (20, 1200, 3),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_shuffles_and_stored_rows_are_few(spark, tmp_path, name):
    got = costs(spark, tmp_path, name)
    print(name, got)
    assert all(a <= b for a, b in zip(got, MOST[name], strict=True)), got


def test_product_store_rows_are_added_up_without_sorting_them(spark):
    """The first aggregation of a roll-up keeps numbers and dates only, so tasks hold a table of groups and do not sort or spill the rows."""
    rows = product_store.rolled_up(mart_queries._product_store(spark, SF), ("period", "category", "brand"))
    text = rows._jdf.queryExecution().executedPlan().toString()
    first = [x for x in re.findall(r"(\w*Aggregate)\(keys=.*partial_sum", text) if x]
    assert first[-1] == "HashAggregate" and "latest" not in re.findall(r"functions=\[(.*)", text)[-1]


def test_validation_finds_repeated_identities_in_lists(spark):
    """Facts that stand two and three times, in an entity with other facts; NULL parts of an identity are equal."""
    names = list(mart.FACT_SCHEMA)
    one = {k: None for k in names} | {"grain_id": "sku", "entity_id": "s", "source_revision_id": "r"}
    rows = [one | {"metric_definition_id": m} for m in ("a", "b", "b", "c", "c", "c", None, None)] + [one | {"entity_id": "t", "metric_definition_id": "b"}]
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], ", ".join(f"{k} {t}" for k, t in mart.FACT_SCHEMA.items()))
    got = {(r["subject"], r["n_rows"]) for r in mart.fact_issues(df, {}).where("issue_code = 'DUPLICATE_IDENTITY'").collect()}
    assert got == {("sku|s|b", 2), ("sku|s|c", 3), ("sku|s", 2)}
