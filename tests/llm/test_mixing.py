import pytest

from shelfspark.llm import mixing as m


def test_water_fill_caps_and_shares_the_excess():
    t = m.water_fill([10, 1000, 1000], [1, 1, 1])
    assert t[0] == 30 and t[1] == t[2] == pytest.approx(990)
    assert sum(m.water_fill([5, 0, 7], [1, 2, 3])) == pytest.approx(12)
    assert m.water_fill([], []) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = m.mix_sources(docs).toPandas()
    again = m.mix_sources(docs.repartition(3)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert rows.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(s == len((texts[d] or "").encode().split()) for d, s in zip(rows.doc_id, rows["size"], strict=True))
    assert (rows.taken <= 3 * rows["size"]).all() and len(rows) == len(texts)
    own = rows.groupby("target").agg(taken=("taken", "sum"), n=("source_size", "nunique"), size=("source_size", "first"))
    for target, r in own.iterrows():
        if r.n == 1:
            assert abs(r.taken - target) <= max(6 * m.BLOCK_WORDS, 0.02 * target)


def test_odd_rows(odd_docs, no_docs):
    rows = m.mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert m.mix_sources(no_docs).count() == 0
