import math

import numpy as np

from shelfspark.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (width - len(v))) for i, v in good]
    m, out = np.array([v for _, v in good], dtype=object), []
    for a, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            s = m @ np.array(v, dtype=object)
            best = sorted((-x, good[b][0] is None, good[b][0] or 0) for b, x in enumerate(s) if b != a)[:k]
            out += [(i, r, None if none else j, -x) for r, (x, none, j) in enumerate(best, 1)]
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in vectors.collect()])
    assert sorted(map(tuple, topk.top_k(vectors).collect()), key=str) == want


def test_ties_blocks_and_bad_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 3), 1.0]) for i in range(90)] + [(None, [1.0, 1.0]), (7, None), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 0.0]), (40, [5.0, 5.0]), (91, [1e9, -3e9]), (92, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, q int, bin int, score int").repartition(5)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, topk.top_k(df).collect()), key=str) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 3")).count() == 0


def test_large_values_have_defined_scores(spark):
    rows = [(0, [1e10, 1.0]), (1, [1e10, 2.0]), (2, [-1e10, 0.0]), (3, [1e300, 0.0]), (20, [0.5, 0.5]), (4, [1e5, 1e5])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()]
    limit = 2**63 - 1
    clip = lambda x: max(-limit, min(limit, x))
    whole = {i: [clip(int(np.floor(max(-(2.0**63), min(2.0**63, 64 * x))))) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        scores = sorted(((-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in whole if i != q))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)
