import math

import numpy as np
import pytest

from shelfspark.llm import hard_negatives as h
from shelfspark.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, tile int, win int, anchor long"


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    """rows: (id, vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    good = [(i, [clip(x) for x in v] + [0] * (width - len(v)), label) for i, v, label in good]
    m, out = np.array([v for _, v, _ in good], dtype=object), []
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (i, v, label) in enumerate(good):
        if i is None or i % every:
            continue
        scores = [(clip(int(s)), good[b][0], good[b][2]) for b, s in enumerate(m @ np.array(v, dtype=object)) if b != a]
        for p, pid, _ in sorted((x for x in scores if x[2] == label), key=first)[:positives]:
            window = [x for x in scores if x[2] != label and low * p <= 100 * x[0] <= high * p]
            out += [(i, pid, k, n, p, s) for k, (s, n, _) in enumerate(sorted(window, key=first)[:negatives], 1)]
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(map(tuple, h.mine_hard_negatives(df, **kw).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    out = queries.QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(map(tuple, out), key=str) == want and len(want) > 500


def test_many_tiles_blocks_and_ties(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 50), ("LEAF", 4), ("FANOUT", 3), ("SHARED", 2), ("ANCHOR_BLOCK", 3), ("HELD", 40)):
        monkeypatch.setattr(h, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist(), int(rng.integers(0, 4))) for i in range(600)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(600, 900)]  # one very common vector
    rows += [(100, [0.25, 0.5, 1.0, 0.0, 0.0, 0.0], 1), (100, [0.25, 0.5, 1.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 6, 2), (None, [0.5] * 6, 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    assert got(df) == brute(rows)
    assert got(df, positives=2, negatives=3, low_percent=-50, high_percent=120, every=50) == brute(rows, 2, 3, -50, 120, 50)


def test_bad_vectors_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.5], 2), (3, None, 2), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2),
            (7, [0.5, 1.0], None), (8, [1.0], 2), (9, [], 2), (10, [-1.0, -1.0], 1), (200, [-1.0, -2.0], 1), (300, None, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    assert got(df) == brute(rows)
    assert h.mine_hard_negatives(df.limit(0)).count() == 0
    assert h.mine_hard_negatives(df.where("vec_id = 1")).count() == 0
    assert h.mine_hard_negatives(df.where("vec_id = 0")).count() == 0


def test_large_values_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, (rng.integers(-9, 10, 3) * 1e7).tolist(), i % 2) for i in range(60)] + [(7, [1e300, -1e300, 1.0], 0), (100, [1e300, 1.0, 1.0], 1)]
    assert got(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_hold_their_rows_and_prune(seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-50, 50, (640, 4))
    m = m[h.packed_order(m, [0, 1])].astype(float)
    starts = np.arange(0, 640, 64)
    boxes, q = h.Boxes(m, m).above(starts), rng.integers(-50, 50, (5, 4)).astype(float)
    least, most = boxes.interval(q, slice(None), True)
    scores = q @ m.T
    assert (least <= np.minimum.reduceat(scores, starts, axis=1)).all() and (most >= np.maximum.reduceat(scores, starts, axis=1)).all()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(640, np.int32)), pa.array(np.arange(640)), pa.array(np.arange(640)), pa.array(np.zeros(640, np.int64)), pa.array(m.astype(np.int64).tolist())], names=["tile", "rid", "vec_id", "label", "v"])
    open_ = np.full((5, 1), h.LARGEST)
    best = h.Best(-open_, open_, 3)
    opened = h.search(batch, q.astype(np.int64), np.full(5, -1), np.zeros(5, np.int64), True, best)
    assert opened < 50  # not all leaves for all anchors
    a, _, score, _, _, _ = best.rows()
    assert [sorted(score[a == k].tolist()) for k in range(5)] == np.sort(scores, axis=1)[:, -3:].astype(int).tolist()
