import hashlib
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm import fm_dedup as f


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def compare(df):
    rows = df.collect()
    want = sorted(((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows]), strict=True)), key=str)
    got = sorted(map(tuple, f.dedup_substrings(df).collect()), key=str)
    assert got == want
    return got


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 4, (40, 12)).astype(np.uint64)
    index = f.FMIndex(rows)
    for lo, hi in ((0, 12), (3, 7), (5, 6), (2, 11)):
        pats = [tuple(r[lo:hi]) for r in rows]
        all_ = Counter(tuple(r[i : i + hi - lo]) for r in rows for i in range(12 - (hi - lo) + 1))
        n = np.arange(40)
        got = index.occurs_twice(n, np.full(40, lo), np.full(40, hi))
        assert got.tolist() == [all_[p] > 1 for p in pats]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    got = compare(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text"))
    assert sum(g[2] for g in got) > 0


@pytest.fixture
def tricky(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(80)
    docs = [word(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 45)) :] + word(int(rng.integers(0, 60))) for _ in range(40)]
    docs += [["a"] * n for n in (34, 35, 36, 200)] + [["x", "y"] * 60, word(35) * 2, word(34) * 2, word(20) * 9]
    base = word(300)
    docs += [base[:k] + ["edit"] + base[k + 1 :] for k in (10, 34, 35, 100, 134, 135, 170)] + [base, base]
    return spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)


def test_runs_overlaps_and_edits(tricky):
    compare(tricky)


def test_hot_route_gives_the_same(tricky, monkeypatch):
    monkeypatch.setattr(f, "HOT_SURROUNDINGS", 0)
    compare(tricky)


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs)
    assert f.dedup_substrings(no_docs).count() == 0


def test_a_line_that_texts_repeat_is_one_row_of_each(spark):
    """Rows joined follow the texts that hold a line, not how often each repeats it."""
    line = [f"l{k}" for k in range(8)]
    counts = {}
    for n in (20, 40):
        docs = [[f"a{i}"] * (i % 3) + line * 30 + [f"b{i}", f"c{i}"] + line[: i % 8] for i in range(n)]
        df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
        compare(df)
        counts[n] = f.covered_windows(f._keyed(df, "doc_id", "text")).count()
    assert counts[20] <= 6 * 20 and counts[40] <= 2.1 * counts[20]
