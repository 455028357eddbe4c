import hashlib
import re

import numpy as np
import pytest

from shelfspark.llm import fill_middle as f
from shelfspark.llm import queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    spm = h[3] % 100 < spm_rate
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def same(got, rows, **kw):
    want = sorted(((*brute(i, t, **kw), t or "") for i, t in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("kind, offsets", [
    ("_Array", np.arange(0, 9000, 7)),
    ("_Bitmap", np.flatnonzero(np.random.default_rng(3).random(60_000) < 0.4)),
    ("_Runs", np.concatenate([np.arange(100, 9000), np.arange(20_000, 31_000)])),
])
def test_containers_select_like_a_sorted_list(kind, offsets):
    part = f.container(offsets)
    assert type(part).__name__ == kind
    assert [part.select(k) for k in range(len(offsets))] == offsets.tolist()


def test_set_over_many_containers():
    rng = np.random.default_rng(4)
    offsets = np.unique(np.concatenate([rng.integers(0, 400_000, 9000), np.arange(70_000, 99_000), np.flatnonzero(rng.random(65_536) < 0.5) + 262_144]))
    ends = f.BoundarySet()
    for part in np.array_split(offsets, 23):
        ends.extend(part)
    ends.close()
    assert len(ends) == len(offsets) and [ends.select(k) for k in range(0, len(offsets), 11)] == offsets[::11].tolist()
    assert {type(p).__name__ for p in ends.parts} == {"_Array", "_Bitmap", "_Runs"}


def test_lines_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(f, "STRIDE", 1000)
    for text in ("", "\n", "a", "a\n", "\n\n\n", "é\n😀\r\nz", "x y\x0bz\n", "\n" * 70_001, "ab\n" * 50_000, "w" * 3001):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends = f.line_ends(text)
        assert [ends.select(k) for k in range(len(ends))] == np.cumsum([len(u) for u in units]).tolist()


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    same(f.fill_in_middle(docs), rows)
    want = [(*b[:5], sha(b[5]), sha(t or "")) for b, (_, t) in ((brute(*r), r) for r in rows)]
    got = queries.QUERIES["op13_fill_middle"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["form"] for r in got} == {"psm", "spm"}


def test_odd_rows_and_rates(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    same(f.fill_in_middle(odd_docs), rows)
    assert f.fill_in_middle(no_docs).count() == 0
    texts = ["a\n<P>b", "<S>", "x<M>\ny", "< P>\n<<S\n>", "<P\n>", "<", ">\n<", "<S\nS>\n", "\n".join(["<", "P>", "M>"] * 9), "é\n😀\n\n", "l\n" * 70_000]
    some = [(i, t) for i, t in enumerate(texts * 4)] + [(3, "a\nb\nc\nd")] * 3
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    same(f.fill_in_middle(df), some)
    same(f.fill_in_middle(df, seed=3, rate=40, spm_rate=0), some, seed=3, rate=40, spm_rate=0)
