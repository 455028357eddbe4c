import math

import numpy as np

from shelfspark.llm import audio_chroma as a
from shelfspark.llm import html_wrappers as h
from shelfspark.llm import masked_lm as m
from shelfspark.llm import weak_quality as w


def test_main_text_of_odd_pages(spark):
    pages = [
        (1, "http://a.b/x", "<html><head><title>T</title></head><body><nav><ul><li><a>Menu</a></ul></nav><article><h1>One</h1><p>two &amp;\n <b>th</b>ree<br>four<p>five<div class='comments'><p>no</div></article><footer>f</footer>"),
        (1, "http://a.b/x", None),
        (2, None, ""),
        (3, "none", "<p>plain<script>var t='</p>';</script> text"),
        (4, "http://a.b/y", "<body><div class=ad>buy</div><aside>s</aside><form><p>q</p></form>"),
    ]
    df = spark.createDataFrame([(*p, "h", "w") for p in pages], "page_id long, url string, html string, host string, wrapper string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in h.extract_main_text(df).collect())
    assert got == [(1, "", 0), (1, "One two & three four five", 25), (2, "", 0), (3, "plain text", 10), (4, "", 0)]
    assert h.extract_main_text(df.limit(0)).count() == 0


def test_em_finds_accurate_labellers():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(20_000) < p, np.where(bad, -1, 1), np.where(bad, 1, -1)) for p in (0.95, 0.9, 0.9)], axis=1)
    keys, n = np.unique(votes, axis=0, return_counts=True)
    posterior, _ = w.fit_labellers({tuple(map(int, k)): int(c) for k, c in zip(keys, n, strict=True)})
    assert posterior[-1, -1, -1] > 0.95 and posterior[1, 1, 1] < 0.05


def test_scorer_on_labelled_documents(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["keep"] for r in w.judge_quality(docs).collect()}
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, junk = [got[i] for i, q, t in labels if q and not t], [got[i] for i, q, _ in labels if not q]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.1
    assert w.judge_quality(odd_docs).count() == odd_docs.count() and w.judge_quality(no_docs).count() == 0


def test_masked_scores(spark, odd_docs, no_docs):
    rows = m.score_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["n_words"] == 0) == (r["mean_log_likelihood"] is None) and math.isfinite(r["log_likelihood"]) for r in rows)
    assert m.score_documents(no_docs).count() == 0


def test_shifted_recording_is_aligned(spark):
    rng = np.random.default_rng(3)
    song = rng.normal(0, 0.2, 64).tolist()
    rows = [(100, song), (101, song), (102, rng.normal(0, 0.2, 8).tolist() + song), (103, rng.normal(0, 0.2, 64).tolist()), (104, None), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["class_id"]): (r["n_members"], r["offset"]) for r in a.align_recordings(df, "vec_id", "embedding", a.melody).collect()}
    assert got[100, 100] == (2, 0) and got[100, 102] == (1, 16) and (100, 103) not in got and got[200, 104] == (2, 0)
    assert a.align_recordings(df.limit(0), "vec_id", "embedding", a.melody).count() == 0
