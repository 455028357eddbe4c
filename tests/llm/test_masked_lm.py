import random

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import masked_lm as m
from shelfspark.llm.words import groups


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = m._texts(docs, "doc_id", "text")
    leaves = m.leaves_of(m.vocabulary(texts))
    weights = m.train_round(texts, leaves, m.initial(leaves))
    return docs, leaves, weights


def scored(leaves, weights, texts):
    within = leaves.branch_shares()[2] + leaves.inner
    out = []
    for g in groups(pa.array(texts), lower=True):
        out.append(m.word_scores(leaves, weights, leaves.of(g.hashes()), g.edges, within))
    return np.concatenate(out)


def test_counts_cover_every_word(spark, fitted):
    docs, leaves, _ = fitted
    words = [w for r in docs.collect() for w in (r["text"] or "").encode().lower().split()]
    vocab = m.vocabulary(m._texts(docs, "doc_id", "text"))
    assert vocab.count() == len(set(words)) and leaves.counts.sum() == len(words)


def test_probabilities_of_all_words_sum_to_one(fitted):
    _, leaves, weights = fitted
    first, second, leaf = leaves.branch_shares()
    rows = np.array([[5, 9, 40, m.EMBEDDINGS]])
    *_, p, _ = m.forward(weights, rows, np.array([0]))
    nodes = np.zeros((m.BRANCHES, m.BRANCHES))
    for f in range(m.BRANCHES):
        nodes[f] = np.exp(m.forward(weights, rows, np.array([f]))[-1][0] + p[0, f])
    every = np.arange(m.LEAVES)
    assert nodes.sum() == pytest.approx(1, abs=1e-4)
    assert (np.exp(leaf) * nodes[every % 32, every // 32 % 32]).sum() == pytest.approx(1, abs=1e-4)


def test_context_beats_counts_and_real_text_beats_shuffled(fitted):
    docs, leaves, weights = fitted
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) > 100]
    free = scored(leaves, [w * 0 if k in (3, 6) else w for k, w in enumerate(m.initial(leaves))], texts).mean()
    real = scored(leaves, weights, texts).mean()
    rng = random.Random(1)
    mixed = scored(leaves, weights, [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]).mean()
    print("FIGURES", round(free, 3), round(real, 3), round(mixed, 3))
    assert real > free + 0.04 and real > mixed + 0.04


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {(r["doc_id"], r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]) for r in m.score_documents(odd_docs).collect()}
    assert (1, 0, 0.0, None) in rows and (None, 0, 0.0, None) in rows and (2, 0, 0.0, None) in rows
    assert m.score_documents(odd_docs).count() == 9 and m.score_documents(no_docs).count() == 0
