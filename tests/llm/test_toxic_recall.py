import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import weak_quality as w


@pytest.mark.parametrize("rate", [0.001, 0.01, 0.05])
def test_rare_toxic_documents_go(spark, rate):
    rng, rows = np.random.default_rng(7), []
    for i in range(10_000):
        words = [f"word{k}" for k in rng.zipf(1.3, 60) % 5000]
        if i < rate * 10_000:
            for at in rng.choice(60, 3, replace=False):
                words[at] = w.INSULTS[int(rng.integers(len(w.INSULTS)))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["keep"] for r in w.judge_quality(docs, sample_docs=4_000).collect()}
    toxic = [kept[i] for i in range(int(rate * 10_000))]
    clean = [kept[i] for i in range(int(rate * 10_000), 10_000)]
    assert np.mean(toxic) <= 0.05 and np.mean(clean) >= 0.98


def test_toxic_recall_in_each_language(spark):
    """Words are learned from the labels of even ids; recall and loss are those of odd ids."""
    sf = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    held = w.judge_quality(docs, labels=labels.where("doc_id % 2 = 0")).select("doc_id", "keep")
    odd = labels.where("doc_id % 2 = 1 and quality = 1").join(docs.select("doc_id", "lang"), "doc_id").join(held, "doc_id")
    figures = {(r["lang"], r["toxic"]): (r["n"], r["kept"]) for r in odd.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    print("FIGURES", figures)
    for lang in ("de", "en", "fr", "es"):
        assert figures[lang, 1][1] <= 0.1, (lang, figures)
        assert figures[lang, 0][1] >= 0.95, (lang, figures)


def test_labellers_that_say_nothing_do_not_make_a_class():
    """Two groups of documents, judged by different labellers: the class is abuse and not the group."""
    patterns = {(1, 1, 0, 0): 9000, (-1, -1, 0, 0): 500, (-1, 1, 0, 0): 20, (0, 0, 1, 1): 4000, (0, 0, -1, -1): 300, (0, 0, -1, 1): 40, (0, 0, 0, 0): 700}
    bad, _ = w.fit_labellers(patterns)
    assert bad[1, 1, 0, 0] < 0.05 and bad[0, 0, 1, 1] < 0.05 and bad[0, 0, 0, 0] < 0.5
    assert bad[-1, -1, 0, 0] > 0.9 and bad[0, 0, -1, -1] > 0.9


def test_near_copies_teach_one_word():
    counts = {b"bad": (2, 2), b"badx": (0, 0), b"copied ": (0, 0), b"alone": (0, 0)}
    holders = [{b"bad": 4, b"badx": 1, b"copied ": 1}] * 9 + [{b"bad": 2}] * 5 + [{b"alone": 1}] * 6
    assert w.abusive_words(counts, holders, (20, 300), (2000, 30_000), 11.0) == (b"bad", b"alone")


def test_learned_words_are_found_without_a_step_for_each_word():
    rng = np.random.default_rng(3)
    vocabulary = [b"bad", b"badly", b"ba", b"rot", b"rott", b"rotten", b"rotte", b"abad", b"xrot", b"x" * 500, b"bad" + b"y" * 500, "b\u00e4d".encode(), *(f"w{k}".encode() for k in range(300))]
    words = [vocabulary[k] for k in rng.integers(0, 12, 200).tolist() + rng.integers(0, len(vocabulary), 20_000).tolist()]
    for entries in ((b"bad", b"rott", b"rot ", b"badly", b"rotten "), (b"rot ",), (b"ba", b"b\xc3", b"xrot "), ()):
        lexicon = w.Lexicon(entries, 0.02, 0.001)
        want = sum(any(x.startswith(e) if not e.endswith(b" ") else x + b" " == e for e in entries) for x in words)
        assert lexicon.hits(words) == want and lexicon.hits([b"rot"] * 7) == 7 * (b"rot " in entries) and lexicon.hits([]) == 0

    class Counting(frozenset):
        asked = 0

        def __contains__(self, word):
            Counting.asked += 1
            return super().__contains__(word)

    lexicon = w.Lexicon((b"bad", b"rott", b"rot "), 0.02, 0.001)
    lexicon.entries = Counting(lexicon.entries)
    assert lexicon.hits(words) > 0 and Counting.asked < len(words) / 100
