import hashlib
import os
import random
import time
from collections import Counter

import corpus_pipeline as p
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, root long"


@pytest.fixture
def odd(spark):
    """NULL and equal ids with different texts, empties, repeated rows, a long text, and clashing columns."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = text(200).split()
    near = " ".join([*base[:100], "edit", *base[101:]])
    rows = [(None, text(60), "en", "a"), (None, text(61), None, "a"), (None, text(62), "en", None), (7, text(63), "en", "b"), (7, text(64), "en", "b")]
    rows += [(8, " ".join(base), "en", "b"), (9, near, "en", "b"), (10, near, "en", "b"), (10, near, "en", "b"), (11, None, "en", "a"), (12, "", "en", "a"), (None, " \n", "en", "a")]
    rows += [(13, text(30_000), "en", "c"), (14, text(40), "de", ""), (15, text(90), "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 5) for i, t, lang, s in rows], SCHEMA).repartition(3)


def rows_of(df):
    assert tuple(df.columns) == p.COLUMNS
    return [tuple(r) for r in df.collect()]


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_keeps_one_row_of_each_group(spark, odd):
    docs = [tuple(r) for r in odd.select(*p.COLUMNS).collect()]
    got = rows_of(p.near_dedup_stage(spark, odd, ""))
    groups = []
    for d in docs:
        own = shingles(d[1])
        for g in groups:
            other = shingles(g[0][1])
            if own == other or own & other and len(own & other) >= 0.8 * len(own | other):
                g.append(d)
                break
        else:
            groups.append([d])
    assert len(got) == len(groups) == 10
    for g in groups:
        ids = [d[0] for d in g if d[0] is not None]
        kept = [d for d in got if d in g]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_near_dedup_leaves_no_shuffle_files_of_its_steps(spark, odd):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffle_files(spark)
    stage = p.near_dedup_stage(spark, odd, "")  # some thirty steps; what remains to be done is the last
    assert spark.conf.get(name) == setting
    until = time.time() + 20  # executors remove files in their own time
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert stage.count() == stage.count() == 10  # what is left to the caller can run again


def test_substring_stage_keeps_other_documents_whole(spark, odd):
    docs = [tuple(r) for r in odd.select(*p.COLUMNS).collect()]
    words = [(d[1] or "").split() for d in docs]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for d, w in zip(docs, words, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if kept:
            want.append((d[0], kept, d[2], d[3], len(kept)))
    assert sorted(rows_of(p.substring_stage(spark, odd, "")), key=str) == sorted(want, key=str)


def test_mixing_meets_every_target_and_knows_rows_apart(spark, odd):
    docs = [tuple(r) for r in odd.select(*p.COLUMNS).collect()]
    got = rows_of(p.mixing_stage(spark, odd, ""))
    size = lambda t: len((t or "").split())
    have, target = Counter(), {}
    for d in docs:
        have[d[3]] += size(d[1])
    names = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, left = set(names), sum(have.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * have[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3 * have[s] for s in full}
        left -= sum(3 * have[s] for s in full)
        open_ -= set(full)
    mixed = Counter()
    for d in got:
        mixed[d[3]] += size(d[1])
    for s in names:
        assert abs(mixed[s] - target[s]) <= 1, s
    whole = Counter(d for d in got if d in docs)
    copies = Counter(docs)
    assert all(n <= 3 * copies[d] for d, n in whole.items())
    cut = [d for d in got if d not in docs]
    assert len(cut) <= len(names)
    for d in cut:
        assert d[4] == len(d[1]) and any(o[0] == d[0] and o[2:4] == d[2:4] and (o[1] or "").split()[: size(d[1])] == d[1].split() for o in docs)


def test_encoding_stage(spark, odd):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd.collect():
        ids = model.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted(map(tuple, p.encoding_stage(spark, odd, "").collect()), key=str) == sorted(want, key=str)


def test_quality_stage_drops_junk_and_keeps_the_rest(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.limit(400).unionByName(docs.where("doc_id < 3").withColumn("doc_id", docs["doc_id"] * 0 + 1).withColumn("lang", docs["lang"]))
    docs = docs.unionByName(docs.where("doc_id = 5").selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    got = p.quality_stage(spark, docs, d)
    assert tuple(got.columns) == p.COLUMNS and 0.8 * docs.count() < got.count() <= docs.count()
    assert got.exceptAll(docs.select(*p.COLUMNS)).count() == 0


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0


def test_whole_pipeline(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
