import itertools

import numpy as np
import xxhash

from shelfspark.llm import golay_simhash as g


def brute_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids_fps):
    ids, fps = zip(*ids_fps, strict=True)
    a = np.array(fps, np.uint64)
    label = np.array(ids)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    while True:
        new = np.where(close, label[None, :], 1 << 62).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, new.tolist(), strict=True))
        label = new


def test_code_has_distance_seven_and_covers_all_words():
    unit, near = g.golay_tables()
    words = np.arange(1 << 12) << 11
    code = words ^ np.array([g._remainder(int(w)) for w in words])
    assert min(bin(int(c)).count("1") for c in code[1:]) == 7
    keys = g.segment_keys(np.arange(5000, dtype=np.int64), unit, near)
    index = {int(c) >> 11: int(c) for c in code}
    for x in range(0, 5000, 97):
        expected = {i for i, c in index.items() if bin(c ^ x).count("1") <= 4}
        assert {int(k) for k in keys[x] if k >= 0} == expected


def test_all_pairs_within_three_bits_share_a_key(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    for x in base:
        fps = [x] + [x ^ sum(1 << b for b in bits) for bits in itertools.islice(itertools.combinations(range(64), 3), 0, None, 211)]
        signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
        df = spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long")
        linked = {frozenset(r) for r in g.fingerprint_links(df).collect()}
        from shelfspark.llm.components import components

        roots = {r["node"]: r["root"] for r in components(g.fingerprint_links(df)).collect()}
        assert len(set(roots.values())) == 1 and len(roots) == len(set(signed)) and linked


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in g.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(sorted(fps.items()))
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in texts}


def test_block_route_gives_the_same_components(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = sorted(g.near_duplicates(docs).collect())
    monkeypatch.setattr(g, "PAIRS_PER_KEY", 0)
    monkeypatch.setattr(g, "BLOCK_ROWS", 2)
    assert sorted(g.near_duplicates(docs).collect()) == plain


def test_odd_rows(odd_docs, no_docs):
    rows = g.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[None, zero] == by[1, zero] == by[2, zero] == by[5, zero] == 1
    assert len({r["component_id"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert g.near_duplicates(no_docs).count() == 0
