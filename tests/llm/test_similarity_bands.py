from collections import defaultdict

import numpy as np

from shelfspark.llm import bands
from shelfspark.llm import golay_simhash as g

from .test_golay_simhash import brute_fingerprint


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(texts):
    """Smallest id reachable over pairs at 0.8 or more, or at three bits or fewer."""
    sets, holders, shared = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    ids = sorted(texts)
    fps = np.array([brute_fingerprint(texts[i], 5) for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    links += [(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_components_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(docs, width=5, similarity=0.8).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = brute_components(texts)
    narrow = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(docs, width=5).collect()}
    wrong = {i: (got[i], expected[i]) for i in texts if got[i] != expected[i]}
    print(len(texts), len(set(narrow.values())), len(set(got.values())), len(set(expected.values())))
    assert not wrong


def test_edited_copies_link_and_others_do_not(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{base}x{i}" for i in range(300)]
        rows.append((n, " ".join(words)))
        for k in range(4):
            edited = list(words)
            for at in rng.choice(300, 5, replace=False):
                edited[at] = f"new{n}at{at}"
            rows.append((n + k + 1, " ".join(edited)))
        rows.append((n + 5, " ".join(words[150:] + [f"other{n}n{i}" for i in range(150)])))
        n += 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(docs, width=5, similarity=0.8).collect()}
    assert got == brute_components(dict(rows))
    assert all(got[i + 5] == i + 5 for i in range(0, n, 6))


def test_bands_find_pairs_at_the_bound():
    rng, met = np.random.default_rng(2), 0
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 900, np.int64).view(np.uint64)
        a, b = h[:800], np.concatenate([h[:711], h[800:889]])  # 711 of 889 shared: 0.8
        assert bands.similarity_of(bands.shingle_set(a), bands.shingle_set(b)) > 0.79
        met += any(x == y for x, y in zip(bands.band_keys(a), bands.band_keys(b), strict=True))
    assert met >= 294


def test_odd_rows_with_similarity(odd_docs, no_docs):
    rows = g.near_duplicates(odd_docs, width=5, similarity=0.8).collect()
    assert len(rows) == odd_docs.count()
    zero = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {1}
    assert len({r["component_id"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert g.near_duplicates(no_docs, width=5, similarity=0.8).count() == 0


def edited(words, k, tag, rng):
    """``k`` words replaced, five apart at least."""
    out = list(words)
    for at in rng.choice(len(words) // 5 - 2, k, replace=False) * 5 + 5:
        out[at] = f"{tag}at{at}"
    return out


def all_pairs_components(docs, met_only=False):
    """Smallest id reachable over pairs at 0.8 or more (``met_only``: that share a band) or three bits, by a presence matrix."""
    ids, sets, keys = sorted(docs), {}, {}
    for i in ids:
        hashes = np.concatenate(list(g.shingle_hashes(docs[i], 5)))
        sets[i], keys[i] = np.unique(hashes), np.array(bands.band_keys(hashes))
    vocabulary = {h: k for k, h in enumerate(np.unique(np.concatenate(list(sets.values()))).tolist())}
    held = np.zeros((len(ids), len(vocabulary)), np.float32)
    for row, i in enumerate(ids):
        held[row, [vocabulary[h] for h in sets[i].tolist()]] = 1
    shared, size = held @ held.T, held.sum(axis=1)
    link = shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-3
    if met_only:
        every = np.stack([keys[i] for i in ids])
        link &= np.any(np.stack([every[:, None, b] == every[None, :, b] for b in range(bands.BANDS)]), axis=0)
    fps = np.array([brute_fingerprint(docs[i], 5) for i in ids], np.uint64)
    link |= np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(ids))
    while True:
        new = np.where(link, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return {i: ids[label[row]] for row, i in enumerate(ids)}
        label = new


def test_an_original_links_its_copies_at_any_number(spark):
    rng, texts, lost = np.random.default_rng(11), {}, 0
    for base, n in enumerate((20, 100, 500, 1000)):
        words = [f"w{base}x{i}" for i in range(300)]
        first = 10_000 * base
        for k in range(n + 1):
            texts[first + k] = " ".join(words if k == n // 2 else edited(words, int(rng.integers(4, 7)), f"b{base}n{k}", rng))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(docs, width=5, similarity=0.8).collect()}
    expected = {}
    for base in range(4):
        group = {i: t for i, t in texts.items() if i // 10_000 == base}
        assert len(set(all_pairs_components(group).values())) == 1
        expected |= all_pairs_components(group, met_only=True)
    lost = len(set(expected.values())) - 4
    assert lost <= 4  # of 1,620 copies, those that share no band with anything similar
    assert got == expected


def test_pairs_away_from_the_hub_link(spark, monkeypatch):
    monkeypatch.setattr(bands, "BLOCK", 16)
    rng, texts = np.random.default_rng(12), {}
    words = [f"w{i}" for i in range(300)]
    for k in range(60):  # copies of a text that is not there are about 0.73 alike; each has a twin at 0.87
        one = edited(words, 5, f"n{k}", rng)
        texts[2 * k], texts[2 * k + 1] = " ".join(one), " ".join(edited(one, 4, f"t{k}", rng))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(docs, width=5, similarity=0.8).collect()}
    expected = all_pairs_components(texts, met_only=True)
    assert len(set(expected.values())) > 20
    assert got == expected
