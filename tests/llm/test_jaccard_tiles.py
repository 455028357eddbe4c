import numpy as np
import pytest

from shelfspark.llm import jaccard_tiles as j
from shelfspark.llm import queries


def shingles(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < width:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width=4, percent=85):
    """(doc_id, size, smallest id reachable) of (doc_id, text) rows."""
    sets = [shingles(t, width) for _, t in rows]
    ids, units = {}, sorted({s for s in sets if s}, key=len)
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            ids[s] = min(i, ids.get(s, i))
    root = list(range(len(units)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(units):
        met = {}
        for t in s:
            for o in holders.setdefault(t, []):
                met[o] = met.get(o, 0) + 1
            holders[t].append(k)
        for o, shared in met.items():
            if 100 * shared >= percent * (len(s) + len(units[o]) - shared):
                root[find(k)] = find(o)
    place, least = {s: k for k, s in enumerate(units)}, {}
    for s, k in place.items():
        if s in ids:
            least[find(k)] = min(ids[s], least.get(find(k), ids[s]))
    return sorted(((i, len(s), least.get(find(place[s])) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def compare(df, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(map(tuple, j.jaccard_join(df, **kw).collect()), key=str)
    assert got == brute(rows, **kw)
    return got


def edited(rng, words, k):
    out = list(words)
    for at in rng.choice(len(out), k, replace=False):
        out[at] = f"x{rng.integers(10**6)}"
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(map(tuple, queries.QUERIES["op11_jaccard_tiles"](spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == want and sum(c != i for i, _, c in got) > 50


@pytest.fixture
def chains(spark):
    """Near copies at all similarities around the bar, a chain of edits, a common passage and groups of copies."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    docs, passage = [], word(60)
    for n in (5, 9, 10, 17, 40, 120, 700):
        base = word(n)
        docs += [base, *[edited(rng, base, int(k)) for k in range(0, max(2, n // 12))], base[: n - 1], base + word(max(1, n // 10)), base + word(max(1, n // 5))]
    at = word(300)
    for _ in range(30):  # each links to the next only
        docs.append(at)
        at = edited(rng, at, 4)
    docs += [word(int(rng.integers(0, 40))) + passage + word(int(rng.integers(0, 40))) for _ in range(60)]
    base = word(200)
    docs += [edited(rng, base, int(rng.integers(1, 9))) for _ in range(150)] + [base] * 40
    docs += [["same"] * k for k in range(1, 9)] + [["a", "b", "c"], ["a", "b", "c"], ["A", "b", "C"]]
    return spark.createDataFrame([(int(i), " ".join(d)) for i, d in zip(rng.permutation(len(docs)), docs, strict=True)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_links_around_the_bar(chains, monkeypatch, small):
    if small:  # many blocks, many frequent shingles, no list of tags held by the tasks
        for name, value in (("BLOCK", 7), ("SAMPLED", 2), ("FREQUENT", 2), ("LISTED", 50), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(j, name, value)
    compare(chains)


def test_other_widths_and_bars(chains):
    compare(chains, width=2, percent=60)


def test_odd_rows(spark, odd_docs, no_docs):
    got = compare(odd_docs)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0, 1), (2, 0, 2)]
    assert j.jaccard_join(no_docs).count() == 0
    assert j.jaccard_join(odd_docs.where("text is null")).count() == 2


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, d = int(rng.integers(6, 900)), rng.integers(0, 2**63, 2000).astype(np.uint64)
        a, b = np.unique(d[:n]), np.unique(np.concatenate([d[: n - n // 12], d[1500 : 1500 + int(rng.integers(0, n // 12 + 1))]]))
        shared = len(np.intersect1d(a, b))
        x, y = (j.bitmap(s, j.bits_of(len(s), 85)) for s in (a, b))
        w = min(len(x), len(y))
        differing = int(np.bitwise_count(j.folded(x, w) ^ j.folded(y, w)).sum())
        assert (len(a) + len(b) - differing) // 2 >= shared
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert abs(j.band_of(len(a), 85) - j.band_of(len(b), 85)) <= 1 and j.may_link(len(a), len(b), differing, 85)
            assert shared >= j.needed(len(a), len(b), 85)
