import numpy as np
import pytest

from shelfspark.llm import audio_chroma as c


def brute(rows, every):
    """All pairs of recordings, all offsets, no index."""
    ints = [(i, c.packed_integers(c.chroma(c.melody(v)))) for i, v in rows]
    classes = {}
    for i, x in ints:
        classes.setdefault(x.tobytes(), []).append(i)
    name = lambda ids: min((i for i in ids if i is not None), default=None)
    out = set()
    for q, a in ints:
        if q is None or q % every:
            continue
        own = classes[a.tobytes()]
        out.add((q, name(own), len(own), 0, 0, 0.0))
        for key, ids in classes.items():
            if key == a.tobytes():
                continue
            b, votes = np.frombuffer(key, np.uint32), {}
            for i in range(len(a)):
                for j in np.flatnonzero(b == a[i]):
                    votes[j - i] = votes.get(j - i, 0) + 1
            if not votes:
                continue
            at, n = min(votes.items(), key=lambda x: (-x[1], x[0]))
            pairs = [(a[i], b[i + at]) for i in range(len(a)) if 0 <= i + at < len(b)]
            error = round(sum(bin(int(x) ^ int(y)).count("1") for x, y in pairs) / (32 * len(pairs)), 6)
            if n >= c.LEAST_VOTES and error <= c.MOST_BIT_ERROR:
                out.add((q, name(ids), len(ids), int(at), n, error))
    return sorted(out, key=str)


@pytest.fixture
def melodies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=40).tolist()
    rows = [(k, rng.normal(size=20).tolist()) for k in range(1, 25)]
    rows += [(100, base), (200, base[8:30]), (30, rng.normal(size=6).tolist() + base[4:]), (31, base), (None, base), (None, base[:25]), (32, [0.1] * 40), (300, [0.1] * 25)]
    rows += [(400, None), (33, []), (34, [float("nan"), None, float("inf")]), (200, base[8:30])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_alignments_match_brute_force(melodies, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_INTEGERS", block)
    monkeypatch.setattr(c, "MEETINGS", 50)
    rows, df = melodies
    got = sorted((tuple(r) for r in c.align_recordings(df, "vec_id", "embedding", c.melody).collect()), key=str)
    assert got == brute(rows, 100)
    assert any(g[3] != 0 for g in got)


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(100, [0.5] * 30, 1, "x", 2)], "vec_id long, embedding array<double>, ints int, class_hash string, own int")
    assert [tuple(r) for r in c.align_recordings(df, "vec_id", "embedding", c.melody).collect()] == [(100, 100, 1, 0, 0, 0.0)]
    assert c.align_recordings(df.limit(0), "vec_id", "embedding", c.melody).count() == 0
