"""Links between texts by the Jaccard similarity of their shingle sets: MinHash bands find the pairs, the whole sets decide.

SimHash fingerprints of texts at a similarity of 0.8 differ in about ten of 64 bits, beyond the reach of Golay keys. Twelve
bands of four minima meet with a probability of 0.998 at 0.8. A band's members first meet its hub, the member with the most
company in all its bands; pairs of a band that are still in different components then meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BANDS, ROWS = 12, 4
#: Expected members on each side of a block; a block holds their whole sets.
BLOCK = 256
_draw = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), np.int64).view(np.uint64)
_FLIP, _ODD = _draw[0][:, None], _draw[1][:, None] * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, block: int = 4096) -> list[int]:
    """One key a band from 64-bit shingle hashes; none for no shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), block):
        least = np.minimum(least, ((hashes[None, lo : lo + block] ^ _FLIP) * _ODD).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_set(hashes: np.ndarray) -> bytes:
    """The sorted set of the hashes' upper halves; equal halves of different shingles are rarer than one in a thousand texts."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()


def similarity_of(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similarity_of(a, b) >= similarity for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")  # an end of many pairs is split by AQE
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def forest(sets: list[bytes], roots: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of pairs of side 0 and side 1 that keep the components of all pairs at least so similar; equal roots are joined already."""
    held = [np.frombuffer(s, np.uint32) for s in sets]
    sizes = np.array([len(x) for x in held])
    words, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(held)), sizes)
    _, label = np.unique(roots, return_inverse=True)
    label, right, out = label.copy(), sides == 1, []
    for i in np.flatnonzero(sides == 0):
        open_ = right & (label != label[i])
        if not open_.any():
            continue
        mark = np.zeros(len(words), bool)
        mark[place[starts[i] : starts[i + 1]]] = True
        shared = np.bincount(owner[mark[place]], minlength=len(held))
        for j in np.flatnonzero(open_ & (shared >= similarity * np.maximum(1, sizes + sizes[i] - shared))):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def _other_links(members: DataFrame, hubs: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of the pairs of a band that are in different components, but for those with its hub, which are known."""
    own = members.join(hubs, "key").where("fp <> hub").join(roots.toDF("fp", "root"), "fp", "left")
    own = cut(own.select("key", "fp", F.coalesce("root", "fp").alias("root")))
    mixed = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    m = F.col("m")
    dealt = own.join(mixed.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("m")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), m).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "root")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[1].as_py() == key[2].as_py():  # a part against itself
            table = pa.concat_tables([table, table.set_column(table.schema.get_field_index("side"), "side", pa.array(np.ones(len(table), np.int32)))])
        fps = table.column("fp").to_numpy()
        found = forest(table.column("shingles").to_pylist(), table.column("root").to_numpy(), table.column("side").to_numpy(), similarity)
        return pa.table({"u": pa.array([int(fps[a]) for a, _ in found], pa.int64()), "v": pa.array([int(fps[b]) for _, b in found], pa.int64())})

    return cells.join(sets, "fp").groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def similar_links(units: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``links`` and, up to components, the links between units ``(fp, keys)`` that share a band and whose sets are at least so similar.

    ``sets_of`` gives the sets ``(fp, shingles)`` of the units that meet another one; no other set is moved. First each unit
    is held against the hub it shares most bands with, then against its other hubs, then all pairs of a band that are still
    in different components are compared. What is joined already need not be compared again.
    """
    rows = units.select("fp", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(met, "key"))
    company = members.groupBy("fp").agg(F.sum("n").alias("company"))
    hubs = cut(members.join(company, "fp").groupBy("key").agg(F.max(F.struct("company", "fp")).alias("most")).select("key", F.col("most.fp").alias("hub")))
    members = members.select("fp", "key")
    pairs = cut(members.join(hubs, "key").where("fp <> hub").groupBy("fp", "hub").agg(F.count("*").alias("bands")))
    sets = cut(sets_of(members.select("fp").distinct()))
    best = pairs.groupBy("fp").agg(F.max(F.struct("bands", "hub")).alias("best")).select(F.col("fp").alias("u"), F.col("best.hub").alias("v"))
    links = cut(links.select("u", "v").unionByName(_verified(best, sets, similarity)))
    roots = cut(components(links))
    placed = pairs.select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v")).distinct()
    placed = placed.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left")
    rest = placed.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
    links = cut(links.unionByName(_verified(cut(rest), sets, similarity)))
    roots = cut(components(links))
    return links.unionByName(_other_links(members, hubs, roots, sets, similarity)).distinct()
