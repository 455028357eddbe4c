"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each read as a 23-bit word of the perfect binary Golay code (23, 12, 7).
Every word lies within three bits of one codeword; words at distance three have five more codewords at distance four. If
two fingerprints differ in at most three bits, the pigeonhole leaves two segments with at most one differing bit each, and
then the codeword of one side is among the six nearby codewords of the other. Each fingerprint therefore posts
``(codeword of i, nearby codewords of j)`` on the left and ``(nearby codewords of i, codeword of j)`` on the right for the
three segment pairs; a join on the 24-bit key finds every such pair, and the bit count verifies it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import band_keys, shingle_set, similar_links
from .common import cut
from .components import components

#: The generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the (23, 12, 7) code.
GENERATOR = 0xC75
#: (shift, width) of the fingerprint's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 3
HASH_SEED = 42
#: Keys whose left x right pairs exceed this are compared in blocks; the bound only picks the route, both are exact.
PAIRS_PER_KEY = 4096
BLOCK_ROWS = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words, and per syndrome the patterns (nearest first, -1 padded) leading to codewords within four bits."""
    unit = [_remainder(1 << b) for b in range(23)]
    leader = np.zeros(2048, np.int64)
    for a in range(23):
        leader[unit[a]] = 1 << a
        for b in range(a):
            leader[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                leader[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    near = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        others = {int((1 << b) ^ leader[s ^ unit[b]]) for b in range(23)} - {int(leader[s])}
        patterns = [int(leader[s]), *sorted(p for p in others if bin(p).count("1") <= 4)]
        near[s, : len(patterns)] = patterns
    return np.array(unit, np.int64), near


def segment_keys(segment: np.ndarray, unit: np.ndarray, near: np.ndarray) -> np.ndarray:
    """12-bit codeword indices (n, 6) near each 23-bit word, the nearest first, -1 where there are fewer."""
    syndrome = np.zeros(len(segment), np.int64)
    for b in range(23):
        syndrome ^= np.where(segment >> b & 1, unit[b], 0)
    patterns = near[syndrome]
    return np.where(patterns < 0, -1, (segment[:, None] ^ patterns) >> 11)


def shingle_hashes(text: str | None, width: int = 3, block: int = 65536) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text in blocks; fewer words than the width make one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts, ends = [0, *(ends[:-1] + 1).tolist()], ends.tolist()
    width, digest = min(width, len(words)), xxhash.xxh64_intdigest
    total = len(words) - width + 1
    for lo in range(0, total, block):
        hi = min(total, lo + block)
        yield np.array([digest(flat[s:e], HASH_SEED) for s, e in zip(starts[lo:hi], ends[lo + width - 1 : hi + width - 1])], "<u8")


def folded(blocks: Iterable[np.ndarray]) -> int:
    """SimHash of shingle hashes; zero for none."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3, block: int = 65536) -> int:
    """SimHash of the word shingles of a text; zero for a text without words. Works in blocks, so memory follows the text only."""
    return folded(shingle_hashes(text, width, block))


#: Optional column of fingerprints(): its type here and in Arrow, and how it is made from the hashes.
_EXTRA = {"keys": ("array<long>", pa.list_(pa.int64()), band_keys), "shingles": ("binary", pa.binary(), shingle_set)}


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None, tag: Column | None = None) -> DataFrame:
    """``(doc_id, fp)`` per row; fp is the 64-bit pattern as a signed long.

    ``extra`` adds unit, which stands for the set of shingles, and band "keys" or the set itself ("shingles"); ``tag`` is a
    string that goes along.
    """
    sql_type, arrow_type, make = _EXTRA.get(extra, (None, None, None))
    names = ["doc_id", "fp", *["unit", extra] * bool(extra), *["tag"] * (tag is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, units, more = [], [], []
            for text in batch.column(1).to_pylist():
                blocks = shingle_hashes(text, width)
                if make:
                    blocks = list(blocks)
                    hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                    units.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    more.append(make(hashes))
                fps.append(folded(blocks))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if make:
                columns += [pa.array(np.array(units, np.uint64).view(np.int64)), pa.array(more, arrow_type)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[] if tag is None else [tag.cast("string").alias("tag")])
    return rows.mapInArrow(run, "doc_id long, fp long" + (f", unit long, {extra} {sql_type}" if extra else "") + (", tag string" if tag is not None else ""))


def _postings(fps: DataFrame) -> DataFrame:
    """``(key, side, fp)``: about 32 rows for each distinct fingerprint."""
    unit, near = golay_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            keys = [
                segment_keys((bits >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64), unit, near) for s, w in SEGMENTS
            ]
            for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                for side, (a, b) in enumerate(((keys[i][:, :1], keys[j]), (keys[i], keys[j][:, :1]))):
                    a, b = np.broadcast_arrays(a, b)
                    row, col = np.nonzero((a >= 0) & (b >= 0))
                    key = pair << 24 | a[row, col] << 12 | b[row, col]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.astype(np.int32)), pa.array(np.full(len(row), side, np.int8)), pa.array(fp[row])],
                        names=["key", "side", "fp"],
                    )

    return fps.select("fp").mapInArrow(run, "key int, side byte, fp long")


def block_forest(left: np.ndarray, right: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that keep the components of the left x right comparison: one per node below its smallest mate."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    close = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= max_bits
    label, far = np.arange(len(nodes)), len(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, b, np.where(close, label[a][:, None], far).min(axis=0))
        np.minimum.at(new, a, np.where(close, new[b][None, :], far).min(axis=1))
        if (new == label).all():
            return [(int(nodes[i]), int(nodes[label[i]])) for i in np.flatnonzero(label != np.arange(len(nodes)))]
        label = new


def _block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    side = table.column("side").to_numpy()
    fp = table.column("fp").to_numpy()
    links = block_forest(fp[side == 0], fp[side == 1]) if (side == 0).any() and (side == 1).any() else []
    return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints with the components of "at most three bits apart".

    Frequent keys are not capped: their rows go to ``m x m`` blocks of bounded size, and each block returns a spanning
    forest, so the links grow with the rows and not with the pairs.
    """
    posts = _postings(distinct)
    sizes = posts.groupBy("key").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("l"), F.sum("side").alias("r")
    )
    heavy = cut(
        sizes.where(F.col("l") * F.col("r") > PAIRS_PER_KEY).select(
            "key", F.ceil(F.greatest("l", "r") / F.lit(BLOCK_ROWS)).cast("int").alias("m")
        )
    )
    n_heavy = heavy.count()
    side = F.broadcast(heavy) if n_heavy <= 200_000 else heavy  # twelve bytes a key: at most 3 MB
    light = posts.join(side.select("key"), "key", "left_anti") if n_heavy else posts
    left = light.where("side = 0").select("key", F.col("fp").alias("u"))
    right = light.where("side = 1").select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    links = left.join(right, "key").where((F.col("u") < F.col("v")) & near).select("u", "v")
    if n_heavy:
        own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
        others = F.sequence(F.lit(0), F.col("m") - 1)
        cells = (
            posts.join(side, "key")
            .select("key", "side", "fp", own.alias("own"), F.explode(others).alias("other"))
            .select(
                "key",
                F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"),
                F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"),
                "side",
                "fp",
            )
        )
        links = links.unionByName(cells.groupBy("key", "i", "j").applyInArrow(_block_links, "u long, v long"))
    return links.distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, tag: Column | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id, root)`` per row of docs, and ``tag``, a string of the row that goes along.

    Fingerprints of the lower-cased word shingles link at three or fewer differing bits; component_id is the smallest id
    reachable, and root stands for the component (rows without id have one, too). NULL and empty texts have fingerprint zero
    and link like any other; very long texts are hashed in blocks; repeated rows stay and share a component; an empty table
    gives no rows; other columns are ignored. A NULL id is kept and never becomes a component id unless its whole component
    has none. Equal texts meet once before any link is sought, so groups of exact copies cost one row. With ``similarity``,
    texts whose sets of shingles are at least so similar link as well (see bands).
    """
    rows = cut(fingerprints(docs, width, id_col, text_col, None if similarity is None else "keys", tag))
    if similarity is None:
        node = "fp"
        distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")))
        links = fingerprint_links(distinct)
    else:
        node = "unit"
        least = rows.groupBy("unit").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "keys")).alias("one"))
        distinct = cut(least.select("unit", "one.fp", F.col("one.doc_id").alias("doc"), "one.keys"))
        first = distinct.groupBy("fp").agg(F.min("unit").alias("first"))
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

        def sets_of(wanted: DataFrame) -> DataFrame:
            owners = distinct.join(wanted.select(F.col("fp").alias("unit")), "unit", "left_semi").select("unit", "doc")
            held = texts.join(owners, texts["doc_id"].eqNullSafe(owners["doc"]), "left_semi")
            sets = fingerprints(held, width, extra="shingles").join(owners.select("unit"), "unit", "left_semi")
            return sets.dropDuplicates(["unit"]).select(F.col("unit").alias("fp"), "shingles")

        near = fingerprint_links(distinct.select("fp").distinct())
        near = near.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        same = distinct.join(first, "fp").where("unit <> first").select(F.col("unit").alias("u"), F.col("first").alias("v"))
        links = similar_links(distinct.select(F.col("unit").alias("fp"), "keys"), near.unionByName(same), sets_of, similarity)
    roots = components(links)
    placed = distinct.join(roots.withColumnRenamed("node", node), node, "left").select(node, "doc", F.coalesce("root", node).alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    member = cut(placed.join(least, "root").select(node, "component_id", "root"))
    return rows.join(member, node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", *[] if tag is None else ["tag"])
