"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Equal sets of shingles are one unit. Linked sets have sizes within the similarity of each other, so with bands that grow by
this ratio a unit meets its own band and the next one only. Two linked sets share a shingle among the first few of each in
any common order (the smaller's few are fewer still); tiles are the units of two neighbouring bands that share such a
shingle. The order puts shingles that many documents hold last, so common passages make no large tiles. In a tile each unit
has a bitmap of twice its band's size with one bit flipped for each shingle: the bits in which two bitmaps differ are at
least as many as the shingles in which the sets do not, which bounds the overlap from above. What passes is decided on the whole
sorted sets. Only components are asked for, so the units of a shingle first meet its hub, the one that shares the largest part
of its leading shingles. Tiles then hold a shingle's units outside its largest component on the left and all of its units on
the right; pairs that are joined already are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder
from .components import components
from .words import groups, mixed

#: One text in SAMPLED tells which shingles are frequent; it fixes an order only, so no result depends on it.
SAMPLED, FREQUENT, LISTED = 64, 8, 1 << 16
#: Expected members on a side of a tile; their bitmaps are a few hundred kilobytes.
BLOCK = 1024
#: Tiles are compared by bitmaps folded to this part of their width; what these let pass is compared by the whole bitmaps.
FOLDED = 4
#: Rows (tags of 16 bytes and a unit) that a task may hold to pick texts from.
BROADCAST_ROWS = 500_000


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b: percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


def band_of(n: int, percent: int) -> int:
    """Linked sizes are in the same or in neighbouring bands."""
    return int(math.log(n) / (math.log(100 / percent) * (1 + 1e-9)))


def bits_of(n: int, percent: int) -> int:
    """Bits of the bitmaps of a band: a power of two, at least twice the band's largest size."""
    top = (100 / percent) ** (band_of(n, percent) + 1)
    return max(64, 1 << math.ceil(math.log2(2 * top)))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that few sets and texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits; a bit is set if an odd number of shingles falls on it."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) brought to a smaller width: bits that fall together are added modulo two."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text; fewer words than the width make one shingle."""
    for group in groups(column, lower=True):
        h = group.hashes()
        rolled = h
        for k in range(1, width):
            rolled = mixed(rolled[: max(0, len(h) - k)] + np.uint64(0x9E3779B97F4A7C15)) ^ h[k:]
        rolled = mixed(rolled)
        for lo, hi in zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True):
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                yield np.array([xxhash.xxh64_intdigest(h[lo:hi].tobytes(), hi - lo)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def ordered(hashes: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the common order, and how many of it stand before the frequent ones."""
    if not len(hot):
        return hashes, len(hashes)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    is_hot = hot[at] == hashes
    late = hashes[is_hot]
    return np.concatenate([hashes[~is_hot], late[np.argsort(rank[at[is_hot]])]]), len(hashes) - len(late)


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("*", F.xxhash64("text").alias("tag1"), F.xxhash64(F.lit(7), "text").alias("tag2"))


def frequent_shingles(tagged: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles most frequent in a sample of the distinct texts, LISTED at most, and their ranks, rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    some = tagged.where(F.pmod("tag1", F.lit(SAMPLED)) == 0).groupBy("tag1", "tag2").agg(F.first("text").alias("text")).select("text")
    counted = some.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "token").limit(LISTED).collect()
    hot = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def shingle_rows(tagged: DataFrame, width: int, percent: int, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Per text its set's size and digest, the leading shingles (``own`` of them as the smaller of a pair, ``cold`` not frequent) and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1024):
            out: list[list] = [[] for _ in range(8)]
            for s in text_sets(batch.column(1), width):
                n, digest = len(s), xxhash.xxh128_digest(s.tobytes())
                row, cold = (s, 0) if not n else ordered(s, hot, rank)
                lead = n and n - needed(n, -(-percent * n // 100), percent) + 1
                own = n and n - needed(n, n, percent) + 1
                bits = bitmap(s, bits_of(n, percent)) if n else np.zeros(0, np.uint64)
                values = (n, *np.frombuffer(digest, "<i8").tolist(), row[:lead].view(np.int64), own, cold, bits.tobytes(), folded(bits, max(1, len(bits) // FOLDED)).tobytes())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays], names=["doc_id", "tag1", "tag2", "n", "h1", "h2", "lead", "own", "cold", "bits", "small"])

    return tagged.mapInArrow(run, "doc_id long, tag1 long, tag2 long, n long, h1 long, h2 long, lead array<long>, own int, cold int, bits binary, small binary")


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token first, sorted) whose token has another row and an ``own`` one; runs of rare tokens are short."""

    def shared(table: pa.Table) -> list[pa.RecordBatch]:
        token = table.column("token").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        good = (sizes > 1) & (np.add.reduceat(table.column("own").to_numpy().astype(np.int64), starts) > 0)
        return table.filter(pa.array(np.repeat(good, sizes))).to_batches()

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not len(table):
            continue
        token = table.column(0).to_numpy()
        last = len(token) - int(np.argmin(token[::-1] == token[-1])) if token[0] != token[-1] else 0
        held = table.slice(last)
        if last:
            yield from shared(table.slice(0, last))
    if held is not None and len(held):
        yield from shared(held)


def tile_members(units: DataFrame, leads: DataFrame) -> DataFrame:
    """``(token, u, n, own)``: units by those of their leading shingles that another unit leads with, too, one of them as the smaller of a pair."""
    posts = leads.join(units, "u").select("u", "n", "own", "cold", F.posexplode("lead").alias("pos", "token"))
    posts = posts.select("token", "u", "n", (F.col("pos") < F.col("own")).alias("own"), (F.col("pos") >= F.col("cold")).alias("hot"))
    # a frequent shingle is shared for sure: its rows need not meet to be told
    rare = posts.where("not hot").drop("hot").repartition("token").sortWithinPartitions("token").mapInArrow(_shared_runs, "token long, u long, n long, own boolean")
    return cut(rare.unionByName(posts.where("hot").drop("hot")))


def may_link(a, b, differing, percent: int):
    """Whether sets of sizes a and b whose bitmaps differ in so many bits can reach the similarity."""
    return (a + b - differing) // 2 >= needed(a, b, percent)


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v, shared)`` that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                width = min(len(x), len(y))
                keep.append(may_link(a, b, int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(3)], names=["u", "v", "shared"])

    side = bits.select("u", "n", "bits")
    both = pairs.join(side.toDF("u", "a", "x"), "u").join(side.toDF("v", "b", "y"), "v")
    return both.select("u", "v", "shared", "a", "b", "x", "y").mapInArrow(run, "u long, v long, shared long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sorted sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= needed(len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(2)], names=["u", "v"])

    both = pairs.select("u", "v").join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")  # an end of many pairs is split by AQE
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _sets_of(pairs: DataFrame, units: DataFrame, tagged: DataFrame, width: int) -> DataFrame:
    """``(u, shingles)`` of the units in the pairs, made from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            made = [s.tobytes() for s in text_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["u", "shingles"])

    ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    tags = cut(units.select("u", "tag1", "tag2").join(ends, "u", "left_semi"))
    tags = F.broadcast(tags) if tags.count() <= BROADCAST_ROWS else tags
    # copies of a text are brought to one before they are moved
    texts = tagged.join(tags, ["tag1", "tag2"]).groupBy("u").agg(F.first("text").alias("text"))
    return cut(texts.mapInArrow(run, "u long, shingles binary"))


#: Pairs of a tile that are held against each other in one go.
PAIRS = 1 << 15


def _in_width(bits: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
    return folded(np.frombuffer(b"".join(bits[k] for k in rows), "<u8").reshape(len(rows), -1), width)


def tile_pairs(cell: np.ndarray, rows: dict[str, np.ndarray], bits: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of pairs that are in different components and that the bitmaps do not rule out.

    Rows come tile by tile (``cell`` grows with the tile), those of the left side first. Two units that are both ``other``
    meet in two tiles and are taken in one of them.
    """
    n = len(cell)
    start, stop = np.searchsorted(cell, cell, "left"), np.searchsorted(cell, cell, "right")
    lefts = np.concatenate([[0], np.cumsum(~rows["right"])])
    first = start + lefts[stop] - lefts[start]
    count = np.where(rows["right"], 0, stop - first)
    words = np.array([len(b) // 8 for b in bits])
    done = 0
    totals = np.cumsum(count)
    while done < n:
        upto = max(done + 1, int(np.searchsorted(totals, (totals[done - 1] if done else 0) + PAIRS, "right")))
        own = np.arange(done, upto)
        a = np.repeat(own, count[own])
        b = np.arange(len(a)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + first[a]
        keep = (rows["root"][a] != rows["root"][b]) & (rows["own"][a] | rows["own"][b]) & (~rows["other"][b] | (rows["u"][a] < rows["u"][b]))
        a, b = a[keep], b[keep]
        low, high = np.minimum(rows["n"][a], rows["n"][b]), np.maximum(rows["n"][a], rows["n"][b])
        keep = low * 100 >= high * percent
        a, b = a[keep], b[keep]
        width = np.minimum(words[a], words[b])
        for w in np.unique(width).tolist():
            x, y = a[width == w], b[width == w]
            step = max(1, (1 << 19) // w)
            for lo in range(0, len(x), step):
                one, two = x[lo : lo + step], y[lo : lo + step]
                held, place = np.unique(np.concatenate([one, two]), return_inverse=True)
                m = np.empty((len(held), w), np.uint64)
                for own_width in np.unique(words[held]).tolist():
                    some = words[held] == own_width
                    m[some] = _in_width(bits, held[some], w)
                differing = np.bitwise_count(m[place[: len(one)]] ^ m[place[len(one) :]]).sum(axis=1, dtype=np.int64)
                good = may_link(rows["n"][one], rows["n"][two], differing, percent)
                yield one[good], two[good]
        done = upto


def _compared(percent: int):
    """Rows (token, tile, i, j, right, u, n, own, root, other, bits), sorted by tile, to pairs; a tile is held until its last row is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(k).to_numpy() for k in ("token", "tile", "i", "j")]
            new = np.zeros(len(table), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            rows = {name: table.column(name).to_numpy() for name in ("right", "u", "n", "own", "root", "other")}
            found = list(tile_pairs(np.cumsum(new), rows, table.column("bits").to_pylist(), percent))
            ends = [rows["u"][np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])] for k in range(2)]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["u", "v"])

        held = None
        for batch in _pieces(batches, 2048):
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            last = [table.column(k).to_numpy() for k in ("token", "tile", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in last])
            cut_at = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = table.slice(cut_at)
            if cut_at:
                yield pairs(table.slice(0, cut_at))
        if held is not None and len(held):
            yield pairs(held)

    return run


def _tile_candidates(members: DataFrame, roots: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of units of a shingle in different components that the folded bitmaps do not rule out."""
    own = members.join(roots.toDF("u", "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    own = own.withColumn("band", F.floor(F.log("n") / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int"))
    sizes = own.groupBy("token", "root").agg(F.count("*").alias("size"), F.max("own").alias("any"))
    open_ = sizes.groupBy("token").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("most"), F.max("any").alias("any"), F.count("*").alias("roots")).where("roots > 1 and any")
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    open_ = open_.select("token", F.col("most.root").alias("largest"), parts(F.col("size") - F.col("most.size")).alias("lefts"), parts(F.col("size")).alias("rights"))
    dealt = own.join(open_, "token").withColumn("other", F.col("root") != F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("u"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda band, i, j, right: F.struct(band.cast("int").alias("tile"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(right).alias("right"))
    right = F.transform(upto(F.col("lefts")), lambda i: cell(F.col("band"), i, place(F.col("rights")), True))
    left = F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda t: F.transform(upto(F.col("rights")), lambda j: cell(F.col("band") + t, place(F.col("lefts")), j, False))))
    cells = dealt.select("token", "u", "n", "own", "root", "other", F.explode(F.when(F.col("other"), F.concat(right, left)).otherwise(right)).alias("p")).select("token", "p.*", "u", "n", "own", "root", "other")
    # tiles without one of the sides have nothing to compare
    keys = ["token", "tile", "i", "j"]
    busy = cells.groupBy(*keys).agg(F.min("right").alias("lo"), F.max("right").alias("hi")).where("lo <> hi")
    cells = cells.join(busy.select(*keys), keys, "left_semi").join(bits.select("u", F.col("small").alias("bits")), "u")
    # most tiles hold a few rows, so tasks take them as they come instead of one group at a time
    placed = cells.select(*keys, "right", "u", "n", "own", "root", "other", "bits").repartition(*keys).sortWithinPartitions(*keys, "right")
    return placed.mapInArrow(_compared(percent), "u long, v long").distinct()


def unit_links(units: DataFrame, rows: DataFrame, tagged: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` with the components of "similar enough" among units; ``rows`` holds their leading shingles and bitmaps by u."""
    members = tile_members(units.select("u", "n", "own", "cold"), rows.select("u", "lead"))
    bits = rows.select("u", "n", "bits", "small")
    company = members.groupBy("u").agg((F.count("*") / F.max("n")).alias("company"))  # about the shared part of its leading shingles
    hubs = members.join(company, "u").groupBy("token").agg(F.max(F.struct("company", "u", "n")).alias("hub")).select("token", F.col("hub.u").alias("v"), F.col("hub.n").alias("size"))
    least, most = F.least("n", "size"), F.greatest("n", "size")
    met = members.join(hubs, "token").where((F.col("u") != F.col("v")) & (least * 100 >= most * percent)).groupBy("u", "v").agg(F.count("*").alias("shared"))
    close = cut(_bounded(met, bits, percent))
    sets = _sets_of(close, units, tagged, width)
    first = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), "v"))
    best = close.withColumn("place", first).where("place = 1")
    links = cut(_verified(best, sets, percent))
    roots = cut(components(links))
    apart = close.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    links = cut(links.unionByName(_verified(apart, sets, percent)))
    passed = _tile_candidates(members, cut(components(links)), bits, percent).withColumn("shared", F.lit(1).cast("long"))
    rest = cut(_bounded(passed, bits, percent))
    return links.unionByName(_verified(rest, _sets_of(rest, units, tagged, width), percent))


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of docs.

    A document's set holds the distinct word shingles of its lower-cased (A-Z) text; with fewer words than ``width`` the whole
    sequence is one shingle. Documents link when 100 * intersection >= percent * union; component_id is the smallest id
    reachable by links, the document's own included. NULL, empty and blank texts have an empty set and link with nothing, so
    each keeps its own id. Very long texts are hashed whole. Repeated rows stay and share a component; rows of one id with different
    texts are different documents. A NULL id is kept, and is a component id only where no linked row has one. An empty table
    gives no rows; other columns are ignored. Shingles are told by 64-bit hashes within a pair, equal sets by 128 bits.
    """
    spark, tagged = docs.sparkSession, _tagged(docs, id_col, text_col)
    folder = shared_folder(spark, "jaccard")
    made = shingle_rows(tagged, width, percent, *frequent_shingles(tagged, width))
    made.withColumn("u", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")  # a row's number stands for its unit if it is the first of it
    rows = spark.read.parquet(f"{folder}/rows")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u", "tag1", "tag2", "n", "own", "cold")).alias("one")
    units = cut(rows.where("n > 0").groupBy("h1", "h2").agg(one).select("h1", "h2", "one.*").drop("none"))
    roots = components(unit_links(units, rows, tagged, width, percent)).toDF("u", "root")
    placed = units.select("u", "h1", "h2", "doc_id").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = cut(placed.join(least, "root").select("h1", "h2", "component_id"))
    out = rows.select("doc_id", "n", "h1", "h2").join(member, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
