"""Hard-negative mining over an STR-packed R-tree of integer vectors.

Sort-tile-recursive packing: the two coordinates of most variance deal the rows into tiles of bounded size (a tile that ties
make too large is split by row number), each tile sorts its rows by slabs of the next two coordinates, and runs of LEAF rows
become leaves. The packed rows lie in the shared folder in this order, so a task derives the minimum bounding boxes of its
leaves, and those of the nodes above, from the rows as they come. A box gives an interval for each coordinate's product with
an anchor's, so for the inner product. Anchors go round in blocks of bounded size; within a task a few neighbouring anchors share
a queue that opens the box of the highest upper bound first and passes over an anchor whose windows the box's interval does
not meet, or whose k-th score so far lies strictly above it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder

SCALE = 256
#: Rows of a leaf, leaves below a node, and anchors that share a queue.
LEAF, FANOUT, SHARED = 64, 16, 32
#: Rows of a tile, which one task packs in memory; tiles a coordinate at most.
TILE_ROWS, SLABS = 8_192, 256
#: Anchors sent to the tasks at once.
ANCHOR_BLOCK = 4_096
#: Found rows that a task holds before it lets go of those below the k-th.
HELD = 200_000
LARGEST = 2**63 - 1
_ROW = "rid long, vec_id long, label long, v array<long>"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(rid, vec_id, label, v)`` of the rows that take part, v = floor(scale * x) by component, at the nearest long; rid tells rows apart."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.where("x is not null and label is not null").where(~F.coalesce(bad, F.lit(True)))
    whole = F.transform("x", lambda c: F.greatest(F.floor(F.greatest(F.least(c * scale, F.lit(float(2**63))), F.lit(-float(2**63)))).cast("long"), F.lit(-LARGEST)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", whole.alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), len(column) * width).to_numpy(zero_copy_only=False).reshape(-1, width)


def _slabs(keys: np.ndarray, parts: int) -> np.ndarray:
    """The slab of each row when rows are cut by key into equal parts."""
    place = np.empty(len(keys), np.int64)
    place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    return place * parts // max(1, len(keys))


def packed_order(m: np.ndarray, axes: list[int]) -> np.ndarray:
    """Rows of a tile in STR order: slabs of one axis, sorted by the other within."""
    parts = max(1, int(np.ceil(np.sqrt(len(m) / LEAF))))
    return np.lexsort((m[:, axes[1]], _slabs(m[:, axes[0]], parts)))


def packed(rows: DataFrame, n: int, width: int) -> DataFrame:
    """``(tile, rid, vec_id, label, v)`` in packed order, written to the shared folder."""
    spread = rows.agg(*[F.var_pop(F.col("v")[k].cast("double")).alias(str(k)) for k in range(width)]).first()
    axes = sorted(range(width), key=lambda k: (-(spread[k] or 0.0), k))
    axes = [axes[k % width] for k in range(4)]
    side = min(SLABS, int(np.ceil(np.sqrt(-(-n // TILE_ROWS)))))
    shares = [k / side for k in range(1, side)]
    x, y = F.col("v")[axes[0]], F.col("v")[axes[1]]
    first = np.zeros(0, np.int64) if side == 1 else np.array(rows.agg(F.percentile_approx(x, shares)).first()[0], np.int64)

    def tiled(second: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(3), width)
                tile = np.searchsorted(first, m[:, axes[0]], "left")
                if second is not None:
                    tile = tile * side + (second[tile] < m[:, axes[1]][:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), *batch.columns], names=["tile", *batch.schema.names])

        return rows.mapInArrow(run, "tile int, " + _ROW)

    second = np.zeros((side, side - 1), np.int64)
    if side > 1:
        for r in tiled(None).groupBy("tile").agg(F.percentile_approx(y, shares).alias("cuts")).collect():  # at most SLABS rows
            second[r["tile"]] = r["cuts"]
    placed = tiled(second)
    # at most SLABS x SLABS tiles; one that is too large is split evenly
    parts = placed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        m = _matrix(table.column("v").combine_chunks(), width)
        return table.take(pa.array(packed_order(m, axes[2:]))).select(["tile", "rid", "vec_id", "label", "v"])

    folder = shared_folder(rows.sparkSession, "r-tree")
    placed.groupBy("tile", "part").applyInArrow(pack, "tile int, " + _ROW).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _product(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Integer products a @ b.T; doubles hold them exactly while every sum stays under 2**53."""
    if small:
        return (a @ b.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


class Boxes:
    """Minimum bounding boxes and the intervals of their inner products with anchors."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi = lo, hi

    def above(self, starts: np.ndarray) -> Boxes:
        return Boxes(np.minimum.reduceat(self.lo, starts, axis=0), np.maximum.reduceat(self.hi, starts, axis=0))

    def interval(self, q: np.ndarray, which: slice | np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) inner products, anchors by boxes."""
        lo, hi, up, down = self.lo[which], self.hi[which], np.maximum(q, 0), np.minimum(q, 0)
        if small:
            return (up @ lo.T + down @ hi.T).astype(np.int64), (up @ hi.T + down @ lo.T).astype(np.int64)
        up, down, lo, hi = (a.astype(object) for a in (up, down, lo, hi))
        return tuple(np.clip(s, -LARGEST, LARGEST).astype(np.int64) for s in (up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T))


class Best:
    """The best ``k`` scores of each anchor and window so far, and the rows that reach them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k  # anchors x windows
        self.top = np.full((*low.shape, k), -LARGEST - 1, np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []  # anchor, window, score, no id, id, rid
        self.held = 0

    def floor(self, a: np.ndarray) -> np.ndarray:
        """The score a row needs at least: the window's low end or the k-th score so far."""
        return np.maximum(self.low[a], self.top[a].min(axis=2))

    def wanted(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For anchors a and boxes: which intervals still meet a window."""
        return ((most[:, :, None] >= self.floor(a)[:, None, :]) & (least[:, :, None] <= self.high[a][:, None, :])).any(axis=2)

    def add(self, a: np.ndarray, scores: np.ndarray, fit: np.ndarray, ids: tuple[np.ndarray, ...]) -> None:
        """Scores (anchors x rows) of rows that fit; ids: for each row whether it has no id, its id, its rid."""
        good = fit[:, None, :] & (scores[:, None, :] >= self.floor(a)[:, :, None]) & (scores[:, None, :] <= self.high[a][:, :, None])
        at, window, row = np.nonzero(good)
        if not len(at):
            return
        self.found.append((a[at], window, scores[at, row], *(i[row] for i in ids)))
        some = np.unique(at)
        both = np.concatenate([self.top[a[some]], np.where(good[some], scores[some][:, None, :], -LARGEST - 1)], axis=2)
        self.top[a[some]] = np.partition(both, both.shape[2] - self.k, axis=2)[:, :, -self.k :]
        self.held += len(at)
        if self.held > HELD:
            self.found = [self.rows()]
            self.held = len(self.found[0][0])

    def rows(self) -> tuple[np.ndarray, ...]:
        """The k best rows of each anchor and window: higher scores, then smaller ids, rows without id last."""
        if not self.found:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        a, w, score, none, vec_id, rid = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((rid, vec_id, none, -score, w, a))
        group = (a * self.low.shape[1] + w)[order]
        keep = order[np.arange(len(order)) - np.searchsorted(group, group) < self.k]
        return a[keep], w[keep], score[keep], none[keep], vec_id[keep], rid[keep]


def search(batch: pa.RecordBatch, q: np.ndarray, rids: np.ndarray, labels: np.ndarray, same: bool, best: Best) -> int:
    """Best-first search of the packed rows ``(tile, rid, vec_id, label, v)``; returns the leaves opened for an anchor."""
    m = _matrix(batch.column(4), q.shape[1])
    small = max(np.abs(q).max(initial=0), np.abs(m).max(initial=0)) < 2**20 and q.shape[1] < 2**12
    if small:
        m, q = m.astype(np.float64), q.astype(np.float64)
    tile, rid, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
    none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
    ids = (none, batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), rid)
    # leaves are runs of LEAF rows within a tile, nodes are runs of FANOUT leaves
    tile_start = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
    starts = np.concatenate([np.arange(lo, hi, LEAF) for lo, hi in zip(tile_start, [*tile_start[1:], len(tile)])])
    ends = np.append(starts[1:], len(tile))
    leaves = Boxes(m, m).above(starts)
    node_starts = np.arange(0, len(starts), FANOUT)
    nodes = leaves.above(node_starts)
    opened = 0
    for lo in range(0, len(q), SHARED):
        a = np.arange(lo, min(len(q), lo + SHARED))
        least, most = nodes.interval(q[a], slice(None), small)
        need = best.wanted(a, least, most)
        heap = [(-int(most[need[:, k], k].max()), 0, k) for k in np.flatnonzero(need.any(axis=0)).tolist()]
        heapq.heapify(heap)
        while heap:
            high, is_leaf, k = heapq.heappop(heap)
            if -high < best.floor(a).min():
                break
            if not is_leaf:
                below = np.arange(node_starts[k], min(node_starts[k] + FANOUT, len(starts)))
                least, most = leaves.interval(q[a], below, small)
                need = best.wanted(a, least, most)
                for c in np.flatnonzero(need.any(axis=0)).tolist():
                    heapq.heappush(heap, (-int(most[need[:, c], c].max()), 1, int(below[c])))
                continue
            least, most = leaves.interval(q[a], slice(k, k + 1), small)
            some = a[best.wanted(a, least, most)[:, 0]]
            if len(some):
                rows = slice(starts[k], ends[k])
                opened += len(some)
                fit = (label[rows][None, :] == labels[some][:, None]) == same
                fit &= rid[rows][None, :] != rids[some][:, None]
                best.add(some, _product(q[some], m[rows], small), fit, tuple(i[rows] for i in ids))
    return opened


def _searched(index: DataFrame, block: pd.DataFrame, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """The best k rows of each task by anchor and window."""
    rids, labels = block["rid"].to_numpy(np.int64), block["label"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low, high, k)
        for batch in batches:
            if batch.num_rows:
                search(batch, q, rids, labels, same, best)
        a, w, score, none, vec_id, rid = best.rows()
        columns = [pa.array(rids[a]), pa.array(w.astype(np.int32)), pa.array(score), pa.array(vec_id, mask=none.astype(bool)), pa.array(rid)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "win", "score", "vec_id", "rid"])

    return index.mapInArrow(run, "anchor long, win int, score long, vec_id long, rid long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, every: int = 100,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Each row whose id is divisible by ``every`` is an anchor. Its positives are the first ``positives`` other rows of its
    label, its negatives for a positive the first ``negatives`` rows of other labels whose score lies within low_percent
    and high_percent of the positive's score. Scores are integer inner products; higher ones come first, equal ones by
    smaller id, rows without id last. Rows with a NULL label or vector or with a NULL or non-finite component take no part.
    Rows that repeat an id are rows of their own: each is an anchor, and each may be found. Shorter vectors are compared as
    if filled up with zeros; components and scores beyond a long are the nearest long. An anchor without positives, or a
    window without rows (as below a negative score), gives no rows; so does an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = cut(quantised(vectors, id_col, vec_col, label_col))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("anchors")).first()
    if not seen["n"] or not seen["anchors"]:
        return empty
    width = max(1, seen["width"])
    filled = F.when(F.size("v") == width, F.col("v")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width)), 1, width))
    index = packed(rows.withColumn("v", filled), seen["n"], width)
    anchors = index.where(F.col("vec_id") % every == 0)
    folder, written, groups = shared_folder(spark, "hard-negatives"), False, -(-seen["anchors"] // ANCHOR_BLOCK)
    for g in range(groups):
        # one block of about ANCHOR_BLOCK vectors at a time, neighbours in the tree together
        block = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(groups)) == g).orderBy("tile", *[F.col("v")[k] for k in range(min(3, width))], "rid").toPandas()
        if not len(block):
            continue
        q = np.array(block["v"].tolist(), np.int64).reshape(len(block), width)
        open_ = np.full((len(block), 1), LARGEST, np.int64)
        near = _ranked(_searched(index, block, q, -open_, open_, True, positives), positives).collect()  # positives x block rows
        place = {r: k for k, r in enumerate(block["rid"])}
        low, high = np.full((len(block), positives), LARGEST, np.int64), np.full((len(block), positives), -LARGEST, np.int64)
        for r in near:
            at = place[r["anchor"]], r["rank"] - 1
            low[at], high[at] = -(-low_percent * r["score"] // 100), high_percent * r["score"] // 100
        found = _ranked(_searched(index, block, q, low, high, False, negatives), negatives)
        known = [(r["anchor"], r["rank"] - 1, int(block["vec_id"].iat[place[r["anchor"]]]), r["vec_id"], r["score"]) for r in near]
        if not known:
            continue
        sides = spark.createDataFrame(known, "anchor long, win int, anchor_id long, positive_id long, positive_score long")
        out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(sides), ["anchor", "win"])
        out.select(*empty.columns).write.mode("append").parquet(folder)  # so that the plan does not grow with the blocks
        written = True
    return spark.read.parquet(folder) if written else empty
