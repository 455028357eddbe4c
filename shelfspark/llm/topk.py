"""Exact top-k by distributed histogram selection.

Queries go round in blocks of bounded size. For a block, every task scores its candidates against all queries of the block
and keeps a histogram of scores for each query; the summed histograms say in which bin each k-th score lies, the next
round splits that bin, until the bin is one integer. A last round keeps what reaches the k-th score, and ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder

SCALE = 64
BINS = 512
#: Queries sent to the tasks at once: 4,096 vectors, 2 MB at 64 components.
QUERY_BLOCK = 4_096
#: Candidates scored at once, so that a score matrix has at most 4M entries.
SCORE_CELLS = 4_000_000
#: Components and scores beyond a long are the nearest long but one (its negative is a long, too).
LARGEST = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(rid, vec_id, v)`` with v = floor(64 x) per component; rows with NULL or non-finite parts are left out. rid tells rows apart."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("x is not null").where(~F.coalesce(bad, F.lit(True)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.transform("x", lambda c: F.greatest(F.floor(F.greatest(F.least(c * SCALE, F.lit(float(2**63))), F.lit(-float(2**63)))).cast("long"), F.lit(-LARGEST))).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), len(column) * width).to_numpy(zero_copy_only=False).reshape(-1, width)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rids of candidates, whether they have no id, their ids, scores by query) of parts of a task's rows."""
    exact = np.abs(q).max(initial=0) < 2**20
    qf = q.T.astype(np.float64)
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    for batch in batches:
        own, m = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(2), q.shape[1])
        none, vec = batch.column(1).is_null().to_numpy(zero_copy_only=False), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(own), step):
            part = m[lo : lo + step]
            # doubles hold the sums exactly while every product and sum stays under 2**53
            small = exact and np.abs(part).max(initial=0) < 2**20 and q.shape[1] < 2**13
            if small:
                scores = (part.astype(np.float64) @ qf).astype(np.int64)
            else:  # whole numbers of any size, cut to a long at the end
                scores = np.clip(part.astype(object) @ q.T.astype(object), -LARGEST, LARGEST).astype(np.int64)
            at = slice(lo, lo + step)
            yield own[at], none[at], vec[at], scores


def _histograms(ids, q, low, width, k):
    """Per query the counts of the bins that hold the task's k best scores, counted from the top; bin BINS is all above."""

    def run(batches):
        counts = np.zeros((len(ids), BINS + 1), np.int64)
        flat = counts.reshape(-1)
        for own, _, _, scores in _scored(batches, ids, q):
            above = (scores - low).view(np.uint64)  # right even where the difference is no long
            bins = np.minimum(above // width.astype(np.uint64), np.uint64(BINS)).astype(np.int64)
            row, col = np.nonzero((scores >= low) & (own[:, None] != ids[None, :]))
            flat += np.bincount(col * (BINS + 1) + bins[row, col], minlength=len(flat))
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        need = (counts > 0) & (from_top - counts < k)
        row, col = np.nonzero(need)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(counts[row, col])], names=["q", "bin", "n"])

    return run


def _kept(ids, q, floor_, k):
    def run(batches):
        for own, none, vec, scores in _scored(batches, ids, q):
            row, col = np.nonzero((scores >= floor_) & (own[:, None] != ids[None, :]))
            value = scores[row, col]
            order = np.lexsort((vec[row], none[row], -value, col))
            col, value, row = col[order], value[order], row[order]
            place = np.arange(len(col)) - np.searchsorted(col, col)  # within the query
            best = place < k
            found = row[best]
            yield pa.RecordBatch.from_arrays([pa.array(ids[col[best]]), pa.array(vec[found], mask=none[found]), pa.array(own[found]), pa.array(value[best])], names=["query", "vec_id", "rid", "score"])

    return run


def kth_scores(rows: DataFrame, ids: np.ndarray, q: np.ndarray, bound: int, k: int) -> np.ndarray:
    """The k-th highest score of each query (or less than any score where there are fewer)."""
    low = np.full(len(ids), -bound, np.int64)
    width = np.full(len(ids), max(1, -(-(2 * bound + 1) // BINS)), np.int64)
    while True:  # at most seven rounds for longs
        found = rows.mapInArrow(_histograms(ids, q, low, width, k), "q int, bin int, n long")
        summed = found.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        reached = summed.select("q", "bin", above.alias("above")).where(F.col("above") >= k).groupBy("q").agg(F.max("bin").alias("bin"))
        at = np.zeros(len(ids), np.int64)
        for r in reached.collect():  # one number for each query of the block
            at[r["q"]] = r["bin"]
        low = (low.view(np.uint64) + at.astype(np.uint64) * width.astype(np.uint64)).view(np.int64)
        if (width == 1).all():
            return low
        width = np.maximum(1, -(-width // BINS))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the k highest integer inner products.

    Every row but the query's own is a candidate; equal scores go to the smaller id, rows without id last. Vectors that are NULL or hold NULL or non-finite
    parts take no part; vectors of another length than the table's longest are compared as if filled up with zeros.
    Components and scores beyond a long are the nearest long. Rows that repeat an id are rows of their own, as queries and as candidates.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("queries"),
                    F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c)))).alias("top")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not seen["n"] or not seen["queries"]:
        return empty
    width = max(1, seen["width"])
    rows = cut(rows.select("rid", "vec_id", F.when(F.size("v") == width, F.col("v")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)).alias("v")))
    queries = rows.where(F.col("vec_id") % every == 0)
    groups = -(-seen["queries"] // QUERY_BLOCK)
    folder, written = shared_folder(spark, "top-k"), False
    for g in range(groups):
        # one block at a time; the bound on its size is QUERY_BLOCK times the spread of the hash
        block = queries.where(F.pmod(F.xxhash64("rid"), F.lit(groups)) == g).orderBy("rid").toPandas()
        if not len(block):
            continue
        ids, q = block["rid"].to_numpy(np.int64), np.array(block["v"].tolist(), np.int64).reshape(len(block), width)
        bound = min(LARGEST, max(sum(map(abs, x)) for x in q.tolist()) * int(seen["top"]) + 1)
        floor_ = kth_scores(rows, ids, q, bound, k)
        kept = rows.mapInArrow(_kept(ids, q, floor_, k), "query long, vec_id long, rid long, score long")
        named = spark.createDataFrame(list(zip(ids.tolist(), block["vec_id"].tolist(), strict=True)), "query long, query_id long")
        kept.join(F.broadcast(named), "query").write.mode("append").parquet(folder)  # so that the plan does not grow with the queries
        written = True
    if not written:
        return empty
    best = spark.read.parquet(folder)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    return best.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
