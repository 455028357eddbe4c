"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots of equal length. Slot k takes the golden-ratio point frac(k * phi), which the cumulative target
weights map to a source; the r-th slot of a source takes block r (in turn) of its documents, which stand in shuffled order
and are cut into blocks of as many words. A source that the points gave a slot too few or too many gets it at the end, and
its last slot is cut, so that its words are its target. Ranks and offsets are found in two steps (counts by segment, then
within the segment), so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_WORDS = 128
#: Slots ranked together, and parts of a source whose offsets are found together.
SEGMENT_SLOTS = 65_536
SOURCE_PARTS = 4_096
MAX_REPEATS = 3
#: Sources whose targets are broadcast, about 100 bytes each; more are joined.
MOST_BROADCAST = 50_000
_PHI_NUMERATOR = 2654435769  # fixed value: floor(2**32 / golden ratio)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_weights(sources: list) -> list[float]:
    """1, 2, 3, repeating, in the order given."""
    return [float(k % 3 + 1) for k in range(len(sources))]


def water_fill(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets that sum to all words: by weight, at most ``repeats`` times the size, the excess shared again by weight."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > repeats * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(repeats * sizes[i])
        open_ -= set(full)
        left = sum(sizes) - sum(targets[i] for i in range(len(sizes)) if i not in open_)
    return targets


def source_targets(sized: DataFrame, block: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source, by code point with NULL last; the sources are the only thing collected.

    ``need`` slots make up the target: so many rounds over all blocks of the source, then its first ``rest`` words.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("total")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [r["total"] for r in rows]
    out = []
    for k, (r, target) in enumerate(zip(rows, water_fill(sizes, default_weights(rows)), strict=True)):
        size, words = r["total"], int(round(target))
        rounds, rest = divmod(words, size) if size else (0, 0)
        need = rounds * -(-size // block) + -(-rest // block)
        out.append({"source": r["source"], "no": k, "source_size": size, "target": target, "need": need, "rest": rest})
    return out


def slot_ranks(spark, sources: list[dict], plan: DataFrame) -> DataFrame:
    """``(no, rank)``: the source of every slot and the slot's place among the source's slots; each source has those it needs."""
    slots = sum(s["need"] for s in sources)
    open_ = np.array([s["no"] for s in sources if s["need"] > 0], np.int32)
    edges = np.cumsum([s["need"] for s in sources if s["need"] > 0]) / max(1, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy().astype(np.uint64)
            # 32-bit golden-ratio point, extended by the high part of the slot number so that it stays distinct beyond 2**32 slots
            point = (slot * np.uint64(_PHI_NUMERATOR) + (slot >> np.uint64(32)) & np.uint64(2**32 - 1)).astype(float) / 2**32
            no = open_[np.minimum(np.searchsorted(edges, point, "right"), len(open_) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array((slot // np.uint64(SEGMENT_SLOTS)).astype(np.int64)), batch.column(0), pa.array(no)], names=["segment", "slot", "no"])

    tasks = max(1, min(10_000, slots // 200_000 + 1))
    dealt = spark.range(0, slots, 1, tasks).mapInArrow(run, "segment long, slot long, no int")
    counts = dealt.groupBy("no", "segment").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("no", "segment", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("no", "segment").orderBy("slot")) - 1
    ranked = dealt.select("no", "segment", within.alias("within")).join(starts, ["no", "segment"]).select("no", (F.col("before") + F.col("within")).alias("rank"))
    given = counts.groupBy("no").agg(F.sum("n").alias("given"))
    late = plan.join(given, "no", "left").select("no", F.coalesce("given", F.lit(0)).alias("given"), "need").where("given < need")
    late = late.select("no", F.explode(F.sequence("given", F.col("need") - 1)).alias("rank"))  # as few as the points are even
    return ranked.join(plan.select("no", "need"), "no").where("rank < need").select("no", "rank").unionByName(late)


def source_offsets(sized: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``start``: where the document begins in the shuffled words of its source."""
    shuffled = sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "h"))
    shuffled = shuffled.withColumn("part", F.pmod(F.shiftright("order", 20), F.lit(SOURCE_PARTS)))
    parts = shuffled.groupBy("no", "part").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("no", "part", before.alias("before"))
    own = Window.partitionBy("no", "part").orderBy("order", "doc_id", "h", "tag").rowsBetween(Window.unboundedPreceding, 0)
    placed = shuffled.withColumn("within", F.sum("size").over(own) - F.col("size"))
    return placed.join(parts, ["no", "part"]).withColumn("start", F.col("before") + F.col("within")).drop("order", "part", "before", "within")


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag: Column | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per row of docs, and ``tag``, a string of the row that goes along; taken counts repeats.

    A source's taken words are its target, rounded, and no document is taken more than three times. The words that a
    document is taken once more for are its first ones. Empty and NULL texts have size zero and are never taken; very long
    texts span many blocks; NULL sources form one source, the last; repeated rows are placed one after another and counted
    each; an empty table gives no rows; other columns are ignored. The order depends on hashes of ids and texts only, so
    reruns agree.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"), (F.lit(None) if tag is None else tag).cast("string").alias("tag"))
    sized = cut(sized)
    sources = source_targets(sized, block)
    schema = "source string, no int, source_size long, target double, need long, rest long"
    plan = spark.createDataFrame([tuple(s.values()) for s in sources], schema)
    if len(sources) <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    known = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop("source")
    carried = ["doc_id", "size", "source_size", "target", *["tag"] * (tag is not None)]
    empty = known.where("size = 0").select(*carried, F.lit(0).cast("long").alias("taken"))
    placed = source_offsets(known.where("size > 0"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    words = lambda end: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), end) - F.greatest("start", F.col("block") * block))
    end = (F.col("block") + 1) * block
    blocks = F.ceil(F.col("source_size") / block)
    ranked = slot_ranks(spark, sources, plan).join(plan.select("no", "source_size"), "no")
    uses = ranked.groupBy("no", F.pmod("rank", blocks).alias("block")).agg(F.count("*").alias("uses"))
    cut_short = F.col("block") == F.floor(F.col("rest") / block)  # the block that the last slot takes in part
    taken = pieces.join(uses, ["no", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    part = F.when(cut_short & (F.col("rest") % block > 0), words(end) * (F.col("uses") - 1) + words(F.col("rest"))).otherwise(words(end) * F.col("uses"))
    mixed = taken.groupBy("no", "start", "h", *carried).agg(F.sum(part).cast("long").alias("taken"))
    names = ["doc_id", "size", "source_size", "target", "taken", *["tag"] * (tag is not None)]
    return mixed.select(*names).unionByName(empty.select(*names))
