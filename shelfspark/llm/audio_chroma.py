"""Chroma audio fingerprints.

A recording becomes frames of twelve pitch-class energies; filters over an integral image of the frames compare parts of a
patch, and sixteen quantised comparisons pack into one 32-bit integer for each place. Recordings that share integers are
aligned by the histogram of their offsets, and the alignment is judged by its share of differing bits.

The queries go round in blocks of bounded size: every task holds a block's integers in order, streams its recordings past
them, counts offsets in place and gives back only the alignments that hold. No table of common integers is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder

RATE = 4_000
FRAME = 1_024
HOP = 256
LOW_HZ, HIGH_HZ = 100.0, 1_800.0
PATCH = 16  # frames a filter can span
#: Filters (kind, first pitch class, pitch classes, frames), made from a rule: kinds in turn, sizes growing.
FILTERS = tuple((k % 4, (5 * k) % 12 // 2, 2 + 2 * (k % 3), 4 + 4 * (k % 4)) for k in range(16))
STEPS = (-0.15, 0.0, 0.15)  # log-ratio steps of the quantiser
GRAY = (0, 1, 3, 2)
LEAST_VOTES = 3
MOST_BIT_ERROR = 0.25
#: Integers of the queries sent to the tasks at once (a single longer query goes alone), and meetings counted at once.
BLOCK_INTEGERS = 1 << 19
MEETINGS = 1 << 20


def _pitch_classes() -> tuple[np.ndarray, np.ndarray]:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    return used, np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies (frames, 12) of unit length; silence stays zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    used, cls = _pitch_classes()
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1))[:, used] ** 2
    out = power @ (cls[:, None] == np.arange(12)[None, :])
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def packed_integers(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each place where a whole patch fits."""
    n = len(frames) - PATCH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        y1, half, mid = y + height, width // 2, y + height // 2
        if kind == 0:
            a, b = area(0, half, y, y1), area(half, width, y, y1)
        elif kind == 1:
            a, b = area(0, width, y, mid), area(0, width, mid, y1)
        elif kind == 2:
            a, b = area(0, half, y, mid) + area(half, width, mid, y1), area(half, width, y, mid) + area(0, half, mid, y1)
        else:
            third = width // 4
            a, b = area(third, width - third, y, y1), area(0, third, y, y1) + area(width - third, width, y, y1)
        level = np.digitize(np.log((1 + a) / (1 + b)), STEPS)
        out = out << np.uint32(2) | np.array(GRAY, np.uint32)[level]
    return out


def melody(vector, note_seconds: float = 0.128) -> np.ndarray:
    """A test recording from numbers: each sounds as two sine tones whose pitches follow its sign and size."""
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in vector or ()])
    t = np.arange(int(RATE * note_seconds)) / RATE
    pitch = np.floor(np.abs(x) * 64).astype(int) % 24 + np.where(x < 0, 3, 0)
    hz = 220.0 * 2.0 ** (pitch / 12)
    return (np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(3 * np.pi * hz[:, None] * t)).reshape(-1)


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit mono sound at RATE."""
    return np.frombuffer((data or b"")[: len(data or b"") // 2 * 2], "<i2").astype(float) / 32768


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable = pcm16) -> DataFrame:
    """``(rec_id, ints, class_hash)`` per recording; recordings with the same integers share class_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = [packed_integers(chroma(decode(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.view(np.int32).tolist() for i in ints], pa.list_(pa.int32())), pa.array([hashlib.md5(i.tobytes()).hexdigest() for i in ints], pa.string())],
                names=["rec_id", "ints", "class_hash"],
            )

    rows = media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "rec_id long, ints array<int>, class_hash string")


class QueryBlock:
    """The integers of some queries in order of value, and where each stands."""

    def __init__(self, ints: list[np.ndarray]):
        self.ints = ints
        sizes = np.array([len(x) for x in ints], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *ints])
        self.order = np.argsort(flat, kind="stable")
        self.values = flat[self.order]
        self.query = np.repeat(np.arange(len(ints)), sizes)[self.order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[self.order]
        self.longest = int(sizes.max(initial=0))

    def votes(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, offset, votes) of all meetings of a recording's integers with the queries'."""
        lo, hi = np.searchsorted(self.values, ints, "left"), np.searchsorted(self.values, ints, "right")
        span = self.longest + len(ints) + 1
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        met = np.cumsum(hi - lo)
        at = 0
        while at < len(ints) and met[-1]:  # a common integer meets many: so many at once that MEETINGS bounds the memory
            end = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + MEETINGS, "right")))
            n = hi[at:end] - lo[at:end]
            hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)
            offset = np.repeat(np.arange(at, end), n) - self.place[hit]
            new, own = np.unique(np.concatenate([keys, self.query[hit] * span + offset + self.longest]), return_inverse=True)
            counts = np.bincount(own, np.concatenate([counts, np.ones(len(hit), np.int64)]), minlength=len(new)).astype(np.int64)
            keys, at = new, end
        return keys // span, keys % span - self.longest, counts

    def alignments(self, ints: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, votes, bit error) of the queries that align with a recording: the offset of most votes, the least on ties."""
        query, offset, votes = self.votes(ints)
        order = np.lexsort((offset, -votes, query))
        best = order[np.flatnonzero(np.diff(query[order], prepend=-1))] if len(order) else order
        out = []
        for k in best[votes[best] >= LEAST_VOTES].tolist():
            own, at = self.ints[query[k]], int(offset[k])
            start, stop = max(0, -at), min(len(own), len(ints) - at)
            differ = int(np.bitwise_count(own[start:stop] ^ ints[start + at : stop + at]).sum())
            error = round(differ / (32 * (stop - start)), 6)
            if error <= MOST_BIT_ERROR:
                out.append((int(query[k]), at, int(votes[k]), error))
        return out


def _against(block: QueryBlock, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, ints in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = block.alignments(ints.values.to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32))
                out += [(names[q], name, at, votes, error) for q, at, votes, error in found if names[q] != name]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["own", "class_hash", "offset", "votes", "bit_error"])

    return run


def align_recordings(media: DataFrame, id_col: str, media_col: str, decode: Callable = pcm16, every: int = 100) -> DataFrame:
    """``(query_id, class_id, n_members, offset, votes, bit_error)`` for each recording whose id is divisible by ``every``.

    Recordings with equal integers form a class, named by its smallest id (NULL if no member has one); a query is aligned
    with the classes of all rows, its own included (offset 0, no votes counted, no bit error). Others count when at least
    LEAST_VOTES integers meet at the best offset, the least offset on ties, and at most a quarter of the overlapping bits
    differ. NULL, empty and short recordings have no integers and form one class, which only meets itself. A recording is
    held whole by its task, however long; its meetings with a block are counted in parts. Repeated rows are members of one
    class, a repeated query id asks once; rows without id never ask; an empty table gives no rows; other columns are ignored.
    """
    spark = media.sparkSession
    found = cut(fingerprints(media, id_col, media_col, decode))
    classes = cut(found.groupBy("class_hash").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("n_members"), F.first("ints").alias("ints")))
    named = classes.select("class_hash", "class_id", "n_members")
    asking = found.where(F.col("rec_id") % every == 0).select(F.col("rec_id").alias("query_id"), "class_hash").distinct()
    selves = asking.join(named, "class_hash").select("query_id", "class_id", "n_members", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    # queries with the same integers ask once, and go round in blocks
    sources = cut(classes.join(asking.select("class_hash").distinct(), "class_hash", "left_semi").where(F.size("ints") > 0).select("class_hash", "ints"))
    total = sources.agg(F.coalesce(F.sum(F.size("ints")), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return selves
    folder = shared_folder(spark, "chroma")
    blocks = -(-total // BLOCK_INTEGERS)
    for b in range(blocks):
        # the bound on what is collected is BLOCK_INTEGERS times the spread of the hash
        part = sources.where(F.pmod(F.xxhash64("class_hash"), F.lit(blocks)) == b).orderBy("class_hash").toArrow()
        ints = [x.values.to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32) for x in part.column("ints")]
        held = _against(QueryBlock(ints), part.column("class_hash").to_pylist())
        classes.select("class_hash", "ints").mapInArrow(held, "own string, class_hash string, offset int, votes long, bit_error double").write.mode("append").parquet(folder)
    met = spark.read.parquet(folder).join(named, "class_hash").drop("class_hash")
    others = asking.withColumnRenamed("class_hash", "own").join(met, "own").select("query_id", "class_id", "n_members", "offset", "votes", "bit_error")
    return selves.unionByName(others)
