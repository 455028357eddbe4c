"""Substring dedup with an FM-index per shard.

A window is 35 consecutive words. Equal windows have the same least 8-word hash at the same place (their anchor), so it is
enough to bring together the surroundings of equal anchors, which are the words of the windows that have it as their least
hash. Each window is looked at under its own anchor only:

1. Anchors that occur once are dropped after one count.
2. If the whole surroundings of an anchor (62 words at most) repeat, all its windows repeat.
3. The rest goes to shards by anchor, one segment for each distinct surroundings. A shard builds a compressed FM-index of
   its segments: suffix order, Burrows-Wheeler transform, wavelet matrix with rank directories. Backward search gives the
   matching statistics of each segment: how far left a match that occurs twice reaches from each end; halving the range of
   windows finds all of length 35 or more. Symbols carry their anchor and place, so one stretch of text never matches
   itself through overlapping segments.
4. Anchors with very many distinct surroundings are not sent to one shard; their windows are counted by hash and place, and
   those that only one surroundings holds are taken off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import Group, groups, kept_text, mixed

WINDOW = 35
GRAM = 8
REACH = WINDOW - GRAM  # words on each side of an anchor that its windows can hold
SEGMENT = WINDOW + REACH
OFFSETS = REACH + 1
ALL_WINDOWS = (1 << OFFSETS) - 1
SEGMENTS_PER_SHARD = 1500
#: Anchors with more distinct surroundings than this take route 4; both routes are exact.
HOT_SURROUNDINGS = 2048
_CHUNK = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers


def _runs(h: np.ndarray, doublings: int) -> np.ndarray:
    """Hashes of all runs of 2**doublings words."""
    for k in range(doublings):
        h = h[: -(1 << k)] * _A + mixed(h[1 << k :])
    return h


def spaced(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a group's texts with REACH zeros before, between and after them, and where each text begins in there."""
    sizes = np.diff(group.edges)
    begin = group.edges[:-1] + REACH * (1 + np.arange(len(sizes)))
    line = np.zeros(len(group.start) + REACH * (len(sizes) + 1), np.uint64)
    line[np.arange(len(group.start)) + np.repeat(REACH * (1 + np.arange(len(sizes))), sizes)] = group.hashes()
    return line, begin


def anchors(line: np.ndarray, begin: np.ndarray, sizes: np.ndarray, whole: bool = True) -> list[np.ndarray]:
    """The places in line of the least 8-word hash of every window (the leftmost on ties), and these hashes.

    With whole also the hash of the surroundings, the place of the first window in the segment around the anchor, and how
    many windows have it; these are consecutive.
    """
    windows = np.maximum(sizes - WINDOW + 1, 0)
    inside = np.zeros(len(line) + 1, np.int8)  # where a window of a text begins
    inside[begin[windows > 0]] = 1
    inside[(begin + windows)[windows > 0]] = -1
    starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) > 0)
    if not len(starts):
        return [starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts, starts][: 5 if whole else 2]
    grams, places = mixed(_runs(line, 3)), []
    n = len(line) - WINDOW + 1
    for lo in range(0, n, _CHUNK):
        part = grams[lo : min(n, lo + _CHUNK) + REACH]
        least = part & ~np.uint64(0x1FFFFF) | np.arange(len(part), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: -(OFFSETS - 16)], least[OFFSETS - 16 :])
        places.append((least & np.uint64(0x1FFFFF)).astype(np.int64) + lo)
    place = np.concatenate(places)[starts]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place, start, count = place[first], starts[first], np.diff(first, append=len(starts))
    if not whole:
        return [place, grams[place]]
    runs, low = _runs(line, 5), start - place + REACH
    around = mixed(runs[start] * _B + mixed(runs[start + count + WINDOW - 1 - 32])) ^ mixed((low * 64 + count).astype(np.uint64))
    return [place, grams[place], around, low, count]


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(t, row)``: t stands for the text; the row is one struct (doc_id, text, carried), so that all joins on t read the same shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(carry)])
    return docs.select(row.alias("row")).select(F.xxhash64("row.text").alias("t"), "row")


def _alike(text: np.ndarray, anchor: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places of one text with equal surroundings: the first ones; then for each further place its first one, and the place."""
    order = np.argsort(around + text.astype(np.uint64) * _A, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in (text, anchor, around)], axis=0)
    first = order[new]
    owner = first[np.cumsum(new) - 1][~new]
    by_owner = np.argsort(owner, kind="stable")
    return np.sort(first), owner[by_owner], order[~new][by_owner]


def occurrences(keyed: DataFrame, whole: bool = True) -> DataFrame:
    """``(anchor, t, pos, around, low, n, more)`` for every anchor and surroundings of every text; only ``anchor``, for every place, if not whole.

    t stands for the text, pos is the first place in it and ``more`` lists the others (NULL if none), so a line that a text
    repeats is one row of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy() if whole else None
            for group in groups(batch.column(0)):
                line, begin = spaced(group)
                place, anchor, *more = anchors(line, begin, np.diff(group.edges), whole)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])
                    continue
                around, low, n = more
                text = np.searchsorted(begin, place, "right") - 1
                pos = (place - begin[text]).astype(np.int32)
                head, owner, rest = _alike(text, anchor, around)
                ends = np.searchsorted(owner, head, "right").astype(np.int32)
                starts = np.concatenate([np.zeros(1, np.int32), ends[:-1]])[: len(ends)]
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends[-1:]])) if len(ends) else pa.array([0], pa.int32()), pa.array(pos[rest]), mask=pa.array(starts == ends))
                columns = [pa.array(x) for x in (anchor[head].view(np.int64), keys[group.first + text[head]], pos[head], around[head].view(np.int64), low[head].astype(np.int8), n[head].astype(np.int8))]
                yield pa.RecordBatch.from_arrays([*columns, others], names=["anchor", "t", "pos", "around", "low", "n", "more"])

    if not whole:
        return keyed.select("row.text").mapInArrow(run, "anchor long")
    return keyed.select("row.text", "t").mapInArrow(run, "anchor long, t long, pos int, around long, low byte, n byte, more array<int>")


class WaveletMatrix:
    """Rank of symbols over a sequence: one bit vector a level, with counts every 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n, self.levels = len(sequence), []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((shift, packed, before, int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.base = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, packed, before, zeros in self.levels:
            block = i >> 6
            ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.descend(symbol, i) - self.base[symbol]


class FMIndex:
    """Backward search over rows of symbols; zero ends a row and is never searched for."""

    def __init__(self, rows: np.ndarray):
        text = np.concatenate([rows, np.zeros((len(rows), 1), rows.dtype)], axis=1).reshape(-1)
        alphabet, symbols = np.unique(text, return_inverse=True)
        if alphabet[0] != 0:
            raise ValueError("rows must end in zero")
        self.rows, n = symbols.reshape(len(rows), -1)[:, :-1], len(text)
        rank, step = symbols.astype(np.int64), 1
        while step < 2 * rows.shape[1] and rank.max() < n - 1:  # order by prefixes that double in length
            rank = np.unique(rank * n + np.roll(rank, -step), return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.tree = WaveletMatrix(symbols[order - 1], len(alphabet))
        counts = np.bincount(symbols, minlength=len(alphabet))
        self.first, self.n = np.cumsum(counts) - counts, n

    def occurs_twice(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether ``rows[row][lo:hi]`` occurs at least twice; searches all at once from the right."""
        left, right = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        at, active = hi - 1, np.arange(len(row))
        while len(active):
            symbol = self.rows[row[active], at[active]]
            both = self.first[symbol] + self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([left[active], right[active]])).reshape(2, -1)
            left[active], right[active] = both
            at[active] -= 1
            active = active[(both[1] - both[0] >= 2) & (at[active] >= lo[active])]
        return right - left >= 2


def repeated_windows(segments: np.ndarray, anchor: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Bit o of the result: the window that starts at place o of the segment is in another segment of its anchor too (all for the known)."""
    place = np.arange(1, SEGMENT + 1, dtype=np.uint64) * _B
    own = mixed(mixed(segments ^ mixed(anchor)[:, None]) + place[None, :])
    own = np.where(segments == 0, np.uint64(0), np.maximum(own, np.uint64(1)))
    mask = np.where(known, ALL_WINDOWS, 0)
    # A run of 1, 2, 4, 8 or 16 words that no other segment has at its place ends every match, so only the stretch
    # around the anchor between two such runs is indexed and searched; a stretch shorter than a window matches nothing.
    start, stop, runs = np.zeros(len(own), np.int64), np.full(len(own), SEGMENT), own
    after = REACH + GRAM
    for width in (1, 2, 4, 8, 16):
        symbol, count = np.unique(runs, return_inverse=True, return_counts=True)[1:]
        lone = (count == 1)[symbol].reshape(runs.shape)
        if width == 1:
            lone |= segments == 0
        left = lone[:, : min(REACH, after - width + 1)]
        start = np.maximum(start, np.where(left.any(axis=1), left.shape[1] - left[:, ::-1].argmax(axis=1), 0))
        first = max(REACH, after - width + 1)
        right = lone[:, first:]
        stop = np.minimum(stop, np.where(right.any(axis=1), first + right.argmax(axis=1) + width - 1, SEGMENT))
        runs = runs[:, :-width] * _A + mixed(runs[:, width:])
    used = np.flatnonzero(stop - start >= WINDOW)
    if not len(used) or known[used].all():
        return mask
    inside = (np.arange(SEGMENT) >= start[used, None]) & (np.arange(SEGMENT) < stop[used, None])
    found = _searched(np.where(inside, own[used], np.uint64(0)), start[used], stop[used], known[used])
    mask[used] |= found
    return mask


def _searched(rows: np.ndarray, start: np.ndarray, stop: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The windows of each unknown row that occur twice: whole ranges of windows first, then their halves."""
    index, mask = FMIndex(rows), np.zeros(len(rows), np.int64)
    row = np.flatnonzero(~known)
    lo, hi = start[row], stop[row] - WINDOW
    while len(row):
        hit = index.occurs_twice(row, lo, hi + WINDOW)
        np.bitwise_or.at(mask, row[hit], (1 << (hi[hit] + 1)) - (1 << lo[hit]))
        row, lo, hi = row[~hit & (hi > lo)], lo[~hit & (hi > lo)], hi[~hit & (hi > lo)]
        middle = (lo + hi) // 2
        row, lo, hi = np.concatenate([row, row]), np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
    return mask


def _binary_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of segments as rows of words."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u8") if len(chunk) else np.zeros(0, np.uint64))
    return np.concatenate(parts).reshape(-1, SEGMENT)


def _shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Masks of the segments whose surroundings occur once; the known ones only help to find them."""
    anchor = table.column("anchor").to_numpy().view(np.uint64)
    around = table.column("around").to_numpy()
    own = np.unique(np.stack([anchor, around.view(np.uint64)]), axis=1, return_index=True)[1]
    known = table.column("known").to_numpy(zero_copy_only=False)[own]
    mask = repeated_windows(_binary_rows(table.column("segment"))[own], anchor[own], known)
    found = ~known & (mask != 0)
    return pa.table({"anchor": pa.array(anchor[own][found].view(np.int64)), "around": pa.array(around[own][found]), "mask": pa.array(mask[found].astype(np.int32))})


def _entries(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(text, fields) of the list entries of the texts lo to hi; NULL lists are empty."""
    offsets = column.offsets.to_numpy()
    part = column.values.slice(offsets[lo], offsets[hi] - offsets[lo])
    return np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), part.flatten()


def _asked(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, list[np.ndarray]]:
    text, fields = _entries(column, lo, hi)
    return text, [f.to_numpy(zero_copy_only=False) for f in fields]


def _places(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pos, mask) of all places that the list entries (pos, mask, more) of the texts lo to hi name."""
    text, (pos, mask, more) = _entries(column, lo, hi)
    mask, further = mask.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(more), 0).to_numpy()
    return np.concatenate([text, np.repeat(text, further)]), np.concatenate([pos.to_numpy(zero_copy_only=False), more.flatten().to_numpy(zero_copy_only=False)]), np.concatenate([mask, np.repeat(mask, further)])


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(anchor, around, known), and the segment of each with its surroundings, for the places asked of each text."""
    place = np.arange(SEGMENT)
    for batch in batches:
        for group in groups(batch.column(0).field("text")):
            line, begin = spaced(group)
            text, (pos, anchor, around, known, low, n) = _asked(batch.column(1), group.first, group.first + len(group))
            for lo in range(0, len(pos), 20_000):
                part = slice(lo, lo + 20_000)
                left, start = begin[text[part]] + pos[part] - REACH, low[part, None].astype(np.int64)
                inside = (place >= start) & (place < start + n[part, None] + WINDOW - 1)
                yield [anchor[part], around[part], known[part]], np.where(inside, line[left[:, None] + place], np.uint64(0))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (anchor, around, known), rows in _cut_segments(batches):
        data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
        offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * (8 * SEGMENT)).tobytes())
        segment = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, data])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(around), pa.array(known), segment], names=["anchor", "around", "known", "segment"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(anchor, o, w, around, other, known, bits)``: each window of the segments once, and one row (o = -1) for all that a segment has."""
    for (anchor, around, known), h in _cut_segments(batches):
        present = np.zeros(len(h), np.int32)
        for o in range(OFFSETS):
            part = h[:, o : o + WINDOW]
            there = np.flatnonzero((part != 0).all(axis=1))
            present[there] |= 1 << o
            acc = np.zeros(len(there), np.uint64)
            for j in range(WINDOW):
                acc = acc * _A + mixed(part[there, j])
            w = mixed(acc).view(np.int64)
            there, w = there[order := np.lexsort((w, anchor[there]))], w[order]
            new = np.flatnonzero((np.diff(w, prepend=w[:1] + 1) != 0) | (np.diff(anchor[there], prepend=anchor[there][:1] + 1) != 0))
            if len(new):
                least, most = (f.reduceat(around[there], new) for f in (np.minimum, np.maximum))
                yield _window_rows(anchor[there[new]], o, w[new], least, most, np.logical_or.reduceat(known[there], new), np.full(len(new), 1 << o, np.int32))
        yield _window_rows(anchor, -1, around, around, around, known, present)


def _window_rows(anchor, o, w, around, other, known, bits) -> pa.RecordBatch:
    columns = [anchor, np.full(len(anchor), o, np.int32), w, around, other, known, bits]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "o", "w", "around", "other", "known", "bits"])


def _texts_asked(keyed: DataFrame, sent: DataFrame) -> DataFrame:
    """``(row, sent)``: one row of each text with the places to cut out of it."""
    owner = keyed.groupBy("t").agg(F.min("row.doc_id").alias("owner"))
    lists = sent.groupBy("t").agg(F.collect_list(F.struct("pos", "anchor", "around", "known", "low", "n")).alias("sent")).join(owner, "t")
    own = F.col("row.doc_id")
    # told by order, so that t stays the only key of the join
    same = (own.isNull() & F.col("owner").isNull()) | ((own <= F.col("owner")) & (own >= F.col("owner")))
    return keyed.join(lists, "t").where(same).select("row", "sent")


def _masks(keyed: DataFrame, sent: DataFrame) -> DataFrame:
    """``(anchor, around, mask)`` of the segments sent whose surroundings occur once: shards for most anchors, counts for the hot ones."""
    hot = F.col("k") > HOT_SURROUNDINGS
    n = sent.agg(F.count("*").alias("n"), F.coalesce(F.sum(hot.cast("int")), F.lit(0)).alias("hot")).first()
    shards = max(64, -(-(n["n"] - n["hot"]) // SEGMENTS_PER_SHARD))
    cold = _texts_asked(keyed, sent.where(~hot)).mapInArrow(_segments, "anchor long, around long, known boolean, segment binary")
    by_index = cold.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(_shard, "anchor long, around long, mask int")
    if not n["hot"]:
        return by_index
    # no window is joined back: those of one surroundings only are taken off the windows that it has
    windows = _texts_asked(keyed, sent.where(hot)).mapInArrow(_window_hashes, "anchor long, o int, w long, around long, other long, known boolean, bits int")
    lone = windows.groupBy("anchor", "o", "w").agg(F.min("around").alias("around"), F.max("other").alias("other"), F.max("known").alias("known"), F.max("bits").alias("bits"))
    lone = lone.where("around = other and not known")
    held = lone.groupBy("anchor", "around").agg(F.bit_or(F.when(F.col("o") < 0, F.col("bits")).otherwise(0)).alias("present"), F.bit_or(F.when(F.col("o") < 0, 0).otherwise(F.col("bits"))).alias("lone"))
    by_count = held.select("anchor", "around", F.col("present").bitwiseAND(F.bitwise_not("lone")).alias("mask")).where("mask <> 0")
    return by_index.unionByName(by_count)


def covered_windows(keyed: DataFrame) -> DataFrame:
    """``(t, pos, more, mask)``: bit o says that the window starting at word ``pos - 27 + o`` of text t starts elsewhere too.

    The same holds at the places listed in ``more``. Exact copies of a text count as one text here. The joins give each row of
    ``occurrences`` one mask at most.
    """
    twice = cut(occurrences(keyed, whole=False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    shared = cut(occurrences(keyed).join(twice, "anchor", "left_semi").dropDuplicates())
    place = F.struct("t", "pos", "low", "n")
    kinds = shared.groupBy("anchor", "around").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.bool_or(F.col("more").isNotNull()).alias("again"))
    kinds = cut(kinds.select("anchor", "around", "a.t", "a.pos", "a.low", "a.n", (F.col("again") | (F.col("a") != F.col("b"))).alias("known")))
    varied = kinds.groupBy("anchor").agg(F.count("*").cast("int").alias("k"), F.bool_and("known").alias("all_known"))
    sent = cut(kinds.join(varied.where("k > 1 and not all_known").select("anchor", "k"), "anchor"))
    full = kinds.where("known").select("anchor", "around", F.expr("shiftleft(shiftleft(1, cast(n as int)) - 1, cast(low as int))").alias("mask"))
    return shared.join(full.unionByName(_masks(keyed, sent)), ["anchor", "around"]).select("t", "pos", "more", "mask")


def removed_words(edges: np.ndarray, text: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which words of a group's texts are in a window that starts elsewhere too; pos -1 stands for a copy of a whole text."""
    edge, sizes = np.zeros(int(edges[-1]) + WINDOW + 1, np.int32), np.diff(edges)
    row, o = np.nonzero(mask[:, None] >> np.arange(OFFSETS) & 1)
    at = pos[row] - REACH + o
    row, at = row[good := (at >= 0) & (at + WINDOW <= sizes[text[row]])], at[good]
    np.add.at(edge, edges[text[row]] + at, 1)
    np.subtract.at(edge, edges[text[row]] + at + WINDOW, 1)
    copies = text[(pos < 0) & (sizes[text] >= WINDOW)]
    np.add.at(edge, edges[copies], 1)
    np.subtract.at(edge, edges[copies + 1], 1)
    return np.cumsum(edge)[: int(edges[-1])] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: ``(doc_id, n_words, n_removed, kept_sha256)``, with keep_text also the words kept, joined by a space.

    ``carry`` names string columns that go along.

    A word goes if any 35-word window over it starts anywhere else, in another row or in the same one. NULL and empty texts
    have no words; texts under 35 words lose nothing; repeated rows count as copies of each other and lose all words that
    windows cover; an empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col, carry)
    copies = keyed.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t", F.lit(-1).alias("pos"), F.lit(None).cast("array<int>").alias("more"), F.lit(0).alias("mask"))
    covered = covered_windows(keyed).unionByName(copies).groupBy("t").agg(F.collect_list(F.struct("pos", "mask", "more")).alias("found"))
    extra = ", kept string" if keep_text else ""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).flatten()
            for group in groups(own[1]):
                lo, hi = group.first, group.first + len(group)
                text, pos, mask = _places(batch.column(1), lo, hi)
                gone = removed_words(group.edges, text, pos, mask)
                data, bounds = kept_text(group, ~gone)
                before = np.concatenate([[0], np.cumsum(gone)])
                joined = data.tobytes()
                shas = [hashlib.sha256(memoryview(joined)[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [own[0].slice(lo, hi - lo), pa.array(np.diff(group.edges)), pa.array(np.diff(before[group.edges])), pa.array(shas, pa.string())]
                if keep_text:
                    kept = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(joined)])
                    columns.append(kept.cast(pa.string()))
                columns += [c.slice(lo, hi - lo) for c in own[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.join(covered, "t", "left").select("row", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + extra + "".join(f", `{c}` string" for c in carry))
