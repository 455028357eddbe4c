"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python object for each word.

Texts are taken in groups of about GROUP_BYTES, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
#: White space of the corpus contracts: space and the ASCII controls tab to carriage return.
_LOWER = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95 - 2  # 3 modulo 8, so that its powers differ in low bits
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _power_tables() -> list[np.ndarray]:
    """Powers of _STEP and of its inverse, made once a process."""
    if not _powers:
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            out, at = np.ones(GROUP_BYTES, np.uint64), 1
            while at < GROUP_BYTES:
                out[at : 2 * at] = out[: min(at, GROUP_BYTES - at)] * np.uint64(pow(base, at, 1 << 64))
                at *= 2
            _powers.append(out)
    return _powers


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:stop]``, never zero; a word's hash does not depend on where it stands."""
    power, inverse = _power_tables()
    out, lo = np.zeros(len(start), np.uint64), 0
    while lo < len(start):
        first = start[lo]
        hi = max(lo + 1, int(np.searchsorted(stop, first + GROUP_BYTES, "right")))
        if stop[hi - 1] - first > GROUP_BYTES:  # a word longer than a group
            total, shift = 0, 1
            for at in range(int(first), int(stop[lo]), GROUP_BYTES):
                part = data[at : min(int(stop[lo]), at + GROUP_BYTES)]
                total = (total + shift * int((_BYTE[part] * power[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
                shift = shift * pow(_STEP, len(part), 1 << 64) % (1 << 64)
            out[lo] = total
        else:
            part = data[first : stop[hi - 1]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * power[: len(part)], dtype=np.uint64)])
            out[lo:hi] = (sums[stop[lo:hi] - first] - sums[start[lo:hi] - first]) * inverse[start[lo:hi] - first]
        lo = hi
    return np.maximum(mixed(out + (stop - start).astype(np.uint64) * _B), np.uint64(1))


@dataclass
class Group:
    """Some texts of a column: their bytes, where each begins, and their words in order."""

    first: int  # the place of the first text in its batch
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte bounds of the texts
    start: np.ndarray  # byte places of the words
    stop: np.ndarray
    edges: np.ndarray  # n + 1 word bounds of the texts

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        return _hashes(self.data, self.start, self.stop)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 bounds) of a string column; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def groups(column: pa.Array, lower: bool = False) -> Iterator[Group]:
    """The texts of a column in groups of about GROUP_BYTES; a longer text is a group of its own. ``lower`` lower-cases A-Z."""
    data, bounds = text_buffers(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP_BYTES, "right")) - 1)
        own, part = bounds[lo : hi + 1] - bounds[lo], data[bounds[lo] : bounds[hi]]
        if lower:
            part = _LOWER[part]
        gap = _SPACE[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        inner = own[1:-1]
        before[inner[inner < len(part)]] = True
        after[inner[inner > 0] - 1] = True
        start, stop = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        yield Group(lo, part, own, start, stop, np.searchsorted(start, own))
        lo = hi


def kept_text(group: Group, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 bounds) of the kept words of each text, joined by one space."""
    data, mark = group.data.copy(), np.zeros(len(group.data) + 1, np.int8)
    start, stop = group.start[keep], group.stop[keep]
    mark[start] += 1
    np.subtract.at(mark, stop, 1)  # a word may end where the next text's word begins
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    text = np.searchsorted(group.bounds, start, "right") - 1
    joined = np.flatnonzero(text[:-1] == text[1:]) if len(text) else np.zeros(0, np.int64)
    data[stop[joined]] = 32
    inside[stop[joined]] = True
    before = np.concatenate([[0], np.cumsum(inside)])
    return data[inside], before[group.bounds]
