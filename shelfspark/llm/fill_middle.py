"""Fill-in-middle transformation: documents cut at two line bounds and put in prefix, suffix, middle order.

The ends of a text's lines are kept as a set of character offsets in the manner of Roaring bitmaps: offsets with equal upper
bits share a container, which is a sorted array, a bitmap or a list of runs, whichever is smallest; cumulative cardinalities
over the containers and within them lead from "the k-th line end" to its offset by two searches. Both cuts are such look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters looked at in one go, so that memory beside the text stays bounded.
STRIDE = 1 << 20
ARRAY_MOST = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class _Array:
    def __init__(self, low: np.ndarray) -> None:
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << 16, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest bit
        return at * 64 + (word & -word).bit_length() - 1


class _Runs:
    def __init__(self, low: np.ndarray, first: np.ndarray) -> None:
        self.start = low[first]
        self.before = first  # how many offsets stand before each run

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest container of sorted distinct 16-bit offsets: two bytes each, 8 KB, or four bytes a run."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    plain = 2 * len(low) if len(low) <= ARRAY_MOST else 8192
    if 4 * len(first) < plain:
        return _Runs(low, first)
    return _Array(low) if len(low) <= ARRAY_MOST else _Bitmap(low)


class BoundarySet:
    """A set of growing offsets with ``len`` and ``select(k)``, the k-th smallest from 0."""

    def __init__(self) -> None:
        self.high: list[int] = []
        self.parts: list[_Array | _Bitmap | _Runs] = []
        self.before = [0]
        self._open: list[np.ndarray] = []

    def extend(self, offsets: np.ndarray) -> None:
        """Adds offsets, all of them beyond those added before."""
        high = offsets >> 16
        edges = [0, *(np.flatnonzero(np.diff(high)) + 1).tolist(), len(offsets)] if len(offsets) else []
        for lo, hi in zip(edges, edges[1:]):
            if self._open and int(high[lo]) != self.high[-1]:
                self.close()
            if not self._open:
                self.high.append(int(high[lo]))
            self._open.append((offsets[lo:hi] & 0xFFFF).astype(np.int32))

    def close(self) -> BoundarySet:
        """Packs the last container."""
        if self._open:
            low = np.concatenate(self._open)
            self.parts.append(container(low))
            self.before.append(self.before[-1] + len(low))
            self._open = []
        return self

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.high[at] << 16) + self.parts[at].select(k - self.before[at])


def line_ends(text: str) -> BoundarySet:
    """Offsets, in code points, behind each unit of ``[^\\n]*\\n|[^\\n]+``."""
    ends = BoundarySet()
    for lo in range(0, len(text), STRIDE):
        codes = np.frombuffer(text[lo : lo + STRIDE].encode("utf-32-le", "surrogatepass"), "<u4")
        ends.extend(np.flatnonzero(codes == 10) + lo + 1)
    if text and text[-1] != "\n":
        ends.extend(np.array([len(text)]))
    return ends.close()


def cut_offsets(ends: BoundarySet, a: int, b: int) -> tuple[int, int]:
    """Offsets behind the first min(a, b) and max(a, b) units."""
    lo, hi = sorted((a, b))
    return ends.select(lo - 1) if lo else 0, ends.select(hi - 1) if hi else 0


def transformed(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text again, from what was put out and its form; the parts hold no sentinel and none can arise where they meet one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def draws(seed: int, id_col: Column) -> list[Column]:
    """Four 32-bit numbers of a document: the first groups of eight digits of sha256 of ``seed:id``; a NULL id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


_SENTINEL = re.compile("<[PSM]>")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output, restored)`` per row of docs.

    n is the number of lines; form is "psm" or "spm", or "plain" where the text stays as it is: empty and NULL texts, texts
    that hold a sentinel, and all but ``rate`` in a hundred. output is the transformed text, restored the text rebuilt from
    it. Cuts depend on seed and id only, so rows that repeat an id and a text come out alike, and all rows without id draw
    alike. A text without line breaks is one line; texts of any length are cut whole, about a million characters at a time.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, h3, h4 = (batch.column(k).to_pylist() for k in range(2, 6))
            out: dict[str, list] = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output", "restored")}
            for k, text in enumerate(batch.column(1).to_pylist()):
                ends = line_ends(text)
                n, form = len(ends), "plain"
                a = b = None
                if text and h3[k] % 100 < rate and not _SENTINEL.search(text):
                    form = "spm" if h4[k] % 100 < spm_rate else "psm"
                    a, b = cut_offsets(ends, h1[k] % (n + 1), h2[k] % (n + 1))
                    text = transformed(text[:a], text[a:b], text[b:], form)
                for name, value in zip(out, (n, form, a, None if b is None else b - a, text, restored(text, form)), strict=True):
                    out[name].append(value)
            kinds = {"form": pa.string(), "output": pa.string(), "restored": pa.string()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {name: pa.array(v, kinds.get(name, pa.int64())) for name, v in out.items()})

    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(seed, doc), 1)])
    return rows.mapInArrow(run, _SCHEMA)
