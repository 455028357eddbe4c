"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses from a word into the next whitespace marker, so a text may be cut before every run of
markers and each chunk segmented alone. Each task keeps a table of the chunks it has met: a chunk is segmented and
rendered once, and texts are put together from the table by position. The table is emptied when it reaches a fixed number
of entries, so memory does not follow the corpus, and no word is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = re.compile("[ ▁]+[^ ▁]*")
TABLE_ENTRIES = 400_000
#: Longer chunks are segmented where they stand and not kept.
KEPT_CHARS = 64


def pieces_stay_in_words(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece holds a marker behind another character, which the chunk table needs."""
    return not any(
        "▁" in piece.lstrip("▁") for piece in map(processor.id_to_piece, range(processor.get_piece_size()))
    )


def marked_words(text: str) -> list[str | None]:
    """The chunks of a text, each without its first marker, which the library puts back; None for a marker alone at the end."""
    if "  " not in text and "▁" not in text and " " not in (text[:1], text[-1:]):
        return text.split(" ")
    return [c[1:] if len(c) > 1 else None for c in _CHUNK.findall(" " + text)]


class ChunkTable:
    """Distinct marked words -> their ids, as packed 32-bit integers."""

    def __init__(self, model: bytes, entries: int = TABLE_ENTRIES):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        if not pieces_stay_in_words(self.processor):
            raise ValueError("the model has pieces that cross whitespace markers")
        self.end = self.processor.eos_id()
        self.alone = array("i", [self.processor.piece_to_id("▁")]).tobytes()
        self.decimal = [str(i) for i in range(self.processor.get_piece_size())]
        self.entries, self.table = entries, {None: self.alone}

    def entries_of(self, chunks: list[str | None]) -> list[bytes]:
        """The entry of each chunk; those not met before are segmented in one call."""
        if len(self.table) > self.entries:
            self.table = {None: self.alone}
        found = list(map(self.table.get, chunks))
        if None not in found:
            return found
        new = list({c for c, f in zip(chunks, found, strict=True) if f is None})
        made = dict(zip(new, [array("i", ids).tobytes() for ids in self.processor.encode(new, num_threads=1)], strict=True))
        self.table.update((c, m) for c, m in made.items() if len(c) <= KEPT_CHARS)
        return [made[c] if f is None else f for c, f in zip(chunks, found, strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of whole texts with the end id, as the library gives them; looks up about 16k chunks at a time."""
        waiting, chunks = [], []
        for k, text in enumerate(texts, 1):
            own = marked_words(text) if text else []
            waiting.append(len(own))
            chunks += own
            if len(chunks) >= 16384 or k == len(texts):
                found, at = self.entries_of(chunks), 0
                for n in waiting:
                    ids = array("i", b"".join(found[at : at + n])).tolist()
                    ids.append(self.end)
                    yield ids
                    at += n
                waiting, chunks = [], []

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def shown(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens (end id included), ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded text.

    NULL and empty texts encode to the end id alone and decode to the empty text. Repeated rows and ids stay; other
    columns are ignored; an empty table gives no rows. ``model`` is the model file's bytes, which go along with the task.
    """
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            n, id_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for ids in table.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                back = table.decode(ids)
                n.append(len(ids))
                id_sha.append(hashlib.sha256(table.shown(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    decoded.append(back)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(id_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep_ids:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
