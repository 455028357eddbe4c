import hashlib

import public_tokenizers
import pytest
import sentencepiece

from shelfspark.llm.piece_codec import ChunkTable, encode_texts

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = ["", " ", "  ", "a ", " a", "a  b  ", "▁x", "x▁", "▁ ", "\n \n", "日本語 テスト", "<s>x</s> <unk>", "\x00a b", "a b", "é Å ﬁ", " ▁a▁ ", "😀 x😀", "x" * 300 + " y"]


@pytest.mark.parametrize("text", ODD)
def test_ids_and_text_equal_the_library(text):
    ids = ChunkTable(MODEL).encode(text)
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert ChunkTable(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_query_equals_the_library_on_whole_texts(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = sorted(map(tuple, encode_texts(docs, MODEL).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_texts(no_docs, MODEL).count() == 0


def test_a_full_table_changes_nothing():
    small, text = ChunkTable(MODEL, entries=2), "one two three one four five two one"
    assert [small.encode(text) for _ in range(3)] == [LIBRARY.encode(text, add_eos=True)] * 3
