"""The corpus pipeline: filter, deduplicate, mix, encode. Each stage calls one corpus operator on all documents it gets.

A row is told by all its columns and not by its id, so documents without id or with the same id stay apart. Every stage
takes NULLs in any column, empty and very long texts, repeated rows and an empty table; its docstring says what becomes of
them. Columns other than those of documents are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import fm_dedup, golay_simhash, mixing, piece_codec, weak_quality
from shelfspark.llm.common import WORD_PATTERN, shared_folder, shuffle_files_dropped, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_tag() -> Column:
    """128 bits that stand for a row; equal rows have equal tags."""
    return F.concat(F.hex(F.xxhash64(*COLUMNS)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), *COLUMNS)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go. NULL and empty texts are judged like any other; repeated rows share a verdict."""
    return weak_quality.keep_good(docs, labels=table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that with the smallest id, ids before NULL, then the smallest tag.

    NULL and empty texts form one group. Rows of one id with different texts are different documents.
    """
    with shuffle_files_dropped(spark):  # dozens of steps, each with files for every task
        groups = golay_simhash.near_duplicates(docs, width=5, similarity=0.8, tag=row_tag())
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("first")).select(F.col("first.tag").alias("tag"))
    tagged = docs.select(*COLUMNS, row_tag().alias("tag")).join(kept, "tag", "left_semi")
    return tagged.dropDuplicates(["tag"]).select(*COLUMNS)  # equal rows only


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated 35-word windows go; a document without words left, or without any before, goes with them.

    Repeated rows are copies of each other and lose all words that windows cover.
    """
    kept = fm_dedup.dedup_substrings(docs, keep_text=True, carry=("lang", "source"))
    return kept.where("kept <> ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are rows.

    In each source one document is taken in part: it gets one more row with the first words only, joined by one space, so
    that the words of a source are its target. Documents that the mix does not take go; among them are those without words.
    """
    mix = mixing.mix_sources(docs, tag=row_tag()).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    # equal rows are taken one after another: their whole copies add up, and what is cut is listed
    takes = mix.groupBy("tag").agg(F.sum(whole).cast("int").alias("times"), F.collect_list(F.when(rest > 0, rest)).alias("rests"))
    takes = takes.select("tag", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("times")), "rests")).alias("words"))
    tagged = docs.select(*COLUMNS, row_tag().alias("tag")).dropDuplicates(["tag"])
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0), 1, F.col("words").cast("int")), " ")
    out = tagged.join(takes, "tag").withColumn("text", F.when(F.col("words") > 0, part).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row as digests (doc_id, n_tokens, ids_sha256, decoded_sha256); NULL is the empty text."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return piece_codec.encode_texts(docs, model)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("piece encoding", encoding_stage),
]

#: No stage but the mixing can be told in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
