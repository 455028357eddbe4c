"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Spark's setting (since 4.1) by which an execution that ends removes its shuffle files.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master (tests) may go without one and take a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that later steps read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise narrow intermediate rows in the shared checkpoint folder, so lost executors cost only a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile remove their shuffle files once executed, not when the driver happens to collect its garbage.

    For chains of many cut() steps: what a step has shuffled is not read again once its rows are in the shared folder. A
    plan made here that is executed twice would shuffle anew, so each should be cut or be a part of a later plan.
    """
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def null_safe_text(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
