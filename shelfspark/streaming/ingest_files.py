"""Micro-batch ingestion of source files: ledger, canonical rows and facts of the affected months, each file's content once.

State lies in three tables below a root folder. ``canonical`` is partitioned by month and batch, ``facts`` by month and
``ledger`` by batch, so a batch that is run again after a failure replaces what it wrote before. A file is told by its
content, not by its name, and its ledger entry is written last: a file that comes again, in this batch or a later one, is
recorded as a duplicate and its rows are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.mart import register_sources
from .incremental import affected_periods

_LEDGER = "retailer_id string, source_id string, content_hash string, file string, n_rows long, registration string, batch bigint"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{root}/ledger") if exists(spark, f"{root}/ledger") else spark.createDataFrame([], _LEDGER)


def content_hash(columns: list[str]) -> Column:
    """Identity of a set of rows, whatever their order: count, sum and exclusive or of row hashes."""
    own = F.xxhash64(*columns)
    return F.concat_ws("-", F.count("*").cast("string"), F.sum(own.cast("decimal(38,0)")).cast("string"), F.hex(F.bit_xor(own)))


def ingest_batch(rows: DataFrame, batch: int, root: str, columns: tuple[str, ...], build: Callable[[DataFrame], DataFrame], retailer_id: str, source_id: str) -> None:
    """One micro-batch of rows with their ``file``: registers its files, adds the rows of new ones and rebuilds the months they touch.

    ``build`` makes facts with a column period from canonical rows. The files of a batch are a bounded number.
    """
    spark = rows.sparkSession
    files = rows.groupBy("file").agg(content_hash(list(columns)).alias("content_hash"), F.count("*").alias("n_rows"))
    incoming = files.select(F.lit(retailer_id).alias("retailer_id"), F.lit(source_id).alias("source_id"), "content_hash", "file", "n_rows")
    known = ledger(spark, root).where((F.col("batch") != batch) & (F.col("registration") != "IDENTICAL_DUPLICATE"))
    first = F.row_number().over(Window.partitionBy("retailer_id", "source_id", "content_hash").orderBy("file")) == 1
    entries = register_sources(incoming, known).withColumn("registration", F.when(first, F.col("registration")).otherwise("IDENTICAL_DUPLICATE"))
    entries = entries.select("retailer_id", "source_id", "content_hash", "file", "n_rows", "registration", F.lit(batch).cast("long").alias("batch")).cache()
    taken = entries.where("registration <> 'IDENTICAL_DUPLICATE'").select("file")
    fresh = rows.join(F.broadcast(taken), "file", "left_semi").select(*columns, F.lit(batch).cast("long").alias("batch"))
    _overwrite(fresh, f"{root}/canonical", "period", "batch")
    if taken.take(1):
        stored = spark.read.parquet(f"{root}/canonical")
        months = affected_periods(stored.where(F.col("batch") == batch))  # months are few
        touched = stored.join(F.broadcast(months), "period", "left_semi").select(*columns)
        _overwrite(build(touched), f"{root}/facts", "period")
    _overwrite(entries, f"{root}/ledger", "batch")
    entries.unpersist()


def ingest_files(spark: SparkSession, landing: str, root: str, schema, build: Callable[[DataFrame], DataFrame], retailer_id: str, source_id: str, files_per_batch: int = 32) -> None:
    """Takes all files that have arrived since the last call, some at a time, and stops; where it stopped is kept below the root."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(landing)
    columns = tuple(stream.columns)
    named = stream.withColumn("file", F.col("_metadata.file_path"))
    sink = lambda rows, batch: ingest_batch(rows, batch, root, columns, build, retailer_id, source_id)
    named.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
