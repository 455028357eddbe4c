"""Incremental rebuild by affected months, and micro-batch ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affected_periods(changed: DataFrame) -> DataFrame:
    """The months of a new revision and the months that compare with them (one and twelve months later)."""
    base = changed.select("period").distinct()
    return base.select(F.explode(F.array("period", F.add_months("period", 1), F.add_months("period", 12))).alias("period")).distinct()


def rebuild(rows: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The build over the affected months only; the result replaces these partitions."""
    return build(rows.join(F.broadcast(affected_periods(changed)), "period", "left_semi"))  # months are few


def write_back(rows: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, month: str = "period") -> None:
    """Rebuilds the affected months and replaces their partitions of a table stored by month; the files of other months stay as they are."""
    made = rebuild(rows, changed, build)
    made.hint("rebalance", month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def ingest_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs the sink on each micro-batch of newly arrived files, then stops; progress is kept in ``checkpoint``."""
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
