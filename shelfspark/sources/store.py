"""The stored mart: datasets of a build, written once to a shared folder and read with pruned partitions.

A build stands for what it was made of: the retailer, the identity of the source files and the version of the build. A
dataset of a build is written when it is first asked for; a record written behind it says that it is whole, so a build that
broke off is written again. Partitions are retailer, source, period grain, month and build, so scans of a scope, a range of
months or a build read their files only, and a corrected month replaces its own partition and no other.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import FACT_PARTITIONS

VERSION = "mart_v4"
RETAILER, SOURCE, GRAIN = "retailer_a", "source_a", "month"
SOURCE_TABLES = ("lineitem", "part", "supplier", "nation", "region")
_local: dict[str, str] = {}


def mart_root(spark: SparkSession) -> str:
    """``spark.shelfspark.mart.dir``, else a folder beside the checkpoints; only a local master may go without either and take a temporary folder."""
    if found := spark.conf.get("spark.shelfspark.mart.dir", None):
        return found
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/shelfspark-mart"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.shelfspark.mart.dir or spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-mart-"))


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles goes when it is done, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_hash(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = SOURCE_TABLES) -> str:
    """Identity of the source files: names, lengths and times of change; no content is read and one row reaches the driver."""
    files = reduce(DataFrame.union, [spark.read.format("binaryFile").load(f"{sf_dir}/{n}.parquet").select(F.lit(n).alias("name"), "path", "length", "modificationTime") for n in names])
    own = F.xxhash64("name", F.regexp_extract("path", "[^/]+$", 0), "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(own).alias("h"), F.sum(own.cast("decimal(38,0)")).alias("s")).first()
    return "-".join(str(x) for x in row)


@dataclass(frozen=True)
class Build:
    """A build of the mart and where it lies."""

    spark: SparkSession
    root: str
    mart_build_id: str
    source_revision_id: str

    def _record(self, name: str) -> str:
        return f"{self.root}/builds/{name}/{self.mart_build_id}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return _exists(self.spark, f"{self._record(name)}/_SUCCESS")

    def write(self, name: str, rows: DataFrame, months: str = "period") -> None:
        """Stores rows as a dataset of this build; only the months in ``rows`` are replaced. A large month is split over tasks."""
        scope = {"retailer_id": RETAILER, "source_id": SOURCE, "period_grain": GRAIN, "mart_build_id": self.mart_build_id}
        placed = rows.withColumnRenamed(months, "period_start").withColumns({k: F.lit(v) for k, v in scope.items()})
        with shuffle_files_dropped(self.spark):
            placed.hint("rebalance", "period_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*FACT_PARTITIONS).parquet(self.path(name))

    def seal(self, name: str) -> None:
        """Says that a dataset of this build is whole."""
        rows = self.spark.createDataFrame([(RETAILER, SOURCE, self.mart_build_id, self.source_revision_id, name, VERSION)], "retailer_id string, source_id string, mart_build_id string, source_revision_id string, dataset string, build_version string")
        rows.coalesce(1).write.mode("overwrite").parquet(self._record(name))

    def read(self, name: str, months: str = "period") -> DataFrame:
        """The stored rows of this build; filters on their months reach the partitions."""
        rows = self.spark.read.parquet(self.path(name)).where((F.col("retailer_id") == RETAILER) & (F.col("source_id") == SOURCE) & (F.col("mart_build_id") == self.mart_build_id))
        return rows.withColumnRenamed("period_start", months)

    def dataset(self, name: str, make: Callable[[], DataFrame], months: str = "period") -> DataFrame:
        """The dataset as stored; written first if it is not there. An empty one is stored as its schema alone."""
        if not self.has(name):
            rows = make()
            self.write(name, rows, months)
            if not _exists(self.spark, f"{self.path(name)}/retailer_id={RETAILER}"):
                return rows
            self.seal(name)
        return self.read(name, months)


def open_build(spark: SparkSession, sf_dir: str) -> Build:
    """The build of the given source files."""
    held = content_hash(spark, sf_dir)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    revision, build = digest(f"{RETAILER}|{SOURCE}|{held}"), digest(f"{RETAILER}|{held}|{VERSION}")
    return Build(spark, mart_root(spark), f"mart_build_{build}", f"source_revision_{revision}")
