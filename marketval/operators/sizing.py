"""Measured sizes: which sides may be broadcast, which keys are hot, where lineage is cut."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

DATASET = ["market", "profile"]

# A dimension is broadcast only when it was counted at or below this many rows.
BROADCAST_ROWS = 100_000

# Folders of stored tables begin so.
WRITTEN = "written-"

# Removes a query's shuffle files when the query ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Dim:
    """A dimension table and whether it was counted small enough to broadcast, measured once.

    A table derived from another with a fixed number of rows per row shares its answer.
    """

    df: DataFrame
    parent: "Dim | None" = None

    @cached_property
    def fits(self) -> bool:
        if self.parent is not None:
            return self.parent.fits
        return self.df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def small(self, df: DataFrame | None = None) -> DataFrame:
        """Broadcast this table (or one derived row-for-row from it) when it was small."""
        chosen = self.df if df is None else df
        return F.broadcast(chosen) if self.fits else chosen


def as_dim(table: "Dim | DataFrame") -> Dim:
    return table if isinstance(table, Dim) else Dim(table)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a single-process session may leave it
    unset and gets a temporary one: on a cluster, executors could not read the driver's folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="marketval-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that a lost executor costs no long recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """A write made here leaves no shuffle files behind: nothing reads them after the table is stored."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again. Lineage ends there; unlike a
    checkpoint, the plan runs once, and later reads take only the columns and rows they need."""
    path = f"{shared_folder(df.sparkSession)}/{WRITTEN}{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove the stored tables of this session, once everything made from them has been read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"{WRITTEN}*")) or []
    return sum(1 for f in found if files.delete(f.getPath(), True))
