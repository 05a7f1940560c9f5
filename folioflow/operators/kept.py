"""What operators keep between jobs: frames cut from their lineage, and small sides of a measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below both of these, which are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder without its lineage; its partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a task of a join or fold is dealt: their number sets that of the partitions, so that what a task holds does not grow with the tables.
TASK_ROWS = 1 << 20


def spread(rows: int, df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as so many rows need, the cores' number at least; frames spread alike join without another exchange."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def sized(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """df (already cut, or cheap) with a broadcast hint if its measured rows and bytes are under the bounds; else df as it is."""
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
