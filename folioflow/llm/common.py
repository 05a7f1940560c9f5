"""What the operators share: the shared folder, written tables, sized broadcasts and text rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: A word of the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only below both of these, which are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
#: Rows in one Arrow batch; their bytes are bounded by the session (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
ARROW_ROWS = 1000


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
    """df, computed once and kept in the shared folder without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Written tables of one run in the shared folder, removed together once their reader is done."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def remove(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """df (already cut) with a broadcast hint if its measured rows and bytes are under the bounds; else df as it is."""
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, unless the session already asks for fewer rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text (null: the empty text) modulo n."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores if a column of the input already has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
