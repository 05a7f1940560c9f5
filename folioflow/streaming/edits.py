"""The edit queue as a stream: micro-batches are folded into the latest state of each book, under the version fence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.review import apply_edits, fenced_latest

SCHEMA = "book long, seq long, fp long, idx long, text string"


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _pending(spark: SparkSession, state: str, rows: DataFrame) -> DataFrame:
    """rows without those that were acknowledged: of a book's version, up to a place in its queue."""
    acks = f"{state}_acks"
    if not _exists(spark, acks):
        return rows
    done = spark.read.schema("book long, fp long, upto long").parquet(acks).groupBy(F.col("book").alias("done_book"), F.col("fp").alias("done_fp")).agg(F.max("upto").alias("upto"))
    same = (F.col("book") == F.col("done_book")) & F.coalesce(F.col("fp") == F.col("done_fp"), F.lit(True)) & (F.col("seq") <= F.col("upto"))
    return rows.join(done, same, "left_anti")


def write_state(queue: DataFrame, state: str, checkpoint: str):
    """A query that keeps each batch's state under its number; a replayed batch overwrites its own, so that results are exact. The state before the last is removed."""
    spark = queue.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        rows = batch.select("book", "idx", "text", "fp", "seq")
        if n:
            rows = _pending(spark, state, spark.read.parquet(f"{state}/batch={n - 1}").select(*rows.columns)).unionByName(rows)
        fenced_latest(rows).select(*rows.columns).write.mode("overwrite").parquet(f"{state}/batch={n}")
        if n > 1:
            _remove(spark, f"{state}/batch={n - 2}")

    return queue.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The edits that wait: the last batch's state without what was acknowledged since."""
    every = spark.read.parquet(state)
    last = every.agg(F.max("batch")).first()[0]
    return _pending(spark, state, every.filter(F.col("batch") == last).drop("batch"))


def acknowledge(spark: SparkSession, state: str, applied: DataFrame) -> None:
    """Clears what was applied (book, fp, upto): a book's edits of that version, or of none, up to that place. Edits of another version, and later ones, wait on; acknowledging again changes nothing."""
    applied.select(F.col("book").cast("long"), F.col("fp").cast("long"), F.col("upto").cast("long")).write.mode("append").parquet(f"{state}_acks")


def drain(spark: SparkSession, state: str, paras: DataFrame, versions: DataFrame) -> DataFrame:
    """paras (book, idx, src, text) with the waiting edits of the present versions (book, fp, count) applied; acknowledge() them once the result is kept."""
    edits = read_state(spark, state).join(versions.select("book", "count"), "book")
    shaped = edits.select("book", F.col("idx").cast("string").alias("key"), F.lit(False).alias("has_src"), F.lit(None).cast("string").alias("src"), F.lit(True).alias("has_text"), "text", "fp", "count")
    return apply_edits(paras, shaped, versions)
