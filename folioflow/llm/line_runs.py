"""Line de-duplication over levelled sorted runs of line hashes, with DataFrame expressions only.

Each batch of documents is summed to one row for each line key. The batch is merge-anti-joined with the runs that are there: what is left is
new and becomes a run of its own, so that a key stands in one run only, with what its first batch counted; what later batches add to it
goes to a log of additions, which is small as most lines occur once. When a level holds two runs they are merged into one run of the next level, by a
full outer merge join. Batches and runs are tables in buckets of the key's hash, sorted by key, so that neither exchanges nor sorts stand
before these joins. Keys are 128 bits of hash.

Defined results: null or empty text is one empty line; documents with the same doc_id count as one holder; a null
doc_id is one holder, below all others; ties have no effect, as holders are ordered by doc_id alone; an empty
table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Tables, ascii_lower, cut, fresh, sized

#: Keys shorter than this are never dropped.
LEAST_CHARS = 40
#: Keys in fewer documents than this are never dropped.
LEAST_DOCS = 5
#: Batches that a whole table is dealt into.
BATCHES = 3
#: Key rows of a bucket that are aimed at, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashes_of(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Rows h1, h2, id: a line key of at least least_chars code points and a document that holds it, once each."""
    # The length test runs on the raw line first: a key is never longer than its line.
    long = F.filter(lines_of(F.col(text_col)), lambda x: F.length(x) >= least_chars)
    keys = F.array_distinct(F.filter(F.transform(long, key_of), lambda x: F.length(x) >= least_chars))
    each = docs.filter(F.length(text_col) >= least_chars).select(F.col(id_col).alias("id"), F.explode(keys).alias("key"))
    return each.select(hashes_of(F.col("key")).alias("h"), "id").select("h.*", "id").distinct()


class LineRuns:
    """The levelled runs and the additions. A run has a row for each key: h1, h2, n (holders in its first batch), top (the largest of them).

    state() can be kept, and LineRuns(spark, state=...) goes on from there in the same session; a document's rows must come in one batch.
    """

    SCHEMA = "h1 long, h2 long, n long, top long"

    def __init__(self, spark: SparkSession, buckets: int = 64, state: dict | None = None):
        self.spark = spark
        state = state or {"name": f"line_runs_{uuid.uuid4().hex}", "root": Tables(spark).root, "buckets": buckets, "made": 0, "levels": {}, "additions": []}
        self.name, self.buckets, self.made, self.levels, self.additions = (state[k] for k in ("name", "buckets", "made", "levels", "additions"))
        self.tables = Tables(spark, state["root"])

    def state(self) -> dict:
        return {"name": self.name, "root": self.tables.root, "buckets": self.buckets, "made": self.made, "levels": self.levels, "additions": self.additions}

    def _write(self, df: DataFrame) -> str:
        """df as a table in sorted buckets."""
        name = f"{self.name}_{self.made}"
        self.made += 1
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", self.tables.path(name)).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.remove(name)

    @contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        """Buckets of one file keep their order when they are read, and are not dealt anew."""
        keys = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
        before = {k: self.spark.conf.get(k, None) for k in keys}
        for k, v in keys.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def runs(self) -> list[str]:
        return [n for level in sorted(self.levels) for n in self.levels[level]]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (a table of this layout) whose key no run holds: a chain of merge anti-joins with the sorted runs."""
        for name in self.runs():
            batch = batch.hint("merge").join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of line_keys rows."""
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").cast("long").alias("top"))
        name = self._write(own.repartition(self.buckets, "h1", "h2"))
        with self._sorted_scans():
            if self.runs():
                whole = self.spark.table(name)
                new = self._write(self.unseen(whole))
                more = whole.hint("merge").join(self.spark.table(new).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
                self.tables.write(more, f"more-{self.made}")
                self.additions.append(f"more-{self.made}")
                self._drop(name)
                name = new
            self.levels.setdefault(0, []).append(name)
            level = 0
            while len(self.levels.get(level, [])) == 2:
                old = self.levels.pop(level)
                self.levels.setdefault(level + 1, []).append(self._write(self._merged(*old)))
                for n in old:
                    self._drop(n)
                level += 1

    def _merged(self, one: str, two: str) -> DataFrame:
        """Two runs, which have no key in common, as one."""
        a, b = (self.spark.table(n).hint("merge") for n in (one, two))
        both = a.select("h1", "h2", F.col("n").alias("n_a"), F.col("top").alias("top_a")).join(b, ["h1", "h2"], "full_outer")
        return both.select("h1", "h2", F.coalesce("n_a", "n").alias("n"), F.when(F.col("n_a").isNotNull(), F.col("top_a")).otherwise(F.col("top")).alias("top"))

    def common(self, least_docs: int) -> DataFrame:
        """Rows h1, h2, top of the keys that least_docs documents or more hold."""
        empty = self.spark.createDataFrame([], self.SCHEMA)
        if not self.runs():
            return cut(empty.select("h1", "h2", "top"))
        logs = [self.tables.read(n, empty) for n in self.additions] or [empty]
        more = reduce(DataFrame.unionByName, logs).groupBy("h1", "h2").agg(F.sum("n").alias("more"), F.max("top").alias("top_more"))
        found = []
        with self._sorted_scans():
            for name in self.runs():
                both = self.spark.table(name).join(more, ["h1", "h2"], "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= least_docs)
                found.append(both.select("h1", "h2", F.greatest("top", "top_more").alias("top")))
            return cut(reduce(DataFrame.unionByName, found))

    def remove(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.tables.remove()


def _doomed(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int, batches: int) -> DataFrame:
    """Rows id, doomed: the key hashes that a document loses."""
    spark = docs.sparkSession
    stash = Tables(spark)
    keys = line_keys(docs, id_col, text_col, least_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    keys = stash.write(keys, "keys")
    runs = LineRuns(spark, min(MOST_BUCKETS, max(8, -(-keys.count() // BUCKET_ROWS))))
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k).select("h1", "h2", "id"))
    common = sized(runs.common(least_docs), 24)
    lost = keys.join(common, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("top")))
    lost = cut(lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("doomed")))
    runs.remove()
    stash.remove()
    return lost


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the kept text, n_lines (before dropping) and n_dropped."""
    doomed = _doomed(docs, id_col, text_col, least_chars, least_docs, batches)
    key, gone = fresh("id", docs.columns), fresh("doomed", docs.columns)
    n_lines, n_dropped = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    doomed = doomed.select(F.col("id").alias(key), F.col("doomed").alias(gone))
    # The small side is hashed within each partition, so the texts are dealt once and not sorted.
    out = docs.join(doomed.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(key)), "left")
    lines = lines_of(F.col(text_col))

    def stays(line: Column) -> Column:
        k = key_of(line)
        return (F.length(line) < least_chars) | (F.length(k) < least_chars) | ~F.array_contains(F.col(gone), hashes_of(k))

    out = out.withColumn(n_lines, F.size(lines).cast("long"))
    out = out.withColumn(gone, F.when(F.col(gone).isNotNull(), F.filter(lines, stays)))
    out = out.withColumn(n_dropped, F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.col(n_lines) - F.size(gone)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(gone, "\n")))
    return out.drop(key, gone)
