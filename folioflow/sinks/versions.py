"""A report that is flushed page by page, and runs that are put aside and brought back: tables of hashed buckets under numbered versions.

A version is one small JSON file that names the folders each table's buckets are read from. A flush writes the buckets that its rows fall into and a new version; all other
buckets keep their files. A version's file is moved into place whole, and only if none of that number is there, so that of two writers one wins and a writer
that dies leaves the version before as it was. Buckets are bounded by a parameter, so version files and what the driver holds are too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, unless it is told otherwise; a flush of one page rewrites one of them.
BUCKETS = 256
#: What a run that starts anew puts aside: translations alone, or pages and the book as well.
RESETS = {"xlat": ("xlat",), "all": ("xlat", "pages", "book")}
_BUCKET = "bucket_"


class Conflict(Exception):
    """Another writer has changed the same buckets since they were read."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _put(self, path: str, text: str) -> bool:
        """Writes a whole file, unless there is one of that name."""
        fs, whole, own = self._fs(), self._path(path), self._path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(own, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self._conf) if whole.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(own, whole, none)
            return True
        except Exception:
            if not fs.exists(whole):
                raise
            return False
        finally:
            fs.delete(own, False)

    def numbers(self) -> list[int]:
        fs, log = self._fs(), self._path(f"{self.root}/log")
        if not fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """A version: number, parent, time, note, tables (of each table its buckets' folders). Number 0 is nothing."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return {"number": 0, "parent": None, "tables": {}}
        fs = self._fs()
        stream = fs.open(self._path(f"{self.root}/log/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, tables: dict, note: str = "") -> int | None:
        """The number of the new version on top of base, or none if another writer was there first."""
        number = base["number"] + 1
        new = {"number": number, "parent": base["number"], "time": time.time(), "note": note, "tables": tables}
        return number if self._put(f"{self.root}/log/{number:012d}.json", json.dumps(new, sort_keys=True)) else None

    # --- tables

    def read(self, table: str, number: int | None = None, only: set[str] | None = None) -> DataFrame | None:
        """A table as of a version; none if the version does not have it."""
        own = self.version(number)["tables"].get(table)
        if own is None:
            return None
        schema = self._jvm.org.apache.spark.sql.types.DataType.fromJson(own["schema"]).toDDL()
        folders = [f"{self.root}/{own['folders'][b]}" for b in sorted(own["folders"]) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, table: str, rows: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, note: str = "") -> int:
        """A new version in which merge(old, rows) stands for the buckets that rows fall into; by default rows take the place of old ones of their key.

        If another writer commits first and left these buckets alone, the flush goes on top of its version; if not, it is made again from what that one wrote.
        """
        while True:
            base = self.version()
            own = base["tables"].get(table, {"folders": {}, "key": key, "buckets": self.buckets})
            of = F.pmod(F.xxhash64(F.col(key)), F.lit(own["buckets"])).cast("string")
            touched = {r[0] for r in rows.select(of.alias(_BUCKET)).distinct().collect()}
            if not touched:
                return base["number"]
            old = self.read(table, base["number"], touched) if table in base["tables"] else self.spark.createDataFrame([], rows.schema)
            new = (merge or replaced(key))(old, rows)
            folder = f"data/{uuid.uuid4().hex}"
            new.withColumn(_BUCKET, of).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
            written = {b: f"{folder}/{_BUCKET}={b}" for b in touched if self._fs().exists(self._path(f"{self.root}/{folder}/{_BUCKET}={b}"))}
            while True:
                folders = {b: f for b, f in base["tables"].get(table, {"folders": {}})["folders"].items() if b not in touched} | written
                tables = base["tables"] | {table: {"folders": folders, "key": key, "buckets": own["buckets"], "schema": new.schema.json()}}
                number = self.commit(base, tables, note)
                if number:
                    return number
                now = self.version()
                before, after = (v["tables"].get(table, {"folders": {}})["folders"] for v in (base, now))
                if any(before.get(b) != after.get(b) for b in touched):
                    break  # what was merged is no longer what stands there
                base = now

    def reset(self, mode: str) -> int:
        """A new version without the tables that a run starting anew puts aside; their files stay for restore()."""
        if mode not in RESETS:
            raise ValueError(f"no such mode: {mode}")
        return self._replaced(lambda tables: {k: v for k, v in tables.items() if k not in RESETS[mode]}, f"reset {mode}")

    def restore(self, number: int) -> int:
        """A new version that holds what version number held, in the same files."""
        old = self.version(number)["tables"]
        return self._replaced(lambda _: old, f"restore {number}")

    def _replaced(self, change: Callable[[dict], dict], note: str) -> int:
        base = self.version()
        number = self.commit(base, change(base["tables"]), note)
        if not number:
            raise Conflict(f"version {base['number'] + 1} is another writer's")
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes versions but the last ones, and folders that no version names any more. Not to be run beside a writer, whose folders none names yet."""
        fs, numbers = self._fs(), self.numbers()
        kept = numbers[-keep:] if keep > 0 else []
        named = {f.split("/")[1] for n in kept for t in self.version(n)["tables"].values() for f in t["folders"].values()}
        gone = [s.getPath() for s in fs.listStatus(self._path(f"{self.root}/data")) if s.getPath().getName() not in named] if fs.exists(self._path(f"{self.root}/data")) else []
        for n in numbers[: len(numbers) - len(kept)]:
            fs.delete(self._path(f"{self.root}/log/{n:012d}.json"), False)
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)


def replaced(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge in which new rows stand for the old ones of their key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        keys = new.select(F.col(key).alias("key_")).distinct()
        return old.join(keys, F.col(key).eqNullSafe(F.col("key_")), "left_anti").unionByName(new)

    return merge


def report_merge(key: str, status: str, kept: tuple[str, ...] = ("skipped", "locked")) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A report's merge, of whole rows: a new row that was skipped or locked leaves the old row's contents, if there is one; a row's place is the new one's.

    Rows hold part and ord, their place: flushed ones come first (0), old ones that no flush has met come after them (1).
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        values = [c for c in new.columns if c not in (key, "part", "ord")]
        a = old.select(F.col(key).alias("old_key"), F.struct(*values).alias("old_"), F.struct(F.col("part"), F.col("ord")).alias("old_at"))
        b = new.select(F.col(key).alias("new_key"), F.struct(*values).alias("new_"), F.struct(F.col("part"), F.col("ord")).alias("new_at"))
        both = a.join(b, F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
        stays = F.col("new_").isNull() | (F.col("old_").isNotNull() & F.coalesce(F.col(f"new_.{status}").isin(*kept), F.lit(False)))
        row, at = F.when(stays, F.col("old_")).otherwise(F.col("new_")), F.coalesce("new_at", "old_at")
        out = both.select(F.coalesce("new_key", "old_key").alias(key), row.alias("r"), at.alias("at"))
        return out.select(key, "r.*", "at.*").select(*new.columns)

    return merge
