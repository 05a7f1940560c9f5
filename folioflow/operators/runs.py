"""Order-dependent work over sorted partitions: running sums, ordinals, segments and order statistics, without a window or an array for each group.

Rows are range-partitioned by group and order, so that a group of any size lies in as many partitions as it fills, and are kept there. Two scans follow.
The first gives one row for each partition: what it would hand on to the next. The driver strings those rows, as many as partitions, together;
the second scan then starts each partition with what came before it. Neither holds more than one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.kept import BROADCAST_BYTES, BROADCAST_ROWS, cut, sized

#: Added columns: a row's place (its partition, then its place there) and its segment, named by the place of the segment's first row.
AT, SEGMENT = "at_", "segment_"
_OPENS, _CLOSES = "opens_", "closes_"


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows, sorted over partitions of like size, with their place. They are kept: bounds are drawn anew each time that a range shuffle runs."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id()))


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether a row's group is another one than that of the row before; nulls are a group. The first row's is not told."""
    out = np.zeros(n, dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


class _Scan:
    """The state of a scan: sums of the group at hand, its segment, and whether that is closed."""

    def __init__(self, group: list[str], sums: list[str], same: bool = False, before: list[int] | None = None, segment: int | None = None, closed: bool = False):
        self.group, self.names, self.same = group, sums, same
        self.sums, self.segment, self.closed = before or [0] * len(sums), segment, closed
        self.last: list[pa.Array] | None = None
        self.met = False

    def step(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        """Running sums and segments of a batch's rows."""
        n = batch.num_rows
        keys = [batch.column(c) for c in self.group]
        new = _changes(keys, n)
        if self.last is None:
            new[0] = not self.same
        else:
            new[0] = bool(_changes([pa.concat_arrays([a, k.slice(0, 1)]) for a, k in zip(self.last, keys, strict=True)], 2)[1])
        at = batch.column(AT).to_numpy()
        flag = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool)
        opens, closes = flag(_OPENS), flag(_CLOSES)
        breaks = new | opens | np.concatenate([[self.closed], closes[:-1]])
        begins = np.maximum.accumulate(np.where(breaks, np.arange(n), -1))
        segment = np.where(begins >= 0, at[begins], -1 if self.segment is None else self.segment)
        heads = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        out = []
        for k, name in enumerate(self.names):
            w = batch.column(name).to_numpy().astype(np.int64)
            total = np.cumsum(w)
            out.append(total - np.where(heads >= 0, total[heads] - w[heads], -self.sums[k]))
        inside = 0 if self.met else 1
        self.met, self.changed, self.broken = True, getattr(self, "changed", False) or bool(new[inside:].any()), getattr(self, "broken", False) or bool(breaks[inside:].any())
        self.sums, self.segment, self.closed = [int(x[-1]) for x in out], int(segment[-1]), bool(closes[-1])
        self.last = [k.slice(n - 1) for k in keys]
        return out, segment


def _summary(batches: Iterator[pa.RecordBatch], group: list[str], sums: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of a partition: its first and last group, sums of the last one in it, whether that is its only one, and its first and last segment."""
    scan, first = _Scan(group, sums), None
    for batch in batches:
        if batch.num_rows:
            first = first or ([batch.column(c).slice(0, 1) for c in group], batch.column(AT)[0].as_py(), batch.column(_OPENS)[0].as_py())
            scan.step(batch)
    if first is None:
        return
    one = lambda v, kind: pa.array([v], kind)
    own = [one(TaskContext.get().partitionId(), pa.int32()), *first[0], *scan.last, one(scan.sums, pa.list_(pa.int64())), one(not scan.changed, pa.bool_()), one(first[1], pa.int64()), one(bool(first[2]), pa.bool_()), one(scan.segment if scan.broken else None, pa.int64()), one(scan.closed, pa.bool_())]
    yield pa.RecordBatch.from_arrays(own, names)


def _strung(rows: list, group: list[str], sums: int) -> dict[int, dict]:
    """What each partition begins with, from what each would hand on."""
    out: dict[int, dict] = {}
    before: tuple = ()
    total, segment, closed = [0] * sums, None, False
    for r in sorted(rows, key=lambda r: r.part):
        first, last = tuple(r[f"first_{k}"] for k in range(len(group))), tuple(r[f"last_{k}"] for k in range(len(group)))
        same = bool(out) and first == before
        out[r.part] = {"same": same, "before": list(total) if same else [0] * sums, "segment": segment, "closed": closed}
        if not r.only or not same:
            total = list(r.sums)
        else:
            total = [a + b for a, b in zip(total, r.sums, strict=True)]
        if r.segment is not None:
            segment = r.segment
        elif not same or r.opens or closed:
            segment = r.at
        before, closed = last, r.closed
    return out


def _marked(batches: Iterator[pa.RecordBatch], group: list[str], sums: list[str], starts: dict[int, dict]) -> Iterator[pa.RecordBatch]:
    scan = None
    for batch in batches:
        if batch.num_rows:
            scan = scan or _Scan(group, sums, **starts[TaskContext.get().partitionId()])
            run, segment = scan.step(batch)
            kept = [c for c in batch.schema.names if c not in (*sums, _OPENS, _CLOSES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, run), pa.array(segment)], [*kept, *sums, SEGMENT])


def scanned(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, opens: Column | None = None, closes: Column | None = None) -> DataFrame:
    """rows in order, with AT, the running sums of their group (whole numbers, each row's own included) and SEGMENT.

    A segment begins with its group, at a row for which opens holds and after one for which closes does. Rows with equal group and order keep no order of their own.
    """
    sums = sums or {}
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    marked = rows.withColumns({**{n: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in sums.items()}, _OPENS: flag(opens), _CLOSES: flag(closes)})
    own = dealt(marked, *group, *order)
    names, kinds = list(sums), [own.schema[c].dataType for c in group]
    fields = [("part", T.IntegerType()), *((f"{s}_{k}", kind) for s in ("first", "last") for k, kind in enumerate(kinds)), ("sums", T.ArrayType(T.LongType())), ("only", T.BooleanType()), ("at", T.LongType()), ("opens", T.BooleanType()), ("segment", T.LongType()), ("closed", T.BooleanType())]
    few = own.select(*group, *names, AT, _OPENS, _CLOSES)
    handed = few.mapInArrow(partial(_summary, group=group, sums=names, names=[n for n, _ in fields]), T.StructType([T.StructField(n, k) for n, k in fields])).collect()
    out = T.StructType([*(f for f in own.schema.fields if f.name not in (*names, _OPENS, _CLOSES)), *(T.StructField(n, T.LongType()) for n in names), T.StructField(SEGMENT, T.LongType())])
    return own.mapInArrow(partial(_marked, group=group, sums=names, starts=_strung(handed, group, len(names))), out)


def ordinals(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number in their group, from 1 on."""
    return scanned(rows, group, order, {name: F.lit(1)}).drop(AT, SEGMENT)


def with_totals(rows: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """rows (already cut, or cheap) with aggregates of their group, which are summed before they are dealt out; nulls are a group."""
    names = [f"{c}_of" for c in group]
    side = rows.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()]).withColumnsRenamed(dict(zip(group, names, strict=True)))
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(group, names, strict=True)]
    return rows.join(sized(cut(side)), on).drop(*names)


#: Intervals that a group's values are counted in at a time.
BINS = 1024


def selected(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Rows group and, for each rank, the value that is so many places above the least (ranks are of n, the group's count of values; nulls are no values).

    Values are counted in intervals, and the interval that holds a rank is looked into again until its least value is its largest. Each round
    leaves one interval's rows of each group and rank; counts are summed before they are dealt out, so that no group is gathered.
    """
    v = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v is not null and not isnan(cast(v as double))")
    whole = v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    open_ = cut(whole.select("g", "lo", "hi", F.inline(asked)).select("g", "name", "rank", "lo", "hi"))
    done = open_.filter("lo = hi").select("g", "name", F.col("lo").alias("v"))
    open_ = open_.filter("lo < hi")
    half = lambda a, b: F.col(a).cast("double") / 2 - F.col(b).cast("double") / 2
    # The intervals rise with the value however doubles round, and an interval's ends fall into different ones.
    place = F.when(half("to", "from") > 0, F.floor(half("v", "from") / half("to", "from") * (BINS - 2))).otherwise(0)
    bin_ = F.when(F.col("v") == F.col("to"), BINS - 1).otherwise(F.least(F.lit(BINS - 2), place)).cast("int")
    measure = lambda: open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("g").cast("string")), F.lit(0)) + 40), F.lit(0))).first()
    while (size := measure())[0]:
        side = open_.select(F.col("g").alias("of"), F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        met = v.join(F.broadcast(side) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES else side, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("from"), F.col("to")))
        parts = met.groupBy("of", "from", "to", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        cells = parts.groupBy("of", "from", "to").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("cells"))  # BINS of them at most
        one = cells.join(open_, F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to")))
        kind = cells.schema["cells"].dataType.elementType.simpleString()
        start = F.struct(F.col("rank").alias("left"), F.lit(None).cast(kind).alias("own"))
        step = lambda a, c: F.when(a["own"].isNotNull(), a).when(a["left"] < c["n"], F.struct(a["left"].alias("left"), c.alias("own"))).otherwise(F.struct((a["left"] - c["n"]).alias("left"), a["own"].alias("own")))
        now = cut(one.select("g", "name", F.aggregate("cells", start, step).alias("f")).select("g", "name", F.col("f.left").alias("rank"), "f.own.lo", "f.own.hi"))
        done = done.unionByName(now.filter("lo = hi").select("g", "name", F.col("lo").alias("v")))
        open_ = now.filter("lo < hi")
    return done.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


#: Fixed value: the CRC-32 polynomial, lowest power in the highest bit.
_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC's, both of 32 bits with the lowest power in the highest bit."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(32):
        out ^= np.where(a >> np.uint64(31 - k) & np.uint64(1) > 0, b, np.uint64(0))
        b = np.where(b & np.uint64(1) > 0, b >> np.uint64(1) ^ np.uint64(_POLYNOMIAL), b >> np.uint64(1))
    return out


def crc_moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What CRCs of parts count for in the CRC of a text in which n bytes follow them: crc times x to the power of 8 n."""
    out, power, n = crc.astype(np.uint64), np.full(1, 0x80000000 >> 8, dtype=np.uint64), n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1) > 0, _times(out, np.broadcast_to(power, out.shape)), out)
        power, n = _times(power, power), n >> np.uint64(1)
    return out


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_moved(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(crc.astype(np.int64))], ["g", "crc"])


def checksums(rows: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """Rows group, crc, n: the CRC-32 of a group's texts (null: empty), joined by line ends in order, and their count.

    The CRC of a joined text is the exclusive or of its parts' CRCs, each multiplied by a power of x for the bytes that follow it. So a text is
    read once, only its CRC and length are dealt out, bytes are summed over sorted partitions, and groups are added up bit by bit: none is joined or gathered.
    """
    parts = rows.select(F.col(group).alias("g"), *order, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    # A part is a text and the line end before it; a group's first one has none.
    parts = parts.select("g", *order, F.crc32("t").alias("bare"), F.crc32(F.concat(F.lit("\n").cast("binary"), "t")).alias("crc"), F.octet_length("t").cast("long").alias("size"))
    run = cut(scanned(parts, ["g"], order, {"n": F.lit(1), "upto": F.col("size") + 1}).drop(AT, SEGMENT))
    ends = with_totals(run, ["g"], all=F.max("upto"))
    own = ends.select("g", F.when(F.col("n") == 1, F.col("bare")).otherwise(F.col("crc")).alias("crc"), (F.col("all") - F.col("upto")).alias("after"))
    kind = rows.schema[group].dataType.simpleString()
    return own.mapInArrow(_moved, f"g {kind}, crc long").groupBy(F.col("g").alias(group)).agg(F.bit_xor("crc").alias("crc"), F.count(F.lit(1)).alias("n"))
