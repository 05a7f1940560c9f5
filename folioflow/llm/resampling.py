"""Resampling irregular series into calendar days: points are range-partitioned by series and second, and each sorted partition is scanned once.

A scan needs one point beyond its own: the first of the next partition that has any. Those points, one for each partition whatever the
input's size, are the only thing that reaches the driver and the tasks besides the rows. A partition gives partial buckets, which are summed
afterwards by series and bucket. Of a series' points in one second one stays, chosen by partial aggregation before anything is dealt out, so that neither a busy
second nor a busy series meets in one task: a series' seconds are split over as many partitions as they need.

The signal is "step" (a value lasts until the next point, `longest` seconds at most; the last one lasts all of them) or "linear" (it runs straight to
the next point's value if that is at most `longest` seconds away, else there is none). Integrals are of whole seconds and cents, doubled, in integers: of a segment
from v to w of d seconds the first u seconds count 2*v*u + floor((w-v)*u*u/d), and a bucket takes the difference between its ends.

Defined results: rows whose key, time or value is null, or whose value is not finite, are dropped. Of rows in one second the largest order column decides (null: the
smallest), then the larger value. Repeated rows are one point. Values may be as large as a bucket's doubled integral fits a long; beyond it the query fails
instead of wrapping. An empty table gives no rows. Extra columns, texts of any length among them, are never read; the key may have any type that sorts.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import partial
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: A value lasts, or a line spans, so many seconds at most.
LONGEST = 900
ZONE = "Europe/Berlin"
#: Above these, products are taken in Python's integers, which have no end.
_NARROW, _FAR = 1 << 40, 1 << 20


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time in UTC, with a zone or without one, whatever the session's zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)


def points(rows: DataFrame, key: str, ts: str, value: str, order: str) -> DataFrame:
    """Rows k, sec, cents: one point for each series and second."""
    least = F.lit(-(1 << 63)).cast("long")
    cents = F.floor(F.lit(100) * F.col(value) + F.lit(0.5))
    known = F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf"))
    own = rows.filter(known).select(F.col(key).alias("k"), micros(rows, ts).alias("m"), cents.alias("cents"), F.coalesce(F.col(order), least).alias("o"))
    return own.withColumn("sec", F.expr("(m - pmod(m, 1000000)) div 1000000")).groupBy("k", "sec").agg(F.max(F.struct("o", "cents"))["cents"].alias("cents"))


def midnights(zone: str, low: int, high: int) -> np.ndarray:
    """True seconds of the zone's midnights from the one at or before low to one beyond high."""
    tz = ZoneInfo(zone)
    day = datetime.fromtimestamp(low, UTC).date() - timedelta(days=1)
    last = datetime.fromtimestamp(high, UTC).date() + timedelta(days=2)
    at = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=tz).timestamp())
    edges = [at(date.fromordinal(n)) for n in range(day.toordinal(), last.toordinal() + 1)]
    return np.array(edges, dtype=np.int64)


def first_part(v: np.ndarray, w: np.ndarray, d: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Twice the integral of a segment's first u seconds, exactly: the slope is parted into a whole number and a rest, whose product stays small."""
    whole = (w - v) // d
    rest = (w - v) - whole * d
    return 2 * v * u + whole * u * u + rest * u * u // d


def pieces(sec: np.ndarray, cents: np.ndarray, follows: np.ndarray, next_sec: np.ndarray, next_cents: np.ndarray, signal: str, longest: int, zone: str) -> tuple[np.ndarray, ...]:
    """Of each point, parted at midnights: its number, the bucket's start, 1 where the point itself lies, covered seconds and the doubled integral."""
    gap = np.where(follows, next_sec - sec, longest)
    if signal == "step":
        d, w, lives = np.minimum(gap, longest), cents, np.ones(len(sec), dtype=bool)
    else:
        lives = follows & (gap <= longest)
        d, w = np.where(lives, gap, 1), np.where(lives, next_cents, cents)
    edges = midnights(zone, int(sec.min()), int(sec.max()) + longest)
    first = np.searchsorted(edges, sec, "right") - 1
    last = np.where(lives, np.searchsorted(edges, sec + d, "left") - 1, first)
    many = last - first + 1
    i = np.repeat(np.arange(len(sec)), many)
    step = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    bucket = first[i] + step
    live = lives[i]
    u0 = np.where(live, np.maximum(edges[bucket] - sec[i], 0), 0)
    u1 = np.where(live, np.minimum(edges[bucket + 1] - sec[i], d[i]), 0)
    v, w, d = cents[i], w[i], d[i]
    if len(v) and (max(abs(int(v.max())), abs(int(v.min())), abs(int(w.max())), abs(int(w.min()))) >= _NARROW or longest >= _FAR):
        v, w, d, u0, u1 = (x.astype(object) for x in (v, w, d, u0, u1))
    area = first_part(v, w, d, u1) - first_part(v, w, d, u0)
    return i, edges[bucket], (step == 0).astype(np.int64), (u1 - u0).astype(np.int64), area.astype(np.int64)


def partial_buckets(table: pa.Table, with_next: int, signal: str, longest: int, zone: str) -> pa.RecordBatch:
    """Partial buckets of the first with_next points of a sorted table; the row after a point is its next if the key is the same."""
    k, sec, cents = table.column("k").combine_chunks(), table.column("sec").to_numpy(), table.column("cents").to_numpy()
    n = len(sec)
    follows, next_sec, next_cents = np.zeros(n, dtype=bool), sec.copy(), cents.copy()
    if n > 1:
        follows[:-1] = pc.equal(k.slice(0, n - 1), k.slice(1)).to_numpy(zero_copy_only=False)
        next_sec[:-1], next_cents[:-1] = sec[1:], cents[1:]
    own = slice(0, with_next)
    i, start, has, covered, area = pieces(sec[own], cents[own], follows[own], next_sec[own], next_cents[own], signal, longest, zone)
    series = np.cumsum(np.concatenate([[0], ~follows[:-1]]))[own]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(series[i]) != 0) | (np.diff(start) != 0)]))
    sums = [np.add.reduceat(x, new) for x in (has, covered, area)]
    return pa.RecordBatch.from_arrays([k.take(pa.array(i[new])), *map(pa.array, (start[new], *sums))], ["k", "bucket_start", "n_points", "covered_seconds", "area2"])


def scan(batches: Iterator[pa.RecordBatch], nexts: dict, signal: str, longest: int, zone: str) -> Iterator[pa.RecordBatch]:
    """Partial buckets of a sorted partition; the last point of a batch waits for the one that follows."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        n = table.num_rows
        if n > 1:
            yield partial_buckets(table, n - 1, signal, longest, zone)
        waiting = table.slice(n - 1)
    if waiting is not None:
        beyond = nexts.get(TaskContext.get().partitionId())
        if beyond is not None:
            waiting = pa.concat_tables([waiting, pa.Table.from_pylist([beyond], schema=waiting.schema)])
        yield partial_buckets(waiting, 1, signal, longest, zone)


def buckets(rows: DataFrame, key: str = "client_id", ts: str = "ts", value: str = "value", order: str = "click_id", signal: str = "linear", longest: int = LONGEST, zone: str = ZONE) -> DataFrame:
    """Rows key, bucket_start, n_points, covered_seconds, area2, avg_cents: for each series its calendar days that hold a point or covered time."""
    if signal not in ("linear", "step") or longest < 1:
        raise ValueError(f"unknown signal or span: {signal}, {longest}")
    own = points(rows, key, ts, value, order)
    # The partitions are kept: their bounds are drawn anew whenever the shuffle runs, and a scan has to know the one after it.
    dealt = cut(own.repartitionByRange("k", "sec").sortWithinPartitions("k", "sec"))
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("k", "sec", "cents")).alias("p")).collect()
    firsts = {r.part: r.p.asDict() for r in firsts}
    nexts, later = {}, sorted(firsts)
    for part, after in zip(later, later[1:], strict=False):
        nexts[part] = firsts[after]
    kind = dealt.schema["k"].dataType.simpleString()
    parts = dealt.mapInArrow(partial(scan, nexts=nexts, signal=signal, longest=longest, zone=zone), f"k {kind}, bucket_start long, n_points long, covered_seconds long, area2 long")
    out = parts.groupBy("k", "bucket_start").agg(*[F.sum(c).alias(c) for c in ("n_points", "covered_seconds", "area2")])
    average = F.expr("CASE WHEN covered_seconds > 0 THEN (area2 - pmod(area2, 2 * covered_seconds)) div (2 * covered_seconds) END")
    return out.withColumn("avg_cents", average).withColumnRenamed("k", key)
