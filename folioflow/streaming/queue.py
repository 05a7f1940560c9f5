"""The edit queue and retried requests as state of a stream: each book's queue, fence and listing, and each request's attempts, live in the state store.

Nothing is rewritten but what a micro-batch touches, and a restarted query goes on from its checkpoint. The state store has to be RocksDB (use_state_store).
A listing's time is the machine's clock, so that the queue runs a batch at each trigger even without rows: give it a processing time, or once=True, not
availableNow, which would never end. A key's rows of one micro-batch are held together while they are put in order; bound a micro-batch with maxFilesPerTrigger or maxBytesPerTrigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the queue is told: an edit, an acknowledgement (what of fp was applied, up to a place) or a wish to see the queue.
EVENTS = "book long, seq long, kind string, fp long, idx long, text string, upto long"
CHANGES = "book long, idx long, text string, fp long, seq long, change string"
_CHANGE = Row("book", "idx", "text", "fp", "seq", "change")
#: A listing is told again from its copy for so long, unless the queue changes.
LIST_MS = 45_000
#: Attempts at a request, and the wait before the next one: so many milliseconds times the attempts made.
ATTEMPTS, WAIT_MS = 3, 1300


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class EditQueue(StatefulProcessor):
    """A book's queue. An edit of another fp than the stored one (which is not null) drops what waits; the latest edit of a paragraph holds.

    An acknowledgement clears edits up to its place if its fp is the stored one, or none is stored. A listing is kept for list_ms and dropped by every change.
    """

    def __init__(self, list_ms: int = LIST_MS):
        self.list_ms = list_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fence = handle.getValueState("fence", "fp long")
        self.waiting = handle.getMapState("waiting", "idx long", "text string, fp long, seq long")
        self.listing = handle.getValueState("listing", "n long, upto long", ttlDurationMs=self.list_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """The queue is read once and what differs at the end is written: entries put and removed in turn would leave marks in the store that each later look passes over."""
        (book,) = key
        fence = self.fence.get()[0] if self.fence.exists() else None
        before = {tuple(k)[0]: tuple(v) for k, v in self.waiting.iterator()}
        waiting, fenced, changed = dict(before), False, False

        def gone(least: int | None = None) -> Iterator[Row]:
            """Entries that leave the queue: all, or those up to a place."""
            for idx, (text, fp, seq) in sorted(waiting.items()):
                if least is None or seq <= least:
                    del waiting[idx]
                    yield _CHANGE(book, idx, text, fp, seq, "gone")

        for seq, kind, fp, idx, text, upto in sorted(((r.seq, r.kind, r.fp, r.idx, r.text, r.upto) for r in rows), key=lambda r: r[:2]):
            if kind == "list":
                if changed or not self.listing.exists():
                    self.listing.update((len(waiting), max((v[2] for v in waiting.values()), default=-1)))
                    changed = False
                n, last = self.listing.get()
                yield _CHANGE(book, n, None, fence, last, "listed")
                continue
            if kind == "edit":
                if fence is not None and fp != fence:
                    yield from gone()
                fence, fenced = fp, True
                waiting[idx] = (text, fp, seq)
                yield _CHANGE(book, idx, text, fp, seq, "set")
            elif kind == "ack":
                if fence is None or fence == fp:
                    yield from gone(upto)
            changed = True
        for idx in before.keys() - waiting.keys():
            self.waiting.removeKey((idx,))
        for idx, entry in waiting.items():
            if before.get(idx) != entry:
                self.waiting.updateValue((idx,), entry)
        if fenced:
            self.fence.update((fence,))
        if changed:
            self.listing.clear()

    def close(self) -> None:
        pass


class Attempts(StatefulProcessor):
    """A request's attempts: an answer that may be better next time (none, 404, 429, 5xx) is followed by another attempt when its time has come, up to ATTEMPTS.

    Times are the answers' own, so that a replay decides alike; an attempt falls due when the watermark passes its time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "n int, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        (request,) = key
        for r in sorted(rows, key=lambda r: r.at):
            n, ended = self.made.get() if self.made.exists() else (0, False)
            if ended:
                continue
            n += 1
            again = may_be_better(r.status) and n < ATTEMPTS
            self.made.update((n, not again))
            at = int(r.at.timestamp() * 1000)
            if again:
                self.handle.registerTimer(at + WAIT_MS * n)
            else:
                yield Row(request=request, attempt=n, at_ms=at, state="failed" if may_be_better(r.status) or r.status >= 400 else "done")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        (request,) = key
        n, ended = self.made.get()
        if not ended:
            yield Row(request=request, attempt=n + 1, at_ms=expiredTimerInfo.getExpiryTimeInMs(), state="due")

    def close(self) -> None:
        pass


def may_be_better(status: int | None) -> bool:
    return status is None or status in (404, 429) or status >= 500


def read_events(spark: SparkSession, folder: str, **options) -> DataFrame:
    return spark.readStream.schema(EVENTS).options(**options).json(folder)


def changes(events: DataFrame, list_ms: int = LIST_MS) -> DataFrame:
    """The queue's changes: rows set, gone and listed (idx: how many wait, seq: the last place)."""
    return events.groupBy("book").transformWithState(EditQueue(list_ms), CHANGES, "Update", "ProcessingTime")


def waiting(told: DataFrame) -> DataFrame:
    """What waits after the changes that a query told (append-only): of each paragraph the last change, if it was set."""
    order = F.struct("seq", (F.col("change") == "gone").cast("int").alias("late"))
    last = told.filter("change <> 'listed'").groupBy("book", "idx").agg(F.max_by(F.struct("text", "fp", "seq", "change"), order).alias("e"))
    return last.filter("e.change = 'set'").select("book", "idx", "e.text", "e.fp", "e.seq")


def attempts(answers: DataFrame, late: str = "0 seconds") -> DataFrame:
    """answers (request, at, status) as a stream: rows request, attempt, at_ms, state (due, done, failed)."""
    rows = answers.withWatermark("at", late)
    return rows.groupBy("request").transformWithState(Attempts(), "request long, attempt int, at_ms long, state string", "Update", "EventTime")


def planned(answers: DataFrame) -> DataFrame:
    """The batch twin: rows request, attempt, at_ms, state of answers (request, n: its place, at_ms, status), of which those past the end are passed over."""
    better = F.col("status").isNull() | F.col("status").isin(404, 429) | (F.col("status") >= 500)
    ends = answers.groupBy("request").agg(F.coalesce(F.min(F.when(~better, F.col("n"))), F.lit(ATTEMPTS)).alias("end"))
    rows = answers.join(ends.withColumn("end", F.least("end", F.lit(ATTEMPTS))), "request").filter(F.col("n") <= F.col("end"))
    last = (F.col("n") == F.col("end")) & (~better | (F.col("n") == ATTEMPTS))
    state = F.when(~last, "due").when(better | (F.col("status") >= 400), "failed").otherwise("done")
    return rows.select("request", F.when(last, F.col("n")).otherwise(F.col("n") + 1).cast("int").alias("attempt"), F.when(last, F.col("at_ms")).otherwise(F.col("at_ms") + WAIT_MS * F.col("n")).alias("at_ms"), state.alias("state"))
