"""The queue and retries as streams with state: against replays and batch twins, over restarts, with listings that expire."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest

from folioflow.operators import review
from folioflow.streaming import queue


@pytest.fixture(scope="module")
def stream(spark):
    queue.use_state_store(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(df, out, checkpoint, **trigger):
    """The queue's clock is the machine's, by which it runs batches without rows for ever; a run of it is one batch."""
    trigger = trigger or {"once": True}
    df.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").json(f"{out}/batch={n}")).option("checkpointLocation", str(checkpoint)).trigger(**trigger).start().awaitTermination(60)


def event(book, seq, kind="edit", fp=None, idx=None, text=None, upto=None):
    return {"book": book, "seq": seq, "kind": kind, "fp": fp, "idx": idx, "text": text, "upto": upto}


def test_queue_equals_its_batch_twin_over_restarts(stream, tmp_path):
    r = random.Random(8)
    edits = [(b, k, r.choice([None, 1, 1, 1, 2]), r.randrange(4), f"t{k}") for k in range(120) for b in (r.randrange(4),)]
    for part in range(3):
        put(tmp_path / "in", str(part), [event(b, k, fp=fp, idx=i, text=t) for b, k, fp, i, t in edits[part * 40 : part * 40 + 40]])
        run(queue.changes(queue.read_events(stream, str(tmp_path / "in"))), tmp_path / "out", tmp_path / "cp")  # each a restart
        told = stream.read.schema(queue.CHANGES).json(str(tmp_path / "out"))
        want = review.fenced_latest(stream.createDataFrame(edits[: part * 40 + 40], "book long, seq long, fp long, idx long, text string"))
        key = lambda df: sorted((x.book, x.idx, x.text, x.fp or -1, x.seq) for x in df.collect())
        assert key(queue.waiting(told)) == key(want)


def test_acknowledged_edits_go_and_later_ones_wait(stream, tmp_path):
    put(tmp_path / "in", "0", [event(1, 0, fp=7, idx=0, text="a"), event(1, 1, fp=7, idx=1, text="b"), event(2, 2, fp=8, idx=0, text="c")])
    source = lambda: queue.changes(queue.read_events(stream, str(tmp_path / "in")))
    run(source(), tmp_path / "out", tmp_path / "cp")
    put(tmp_path / "in", "1", [event(1, 3, fp=7, idx=1, text="later"), event(1, 4, "ack", fp=7, upto=2), event(2, 5, "ack", fp=9, upto=5)])
    run(source(), tmp_path / "out", tmp_path / "cp")
    told = stream.read.schema(queue.CHANGES).json(str(tmp_path / "out"))
    assert sorted((x.book, x.idx, x.text) for x in queue.waiting(told).collect()) == [(1, 1, "later"), (2, 0, "c")]


def test_a_listing_is_a_copy_until_it_expires_or_the_queue_changes(stream, tmp_path):
    listed = lambda: [(x.idx, x.seq) for x in sorted(stream.read.schema(queue.CHANGES).json(str(tmp_path / "out")).filter("change = 'listed'").collect(), key=lambda x: x.seq)]
    source = lambda: queue.changes(queue.read_events(stream, str(tmp_path / "in")), list_ms=1500)
    put(tmp_path / "in", "0", [event(1, 0, fp=7, idx=0, text="a"), event(1, 1, "list"), event(1, 2, fp=7, idx=1, text="b"), event(1, 3, "list")])
    run(source(), tmp_path / "out", tmp_path / "cp")
    assert listed() == [(1, 0), (2, 2)]  # a write drops the copy
    time.sleep(2)
    put(tmp_path / "in", "1", [event(1, 4, "list")])
    run(source(), tmp_path / "out", tmp_path / "cp")
    assert listed() == [(1, 0), (2, 2), (2, 2)]  # made anew after its time


def test_retries_by_the_answers_own_times(stream, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    told = {1: [503, 429, 200], 2: [404, None, 500, 200], 3: [200], 4: [403], 5: [500, 200, 500]}
    rows = sorted((k + 10 * n, q, s) for q, all_ in told.items() for n, s in enumerate(all_) for k in (q,))
    source = lambda: queue.attempts(stream.readStream.schema("request long, at timestamp, status int").json(str(tmp_path / "in")))
    for part, some in enumerate((rows[:5], rows[5:], [(10_000, 99, 200)], [(20_000, 99, 200)])):  # the last ones move the clock on
        put(tmp_path / "in", str(part), [{"request": q, "at": (at + timedelta(seconds=sec)).isoformat(), "status": s} for sec, q, s in some])
        run(source(), tmp_path / "out", tmp_path / "cp", availableNow=True)
    got = {(x.request, x.attempt, x.at_ms, x.state) for x in stream.read.schema("request long, attempt int, at_ms long, state string").json(str(tmp_path / "out")).filter("request <> 99").collect()}
    ms = lambda q, n: int(at.timestamp() * 1000) + 1000 * (q + 10 * n)
    batch = stream.createDataFrame([(q, n + 1, ms(q, n), s) for q, all_ in told.items() for n, s in enumerate(all_)], "request long, n int, at_ms long, status int")
    want = {(x.request, x.attempt, x.at_ms, x.state) for x in queue.planned(batch).collect()}
    ends = lambda rows: {x for x in rows if x[3] != "due"}
    assert ends(got) == ends(want) == {(1, 3, ms(1, 2), "done"), (2, 3, ms(2, 2), "failed"), (3, 1, ms(3, 0), "done"), (4, 1, ms(4, 0), "failed"), (5, 2, ms(5, 1), "done")}
    assert {x for x in want if x[3] == "due"} == {(1, 2, ms(1, 0) + 1300, "due"), (1, 3, ms(1, 1) + 2600, "due"), (2, 2, ms(2, 0) + 1300, "due"), (2, 3, ms(2, 1) + 2600, "due"), (5, 2, ms(5, 0) + 1300, "due")}
    assert {x for x in got if x[3] == "due"} <= {x for x in want if x[3] == "due"}


def test_a_batch_touches_the_state_by_what_is_left_of_it():
    """Generations that come and go within a micro-batch are told but neither put into the store nor removed from it."""
    from pyspark.sql import Row

    calls = []

    class Held:
        def __init__(self, name):
            self.name, self.value, self.map = name, None, {}

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            calls.append(self.name)
            self.value = v

        def clear(self):
            calls.append(self.name)
            self.value = None

        def iterator(self):
            return iter(list(self.map.items()))

        def updateValue(self, k, v):
            calls.append(self.name)
            self.map[k] = v

        def removeKey(self, k):
            calls.append(self.name)
            del self.map[k]

    q = queue.EditQueue()
    q.fence, q.waiting, q.listing = Held("fence"), Held("waiting"), Held("listing")
    rows = [Row(**event(1, k, fp=k // 10, idx=k % 5, text=f"t{k}")) for k in range(1000)]
    told = list(q.handleInputRows((1,), iter(rows[::-1]), None))
    assert [x.change for x in told].count("set") == 1000 and [x.change for x in told].count("gone") == 99 * 5
    assert q.waiting.map == {(k % 5,): (f"t{k}", 99, k) for k in range(995, 1000)} and q.fence.value == (99,) and len(calls) <= 10
    told = list(q.handleInputRows((1,), iter([Row(**event(1, 1000, "ack", fp=99, upto=996)), Row(**event(1, 1001, "list"))]), None))
    assert [(x.change, x.idx, x.seq) for x in told] == [("gone", 0, 995), ("gone", 1, 996), ("listed", 3, 999)] and sorted(q.waiting.map) == [(2,), (3,), (4,)]
