"""Order-dependent work over sorted partitions against plain loops, with one group that holds nearly all rows and partitions of a few rows."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_catalogue import heading, joined

from folioflow.functions import text as T
from folioflow.operators import ordered, review, runs


@pytest.fixture
def many(spark):
    """Many partitions and small Arrow batches."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n=600):
    r = random.Random(seed)
    return [("hot" if k % 7 else r.choice(["a", None, "zz"]), k, r.randrange(-5, 50), r.random() < 0.05, r.random() < 0.05) for k in range(n)]


def test_sums_and_segments_over_partitions(many):
    for seed in range(2):
        data = rows_of(seed) if seed else [("hot", k, 1, False, False) for k in range(300)]  # one group, one segment over all partitions
        df = many.createDataFrame(data, "g string, o long, w long, op boolean, cl boolean").repartition(9)
        got = runs.scanned(df, ["g"], ["o"], {"run": F.col("w"), "n": F.lit(1)}, F.col("op"), F.col("cl"))
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < len(data) / 5
        want, total, count, segment, before = {}, {}, {}, {}, {}
        for g, o, w, op, cl in sorted(data, key=lambda x: (x[0] or "", x[1])):
            total[g], count[g] = total.get(g, 0) + w, count.get(g, 0) + 1
            if g not in before or op or before[g]:
                segment[g] = o
            before[g] = cl
            want[o] = (total[g], count[g], segment[g])
        out = got.collect()
        first = {r[runs.SEGMENT]: r.o for r in sorted(out, key=lambda r: -r.o)}
        assert {r.o: (r.run, r.n, first[r[runs.SEGMENT]]) for r in out} == want


def test_ordinals_of_nothing_and_of_equal_keys(many):
    df = many.createDataFrame([], "g string, o long")
    assert runs.ordinals(df, ["g"], ["o"]).collect() == []
    same = many.createDataFrame([("g", 1)] * 50 + [(None, None)] * 3, "g string, o long")
    assert sorted((r.g or "", r.n) for r in runs.ordinals(same, ["g"], ["o"]).collect()) == [("", k) for k in (1, 2, 3)] + [("g", k) for k in range(1, 51)]


def test_paragraphs_of_one_book_over_many_partitions(many):
    r = random.Random(2)
    words = ["Kapitel", "5", "teil ", "lower case words", "KAPITEL II", "ends here.", "an-", "## mark", "文字", "Prolog", "第", "五章", "a longer piece of text that goes on and on and on and on and on"]
    data = [("book" if k % 5 else "other", k // 4, k % 4, r.choice(words)) for k in range(500)]
    df = many.createDataFrame(data, "book string, page long, j int, piece string").repartition(6)
    got = defaultdict(list)
    for x in sorted(ordered.merged_pieces(df, "book", ["page", "j"], "piece", "page").collect(), key=lambda x: (x.book, x.idx)):
        got[x.book].append((x.idx, x.text, x.first, x.last))
    for book in ("book", "other"):
        out = []
        for _, page, _, piece in sorted(d for d in data if d[0] == book):
            if out and not heading(out[-1][0]) and not heading(piece) and out[-1][0].rstrip()[-1] not in T.SENTENCE_END:
                out[-1] = [joined(out[-1][0], piece), out[-1][1], page]
            else:
                out.append([piece, page, page])
        assert got[book] == [(k, *p) for k, p in enumerate(out)]
    assert any(t == "第五章" for _, t, _, _ in got["book"])  # a heading only when joined


@pytest.mark.parametrize("kind,make", [("long", lambda r: r.randrange(-(1 << 62), 1 << 62)), ("long", lambda r: r.randrange(5)), ("double", lambda r: r.choice([0.0, 1e300, -1e300, 1e-300, r.random()])), ("decimal(12,2)", lambda r: r.randrange(10**6) / 100)])
def test_order_statistics(spark, kind, make):
    from decimal import Decimal

    r = random.Random(kind)
    cast = (lambda v: Decimal(f"{v:.2f}")) if kind.startswith("dec") else (lambda v: v)
    data = [("hot" if k % 3 else r.choice("ab"), cast(make(r))) for k in range(2000)] + [("one", cast(make(r))), ("none", None), (None, cast(make(r)))]
    df = spark.createDataFrame(data, f"g string, v {kind}")
    n = F.col("n")
    out = runs.selected(df, "g", "v", {"upper": F.floor(n / 2), "low": F.floor(n / 10), "least": F.lit(0), "most": n - 1}).collect()
    groups = defaultdict(list)
    for g, v in data:
        if v is not None:
            groups[g].append(v)
    assert {x.g for x in out} == set(groups)
    for x in out:
        s = sorted(groups[x.g])
        assert (x.upper, x.low, x.least, x.most) == (s[len(s) // 2], s[len(s) // 10], s[0], s[-1])


def test_chapters_of_one_book(many):
    data = [("b", k, k % 37 == 20 or k == 3) for k in range(200)] + [("late", k, k == 9) for k in range(10)] + [("none", k, False) for k in range(4)] + [(None, 0, True)]
    got = defaultdict(list)
    for x in ordered.chapter_ranges(many.createDataFrame(data, "g string, o long, head boolean"), "g", "o", "head").collect():
        got[x.group].append((x.start, x.end))
    at = [3] + [k for k in range(200) if k % 37 == 20]
    assert sorted(got["b"]) == list(zip(at, [*at[1:], 200]))
    assert sorted(got["late"]) == [(0, 9), (9, 10)] and got["none"] == [(0, 4)] and got[None] == [(0, 1)]


def test_fences_against_a_replay(spark):
    r = random.Random(4)
    data = [(b, k, r.choice([None, None, 1, 1, 1, 2]), r.randrange(4), f"t{k}") for b in range(60) for k in range(r.randrange(1, 9))]
    queues = {}
    for b, k, fp, idx, text in data:
        stored, edits = queues.get(b, (None, {}))
        if stored is not None and fp != stored:
            edits = {}
        edits[idx] = (text, fp, k)
        queues[b] = (fp, edits)
    got = {(x.book, x.idx): (x.text, x.fp, x.seq) for x in review.fenced_latest(spark.createDataFrame(data, "book long, seq long, fp long, idx long, text string")).collect()}
    assert got == {(b, i): e for b, (_, edits) in queues.items() for i, e in edits.items()}


def test_checksum_of_an_ordered_book(many):
    r = random.Random(9)
    data = [("hot" if k % 9 else "b", k, "".join(r.choice("aäß文 \n") for _ in range(r.randrange(40))) if k % 11 else None) for k in range(300)] + [("one", 0, "x"), (None, 0, "")]
    got = {x.g: (x.crc, x.n) for x in runs.checksums(many.createDataFrame(data, "g string, o long, t string").repartition(5), "g", ["o"], "t").collect()}
    for g in ("hot", "b", "one", None):
        own = [t or "" for b, _, t in sorted((d for d in data if d[0] == g), key=lambda d: d[1])]
        assert got[g] == (zlib.crc32("\n".join(own).encode()), len(own))
