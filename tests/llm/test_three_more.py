"""Personal data, vector codes and resampled series against plain versions in Python, and on odd rows."""

import datetime as dt
import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction
from zoneinfo import ZoneInfo

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import interpolated_lm, personal_data, queries, resampling, vector_codes


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("embeddings", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_resample"])
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


# --- series ----------------------------------------------------------------------------------------------------


def plain_buckets(rows, signal, longest, zone):
    """By the second: each covered second of a segment counts what lies between its ends."""
    best = {}
    for k, sec, cents, order in rows:
        best[k, sec] = max(best.get((k, sec), (-(1 << 70), 0)), (order, cents))
    series = defaultdict(list)
    for (k, sec), (_, cents) in sorted(best.items()):
        series[k].append((sec, cents))
    tz, out = ZoneInfo(zone), defaultdict(lambda: [0, 0, 0])

    def bucket(sec):
        d = dt.datetime.fromtimestamp(sec, tz).date()
        return int(dt.datetime(d.year, d.month, d.day, tzinfo=tz).timestamp())

    for k, points in series.items():
        for i, (sec, v) in enumerate(points):
            out[k, bucket(sec)][0] += 1
            after = points[i + 1] if i + 1 < len(points) else None
            if signal == "step":
                d, w = (min(after[0] - sec, longest) if after else longest), v
            elif after and after[0] - sec <= longest:
                d, w = after[0] - sec, after[1]
            else:
                continue
            upto = lambda u: 2 * v * u + (Fraction((w - v) * u * u, d).__floor__())  # noqa: B023, E731
            for u in range(d):
                cell = out[k, bucket(sec + u)]
                cell[1] += 1
                cell[2] += upto(u + 1) - upto(u)
    return {(k, b, n, c, a, a // (2 * c) if c else None) for (k, b), (n, c, a) in out.items()}


def series(spark, rows):
    at = [(k, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=sec, microseconds=sec % 7), cents / 100, order) for k, sec, cents, order in rows]
    return spark.createDataFrame(at, "client_id string, ts timestamp_ntz, value double, click_id long")


@pytest.mark.parametrize("signal", ["linear", "step"])
@pytest.mark.parametrize("zone,first", [("Europe/Berlin", 1711836000), ("America/Havana", 1710651600), ("UTC", -90000)])
def test_series_against_seconds(spark, signal, zone, first):
    r = random.Random(7)
    rows = [("a", first + s, r.randrange(-9000, 9000), r.randrange(4)) for s in range(0, 90_000, 400) for _ in range(r.randrange(3))]
    rows += [("b", first + 86_000 + 950 * s, 250, 1) for s in range(5)] + [("c", first, -1, 1), ("c", first + 7, 0, 1), ("d", first + 86_399, 3, 2)]
    got = resampling.buckets(series(spark, rows), signal=signal, zone=zone)
    assert {tuple(x) for x in got.collect()} == plain_buckets(rows, signal, 900, zone)


def test_series_across_partitions_and_batches(spark):
    r = random.Random(3)
    rows = [("hot" if k % 3 else f"k{k}", 1_720_000_000 + 60 * k + r.randrange(50), r.randrange(-(10**6), 10**6), k) for k in range(900)]
    want = plain_buckets(rows, "linear", 900, "Europe/Berlin")
    for batch, parts in (("10000", "4"), ("7", "61")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {tuple(x) for x in resampling.buckets(series(spark, rows)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


def test_series_of_large_values_are_exact():
    v = np.array([3 * 10**14, -(10**14)], dtype=np.int64)
    i, start, n, covered, area = resampling.pieces(np.array([0, 899]), v, np.array([True, False]), np.array([899, 899]), v[::-1].copy(), "linear", 900, "UTC")
    assert n.tolist() == [1, 1] and covered.tolist() == [899, 0] and int(area[0]) == 2 * 3 * 10**14 * 899 + (-4 * 10**14 * 899)


def test_odd_series(spark):
    none = series(spark, []).withColumn("k", F.lit(None).cast("int"))
    assert resampling.buckets(none).collect() == []
    at = dt.datetime(2024, 5, 1, 12)
    rows = [(None, at, 1.0, 1), (1, None, 1.0, 1), (1, at, None, 1), (1, at, float("nan"), 9), (1, at, float("inf"), 9), (1, at, 2.0, None), (1, at, 2.0, None), (1, at, 3.0, 4), (1, at, 2.5, 4)]
    odd = spark.createDataFrame([(*x, "x" * 100_000, 1) for x in rows], "client_id int, ts timestamp, value double, click_id long, sec string, cents int")
    out = resampling.buckets(odd, signal="step").collect()
    assert [(r.client_id, r.n_points, r.covered_seconds, r.area2, r.avg_cents) for r in out] == [(1, 1, 900, 2 * 300 * 900, 300)]
    with pytest.raises(ValueError):
        resampling.buckets(odd, signal="cubic")


# --- codes -----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: id, label, whole vector in order of id. Full search, Python's integers."""
    ids, first = [], {}
    for i, v in sorted(rows, key=lambda x: (x[0], x[1])):
        if i not in first and len(first) < entries:
            first[i] = v
        ids.append((i, v))
    dims = len(ids[0][1])
    ends = [-(-p * dims // parts) for p in range(parts + 1)]
    cut = lambda v, p: v[ends[p] : ends[p + 1]]
    books = [[list(cut(v, p)) for v in first.values()] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v in ids:
                got[near(cut(v, p), p)[1]].append(cut(v, p))
            for k, xs in got.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs)]
    found = [[near(cut(v, p), p) for p in range(parts)] for _, v in ids]
    return [(i, [k for _, k in f], sum(d for d, _ in f)) for (i, _), f in zip(ids, found)], books


def whole(v, scale):
    return [int(np.floor(x * scale)) for x in v]


@pytest.mark.parametrize("spread,dims,parts", [(1.0, 8, 4), (0.003, 10, 4), (1e6, 6, 3)])
def test_codes_against_full_search(spark, spread, dims, parts):
    r = random.Random(dims)
    rows = [(k, [round(r.gauss(k % 5, 0.3) * spread, 4) for _ in range(dims)]) for k in range(240)]
    rows += [(300 + k, rows[0][1]) for k in range(40)]
    df = spark.createDataFrame([(i, v, None if i % 3 else i % 7) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    coded, books = vector_codes.compress(df, parts=parts, entries=24, rounds=3)
    want, plain = plain_codes([(i, whole(v, 1024)) for i, v in rows], parts, 24, 3, 1024)
    assert [b.tolist() for b in books] == plain
    assert sorted((x.id, list(x.codes), x.error) for x in coded.collect()) == sorted((i, c, e) for i, c, e in want)


def test_scan_leaves_entries_out(monkeypatch):
    """Exponion's radius: with clusters far apart a row is held against its own list's head alone."""
    monkeypatch.setattr(vector_codes, "STRIDE", 2)
    r = np.random.default_rng(1)
    centres = r.integers(-100_000, 100_000, (64, 4))
    x = np.repeat(centres, 30, 0) + r.integers(-5, 6, (1920, 4))
    book, met = vector_codes.Book(centres, True), [0]
    far = vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda a, b: (met.__setitem__(0, met[0] + len(a) * len(b)), far(a, b))[1])
    best, found = book.nearest(x, np.repeat(np.arange(64), 30))
    assert best.tolist() == np.repeat(np.arange(64), 30).tolist() and met[0] <= 2 * len(x)
    met[0] = 0
    best, found = book.nearest(x, np.zeros(len(x), dtype=np.int64))  # a bad start costs more and finds the same
    assert best.tolist() == np.repeat(np.arange(64), 30).tolist() and met[0] > 2 * len(x)
    wide = vector_codes.Book(centres, False).nearest(x, np.zeros(len(x), dtype=np.int64))
    assert wide[0].tolist() == best.tolist() and wide[1].tolist() == found.astype(int).tolist()


def test_equal_distances_go_to_the_lower_index():
    book = vector_codes.Book(np.array([[4], [0], [0], [-4]]), True)
    for start in range(4):
        assert book.nearest(np.array([[2.0], [0.0], [-2.0]]), np.full(3, start))[0].tolist() == [0, 1, 1]


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int, id int, v string, codes int, part int, sum int"
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [0.5, 2.0, 3.0, 4.0], None), (None, [9.0, 9.0, 9.0, 9.0], None), (1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (3, [1.0, float("nan"), 1.0, 1.0], 2), (4, [float("inf"), 1.0, 1.0, 1.0], 2), (6, [1.0], 3), (7, [-0.0001, 0.0, 0.0, 1e300], 9)]
    df = spark.createDataFrame([(*r, 1, "x" * 9999, 2, 3, 4) for r in rows], kind)
    out = sorted(vector_codes.report(df).collect(), key=lambda r: (r.vec_id or 99, r.error))
    assert [r.vec_id for r in out] == [5, 5, 7, None] and len({r.codebooks_sha256 for r in out}) == 1
    assert all(re.fullmatch("[0-9a-f]{8}", r.code) for r in out) and all(r.error <= r.label_error for r in out)
    coded, books = vector_codes.compress(df.filter("vec_id = 5 or vec_id is null"))
    assert books[0].tolist() == [[512], [9216]] or books[0].tolist() == [[768], [9216]]
    assert vector_codes.report(df.limit(0)).collect() == [] and vector_codes.report(df.filter("vec_id = 1")).collect() == []
    assert vector_codes.cuts(10, 4) == [slice(0, 3), slice(3, 5), slice(5, 8), slice(8, 10)]


# --- personal data ---------------------------------------------------------------------------------------------

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_seeds(text):
    out = []
    for kind, form in FORMS:
        for m in re.finditer(form, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            odd = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(digits[::-1])]
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and sum(odd) % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_seeds_by_plain_forms(spark, sf):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    out = queries.op11_personal_data(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        want = plain_seeds(docs[r.doc_id])
        assert [r[f"n_{k}"] for k, _ in FORMS] == [sum(x[0] == k for x in want) for k, _ in FORMS]
        listed = ",".join(":".join(map(str, x)) for x in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_seeds_of_hostile_texts():
    r = random.Random(5)
    for k in range(3000):
        text = "".join(r.choice(["@", ".", "a", "9", "-", "+", " ", "255", "(", "é", "1.2.3.4", "x@y.z", "4929348385146306", "+1 234 567-89"]) for _ in range(r.randrange(1, 24)))
        assert sorted(personal_data.seeds(text)) == sorted(plain_seeds(text)), text
    huge = "a" * 400_000 + "@" + "b" * 400_000 + " " + "7" * 300_000 + " " + "+1" + " " * 300_000
    assert [k for k, _, _ in personal_data.seeds(huge)] == [] and personal_data.candidates(huge, []) == []
    assert personal_data.seeds("ä" * 70_000 + " a@b.c") == [("email", 70_001, 70_006)]


def contexts():
    known = [f"Bitte meine Handynummer lautet +49 171 55{k:05d} danke sehr" for k in range(6)]
    known += [f"write to the mailbox: user{k}@example.org for help" for k in range(9)]
    known += [f"see number +49 30 11{k:05d} or box {k}3{k}4567 of it" for k in range(5)]  # a word before, of mixed fillers
    unseen = ["ja meine Handynummer lautet 0171 22 33 44 5 ok", "the mailbox: jörg@müller is mine", "the mailbox: info (at) firm (dot) com now", "I dial 0171 22 33 44 5 at night"]
    clean = ["the box 1234567 of it", "chapter 12 of 2024-05-17 is a date", "some words only", "call 0800 123 456 then"]
    return known, unseen, clean


def test_unseen_identifiers_are_found_by_their_words(spark):
    known, unseen, clean = contexts()
    texts = known * 2 + unseen + clean  # copies add no support
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in personal_data.report(docs).collect()}
    part = lambda i: [texts[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x)]
    at = len(known) * 2
    assert part(at) == ["0171 22 33 44 5"] and got[at].spans.startswith("phone:") and got[at].n_phone == 0
    assert part(at + 1) == ["jörg@müller"] and part(at + 2) == ["info (at) firm (dot) com"] and got[at + 2].spans.startswith("email:")
    assert part(at + 3) == ["0171 22 33 44 5"]  # known by its value from another place
    assert all(got[i].spans == "" for i in range(at + 4, len(texts)))
    once = spark.createDataFrame([(k, t) for k, t in enumerate(known[:1] * 9 + unseen)], "doc_id long, text string")
    assert all(r.spans == "" for r in personal_data.report(once).collect() if r.doc_id >= 9)


def plain_bootstrap(texts):
    """The same graph in dictionaries."""
    kinds, rounds = personal_data.KINDS, personal_data.ROUNDS
    spans = []
    for i, t in enumerate(texts):
        own = personal_data.seeds(t)
        spans += [(i, kinds.index(k), a, b, 0) for k, a, b in own] + [(i, -1, a, b, bits) for a, b, bits in personal_data.candidates(t, own)]
    value = lambda x: personal_data.value_key(texts[x[0]][x[2] : x[3]])
    kind, bits, held, of = defaultdict(lambda: -1), defaultdict(int), defaultdict(set), defaultdict(set)
    for x in spans:
        v = value(x)
        kind[v], bits[v] = max(kind[v], x[1]), max(bits[v], x[4])
        for p in personal_data.patterns(texts[x[0]], x[2], x[3]):
            held[p].add(v)
            of[v].add(p)
    score = {v: [float(kind[v] == k) for k in range(4)] for v in kind}
    for _ in range(rounds):
        trust = {}
        for p, vs in held.items():
            sums = [sum(score[v][k] for v in vs) for k in range(4)]
            c = [s / (len(vs) + 1) if s >= 3 and s / (len(vs) + 1) >= 0.7 else 0.0 for s in sums]
            if max(c) > 0:
                trust[p] = c
        new = {}
        for v in kind:
            if kind[v] == -1 and (ps := [trust[p] for p in of[v] if p in trust]):
                s = [1 - np.prod([1 - c[k] for c in ps]) if bits[v] >> k & 1 else 0.0 for k in range(4)]
                if max(s) >= 0.7:
                    new[v] = s
        score = {v: new.get(v, [float(kind[v] == k) for k in range(4)]) for v in kind}
    of_kind = {v: kind[v] if kind[v] >= 0 else int(np.argmax(new[v])) for v in kind if kind[v] >= 0 or v in new}
    out = defaultdict(list)
    for x in spans:
        k = x[1] if x[1] >= 0 else of_kind.get(value(x), -1)
        if k >= 0 and (x[1] >= 0 or x[4] >> k & 1):
            out[x[0]].append((k, x[2], x[3]))
    return [",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(out[i])) for i in range(len(texts))]


def test_graph_against_dictionaries(spark):
    r = random.Random(11)
    cues = ["my phone", "our card is", "host", "mail me", "id", "the number", "tel:", "and so"]
    fill = [lambda: f"+1 {r.randrange(10**3)} {r.randrange(10**7)}", lambda: f"0{r.randrange(10**9)}", lambda: f"u{r.randrange(90)}@h.org", lambda: f"u{r.randrange(9)}@h", lambda: f"10.0.{r.randrange(99)}.{r.randrange(99)}", lambda: f"{r.randrange(10**15, 10**16)}", lambda: "words"]
    texts = []
    for _ in range(500):
        out = []
        for _ in range(r.randrange(1, 5)):
            c = r.randrange(len(cues))
            out.append(f"{cues[c]} {fill[(c + r.choice([0, 0, 0, 1, r.randrange(7)])) % len(fill)]()} then")
        texts.append(" ".join(out))
    got = {x.doc_id: x.spans for x in personal_data.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == plain_bootstrap(texts)
    assert sum(len(g.split(",")) for g in got.values() if g) > sum(len(personal_data.seeds(t)) for t in texts)


def test_odd_documents(spark):
    kind = "doc_id long, text string, id int, uid int, kind int, value string, seeds int"
    rows = [(None, None), (None, "a@b.c"), (1, ""), (2, "x@y.zz and +1 234 567 89"), (2, "x@y.zz and +1 234 567 89"), (1 << 60, "1.2.3.4 " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "v", 4) for r in rows], kind)
    out = sorted(personal_data.report(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_spans))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out] == [(None, 0, 0, 0, 0), (None, 1, 0, 0, 0), (1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (2, 1, 0, 0, 1), (1 << 60, 0, 20_000, 0, 0)]
    assert personal_data.report(docs.limit(0)).collect() == []
    assert pa.types.is_int64(dict(personal_data._SPANS)["value"])


def test_counts_beyond_32_bits():
    h = np.array([3, 9, 12], np.uint64)
    most = np.full(3, (1 << 32) - 1, np.uint32)
    at, total, apart = interpolated_lm._sums([h, h[1:], h], [most, most[1:], np.array([1, 2, 3], np.uint32)], [False, True, False])
    assert total.tolist() == [1 << 32, 2 * ((1 << 32) - 1) + 2, 2 * ((1 << 32) - 1) + 3] and apart.tolist() == [0, (1 << 32) - 1, (1 << 32) - 1]
    again = interpolated_lm._unpack(interpolated_lm._pack(total, apart))
    assert again[0].tolist() == total.tolist() and again[0].astype(np.float64)[1] == float(2 * ((1 << 32) - 1) + 2)
    assert at.tolist() == [0, 1, 2, 1, 2, 0, 1, 2]
