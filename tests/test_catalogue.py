"""Every registered query against its SQL on the same tables, and folds against plain loops."""

import hashlib
import re

import duckdb
import pytest

from folioflow.functions import text as T
from folioflow.operators import ordered, review
from folioflow.plans import catalogue, entries, files, rules, states  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = df.collect()
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())


def heading(s):
    s = s.strip()
    if s.startswith("## "):
        return True
    if not s or len(s) > 60 or s[-1] in T.SENTENCE_END:
        return False
    return bool(re.match(T.CHAPTER, s) or re.match(T.CHAPTER_JA, s) or (len(s) <= 30 and s.isupper()))


def joined(a, b):
    a = a.rstrip()
    if a.endswith("-") and not a.endswith(" -"):
        return a[:-1] + b
    return a + b if re.match(T.CJK, a[-1]) and re.match(T.CJK, b[0]) else f"{a} {b}"


def merged(pieces):
    out = []
    for p in pieces:
        if out and not heading(out[-1]) and not heading(p) and out[-1].rstrip()[-1] not in T.SENTENCE_END:
            out[-1] = joined(out[-1], p)
        else:
            out.append(p)
    return out


def test_merge_paragraphs(spark, sf):
    got = {}
    for r in rules.merge_paragraphs(spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.text
    for r in catalogue.docs(spark, sf, "doc_id", "text").collect():
        pieces = [x for x in (line.strip() for line in r.text.split("\n")) if x and not re.match(T.PAGE_NUMBER, x)]
        assert [got.get(r.doc_id, {})[i] for i in range(len(got.get(r.doc_id, {})))] == [hashlib.md5(p.encode()).hexdigest() for p in merged(pieces)]


@pytest.mark.parametrize(
    ("pieces", "want"),
    [(["Er ging", "nach Hause.", "Neu"], ["Er ging nach Hause.", "Neu"]), (["Kapi-", "tel", "und so"], ["Kapitel", "und so"]), (["Ge-", "fahr"], ["Gefahr"]), (["a -", "b"], ["a - b"]), (["日本", "語"], ["日本語"])],
)
def test_merge_cases(spark, pieces, want):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pieces)], "g int, i int, p string")
    assert [r.text for r in ordered.merge_paragraphs(rows, "g", "i", "p").orderBy("idx").collect()] == want


def test_text_cases(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.is_page_number(F.lit(s))) for s in ("– 12 –", "１２", "12345")] == [True, True, False]
    assert one(T.clean_spaces(F.lit("a b​c　d"))) == "a bc　d"
    assert one(T.language(*T.language_scores(F.lit("")))) == "de"
    assert one(T.without_mark(F.lit(" ## Titel"))) == "Titel"
    assert one(T.strip_inline(F.lit("**a** ~~b~~ ++c++ *d*"))) == "a b c d"


@pytest.mark.parametrize(("text", "want"), [("5-", (5, 10**9)), ("~3", (1, 3)), ("7", (7, 7)), ("", (1, 10**9))])
def test_page_range(text, want):
    assert review.page_range(text) == want


@pytest.mark.parametrize("text", ["9-2", "-", "0-3", "1-2-3"])
def test_bad_page_range(text):
    with pytest.raises(ValueError):
        review.page_range(text)


def test_fence_drops_what_was_queued(spark):
    rows = [(1, 1, 1, 5, "a"), (1, 2, 1, 6, "b"), (1, 3, 2, 5, "c")]
    got = review.fenced_latest(spark.createDataFrame(rows, "book int, seq int, fp int, idx int, text string")).collect()
    assert [(r.idx, r.text) for r in got] == [(5, "c")]


def test_stream_equals_batch(spark, tmp_path):
    import json
    import os

    from folioflow.streaming import edits

    rows = [{"book": i % 3, "seq": i, "fp": i // 20, "idx": i % 5, "text": f"t{i}"} for i in range(50)]
    (tmp_path / "in").mkdir()
    for step in range(2):
        own = rows[step * 25 : step * 25 + 25]
        f = tmp_path / "in" / f"{step}.json"
        f.write_text("\n".join(map(json.dumps, own)))
        os.utime(f, (1000 + step, 1000 + step))
        edits.write_state(edits.read_queue(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    want = review.fenced_latest(spark.createDataFrame(rows, edits.SCHEMA))
    key = lambda df: sorted((r.book, r.idx, r.text, r.fp, r.seq) for r in df.collect())
    assert key(edits.read_state(spark, str(tmp_path / "state"))) == key(want)


def test_whole_texts_are_stripped_and_aligned(spark, sf):
    text = {(r.conv_id, r.turn): r.text for r in catalogue.read(spark, sf, "conversations").collect()}
    assert max(len(t or "") for t in text.values()) > 40
    for r in catalogue.queries()["think_strip"](spark, sf).collect():
        raw = f"<think></think>[{text[r.conv_id, r.turn]}]<think>rest"
        assert text[r.conv_id, r.turn] is None or r.answer == re.sub(r"(?s)<think>.*?(</think>|$)", "", raw)
    assert {r.text for r in catalogue.queries()["reply_align"](spark, sf).collect()} <= {None, *text.values()}
