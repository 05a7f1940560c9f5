"""Sources and sinks on files, and their odd cases."""

import io
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.sinks import books as K
from folioflow.sources import books as S


def test_listing_reads_no_contents(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "notes.txt"):
        (tmp_path / n).write_bytes(b"xx")
    rows = S.list_pages(spark, str(tmp_path))
    assert sorted((r.name, r.length) for r in rows.collect()) == [("a.jpg", 2), ("b.PNG", 2)]
    assert "content#" not in rows._jdf.queryExecution().executedPlan().toString()


def test_cached_pages(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("one\ntwo")
    (tmp_path / "p2.txt").write_text(" \n")
    assert sorted((r.page, r.done) for r in S.cached_pages(spark, str(tmp_path)).collect()) == [("p1", True), ("p2", False)]


def test_load_book(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"title": "t", "source_lang": "ja", "paras": [{"src": "x", "page": "1"}, {"src": "y", "page": ""}]}, indent=1))
    assert [tuple(r) for r in S.load_book(spark, str(tmp_path)).orderBy("idx").collect()] == [("t", 0, "x", "1", "ja"), ("t", 1, "y", "", "ja")]


def test_paragraphs_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, " a \n\n\n\nb\n\n \n\n"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r)[:3] for r in S.book_of_text(rows, "id", "text").orderBy("idx").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_int_keys_drop_whole_books(spark):
    rows = spark.createDataFrame([("a", " 1 "), ("a", "+1_0"), ("b", "2"), ("b", "x"), ("c", None), (None, "-3")], "book string, key string")
    assert sorted((r.book or "", r.key) for r in S.int_keys(rows, "book", "key").collect()) == [("", -3), ("a", 1), ("a", 10)]


def test_probe(spark):
    pages = [("t", i, "x" * 200) for i in range(4)] + [("t", 4 + i, " ") for i in range(20)] + [("s", 0, None), (None, 1, "y" * 300)]
    got = S.probe(spark.createDataFrame(pages, "book string, n int, text string"), "book", "n", "text").collect()
    assert {r.book: (r.n_pages, r.kind) for r in got} == {"t": (24, "pdf-text"), "s": (1, "pdf-scan"), None: (1, "pdf-text")}


def test_data_url(spark):
    rows = spark.createDataFrame([("data:x;base64,YWI=",), ("YWI=",), (None,)], "u string").select(S.data_url(F.col("u")).alias("b")).collect()
    assert [r.b if r.b is None else bytes(r.b) for r in rows] == [b"ab", b"ab", None]


def test_written_text_keeps_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", i, f"p{i}") for i in range(50)][::-1], "book string, i int, text string")
    K.write_text(rows, str(tmp_path / "out"), "book", "i", "text")
    files = sorted(Path(tmp_path / "out" / "book=b").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "".join(f"p{i}\n\n" for i in range(50))


def test_epub(spark):
    rows = spark.createDataFrame([("B", "two", 2, "Head"), ("B", "two", 3, "a < b"), ("B", "one", 0, "x" * 61), ("B", "one", 1, "")], "book string, ch string, i int, text string")
    first, again = (bytes(K.epubs(rows.repartition(n), "book", "ch", "i", "text").first().epub) for n in (1, 3))
    assert first == again
    z = zipfile.ZipFile(io.BytesIO(first))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert f"<p>{'x' * 61}</p>" in z.read("OEBPS/c0001.xhtml").decode()
    assert "<h2>Head</h2>\n<p>a &lt; b</p>" in z.read("OEBPS/c0002.xhtml").decode()


def test_reset_modes(spark):
    rows = spark.createDataFrame([("xlat",), ("book",), ("fp",)], "kind string")
    assert [r.moved for r in K.reset(rows, "kind", "xlat").collect()] == [1, 0, 0]
    with pytest.raises(ValueError):
        K.reset(rows, "kind", "other")
