"""Archives put together in parts, opened with zipfile, and exports sliced by chapter."""

import io
import xml.dom.minidom
import zipfile
from collections import defaultdict

from folioflow.sinks import archives


def test_parts_are_an_archive(spark):
    paras = [("b&1", 1, "Kapitel \"1\"", k, t) for k, t in enumerate(["Kapitel 1", "x < y & **z**", "", "a  b\n>> r", None])] + [("b&1", 2, "", 0, "long " * 30), ("b&1", 3, "Ende", 0, "end")]
    paras += [("empty", 1, "only", 0, "")] + [("many", k, f"c{k}", 0, f"text {k} " * 50) for k in range(1, 121)]
    df = spark.createDataFrame(paras, "book string, k int, label string, o int, t string").repartition(9)
    chapters = archives.chapter_html(df, ["book", "k", "label"], "o", "t")
    titles = spark.createDataFrame([("b&1", "Der <Titel> & \"mehr\""), ("empty", "Leer"), ("many", "Viele"), ("none", "Nichts")], "book string, title string")
    covers = spark.createDataFrame([("b&1", bytearray(b"\xff\xd8jpeg" * 50))], "book string, image binary")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        parts = sorted(archives.archive_parts(archives.book_members(chapters, titles, covers)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = defaultdict(bytes)
    for r in parts:
        files[r.book] += bytes(r.bytes)
    assert set(files) == {"b&1", "empty", "many", "none"}
    for book, data in files.items():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None
            first = z.infolist()[0]
            assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/epub+zip" and data[30:38] == b"mimetype"
            for name in z.namelist():
                if name.endswith(("xml", "opf", "xhtml")):
                    xml.dom.minidom.parseString(z.read(name))
            opf = z.read("OEBPS/content.opf").decode()
            hrefs = [i.getAttribute("href") for i in xml.dom.minidom.parseString(opf).getElementsByTagName("item")]
            assert {f"OEBPS/{h}" for h in hrefs} == set(z.namelist()) - {"mimetype", "META-INF/container.xml", "OEBPS/content.opf"}
            spine = [i.getAttribute("idref") for i in xml.dom.minidom.parseString(opf).getElementsByTagName("itemref")]
            n = {"b&1": 3, "empty": 1, "many": 120, "none": 0}[book]
            assert spine == (["cpg"] if book == "b&1" else []) + [f"c{k}" for k in range(1, n + 1)]
    with zipfile.ZipFile(io.BytesIO(files["b&1"])) as z:
        one = z.read("OEBPS/ch0001.xhtml").decode()
        assert "<h2>Kapitel 1</h2>\n<p>x &lt; y &amp; <strong>z</strong></p>\n<p>a&#160; b<span " in one and "<title>Kapitel &quot;1&quot;</title>" in one
        assert "<h2>" not in z.read("OEBPS/ch0002.xhtml").decode() and ">2</a>" in z.read("OEBPS/nav.xhtml").decode()
        assert z.getinfo("OEBPS/cover.jpg").compress_type == zipfile.ZIP_STORED and z.read("OEBPS/cover.jpg") == b"\xff\xd8jpeg" * 50
    assert max(len(r.bytes) for r in parts if r.book == "many") < len(files["many"]) / 3
