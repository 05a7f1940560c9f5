"""EPUB archives in parts: chapters are packed where they are, offsets are sums over sorted partitions, and a book's directory comes last.

An archive is the bytes of its parts in order. No task holds a book: the largest row is a chapter, and the directory of a book has one entry for each. Archives end
below 4 GB and 65536 members, as the plain format does; beyond it the query fails.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import runs
from folioflow.operators.kept import cut
from folioflow.sinks.books import paragraph_html

# What the formats prescribe.
MIME = "application/epub+zip"
CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
XHTML, OPS, OPF, DC = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/"
#: Every entry's date (1 January 2000), so that equal books are equal bytes.
_DATE = (20 << 9) | (1 << 5) | 1
_UTF8 = 1 << 11


def _tag(name: str, body: Column | None = None, /, **attributes) -> Column:
    """An XML element; attributes are texts or columns and are escaped."""
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k.replace("__", ":").replace("_", "-")}="'), X.escape(v if isinstance(v, Column) else F.lit(v)), F.lit('"')]
    return F.concat(*parts, F.lit("/>")) if body is None else F.concat(*parts, F.lit(">"), body, F.lit(f"</{name}>"))


def _page(title: Column, body: Column, language: str) -> Column:
    head = _tag("head", _tag("title", X.escape(title)))
    return F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n'), _tag("html", F.concat(head, F.lit("\n"), _tag("body", body)), xmlns=XHTML, xmlns__epub=OPS, xml__lang=language), F.lit("\n"))


def book_members(chapters: DataFrame, titles: DataFrame, covers: DataFrame | None = None, language: str = "ko") -> DataFrame:
    """Rows book, ord, name, body (binary), stored: the members of each book's archive, mimetype first.

    chapters: book, k (from 1), label, html (its elements); titles: book, title; covers: book, image (JPEG).
    """
    file = F.format_string("ch%04d.xhtml", "k")
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("k").cast("string"))
    shown = X.strip_inline(label)
    covers = covers if covers is not None else titles.select("book", F.lit(None).cast("binary").alias("image")).limit(0)
    listed = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("k", file.alias("f"), shown.alias("t")))).alias("files"))
    books = titles.join(listed, "book", "left").join(covers.select("book", "image"), "book", "left")
    books = books.withColumns({"files": F.coalesce("files", F.array().cast(listed.schema["files"].dataType)), "covered": F.col("image").isNotNull()})
    each = lambda f: F.array_join(F.transform("files", f), "\n")
    only = lambda c: F.when(F.col("covered"), c).otherwise("")
    uid = F.concat(F.lit("folioflow-"), F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}_]+", "-"), "^-|-$", ""))
    meta = F.concat(_tag("dc:identifier", X.escape(uid), id="uid"), _tag("dc:title", X.escape(F.col("title"))), _tag("dc:language", F.lit(language)), _tag("meta", F.lit("2000-01-01T00:00:00Z"), property="dcterms:modified"), only(_tag("meta", name="cover", content="cimg")))
    items = F.concat(_tag("item", id="nav", href="nav.xhtml", media_type="application/xhtml+xml", properties="nav"), only(F.concat(_tag("item", id="cimg", href="cover.jpg", media_type="image/jpeg", properties="cover-image"), _tag("item", id="cpg", href="cover.xhtml", media_type="application/xhtml+xml"))), each(lambda c: _tag("item", id=F.concat(F.lit("c"), c["k"].cast("string")), href=c["f"], media_type="application/xhtml+xml")))
    spine = F.concat(only(_tag("itemref", idref="cpg")), each(lambda c: _tag("itemref", idref=F.concat(F.lit("c"), c["k"].cast("string")))))
    opf = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), _tag("package", F.concat(_tag("metadata", meta, xmlns__dc=DC), _tag("manifest", items), _tag("spine", spine)), xmlns=OPF, version="3.0", unique_identifier="uid"), F.lit("\n"))
    nav = _page(F.col("title"), _tag("nav", _tag("ol", each(lambda c: _tag("li", _tag("a", X.escape(c["t"]), href=c["f"])))), epub__type="toc"), language)
    own = [(F.lit("mimetype"), F.lit(MIME).cast("binary"), True), (F.lit("META-INF/container.xml"), F.lit(CONTAINER).cast("binary"), False), (F.lit("OEBPS/content.opf"), opf.cast("binary"), False), (F.lit("OEBPS/nav.xhtml"), nav.cast("binary"), False)]
    own += [(F.when(F.col("covered"), "OEBPS/cover.jpg"), F.col("image"), True), (F.when(F.col("covered"), "OEBPS/cover.xhtml"), _page(F.col("title"), _tag("img", src="cover.jpg", alt=F.col("title")), language).cast("binary"), False)]
    heads = books.select("book", F.inline(F.array(*[F.struct(F.lit(i - len(own)).cast("long").alias("ord"), n.alias("name"), b.alias("body"), F.lit(s).alias("stored")) for i, (n, b, s) in enumerate(own)])))
    pages = chapters.select("book", F.col("k").cast("long").alias("ord"), F.concat(F.lit("OEBPS/"), file).alias("name"), _page(label, F.concat(F.lit("\n"), F.coalesce("html", F.lit("")), F.lit("\n")), language).cast("binary").alias("body"), F.lit(False).alias("stored"))
    return heads.filter("name is not null").unionByName(pages)


def chapter_html(paras: DataFrame, chapter: list[str], order: str, text: str) -> DataFrame:
    """Rows chapter..., html: a chapter's paragraphs as elements, its first one a heading if it is short."""
    rows = paras.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("rows"))
    elements = F.filter(F.transform("rows", lambda r, i: paragraph_html(r["t"], i == 0)), lambda e: e.isNotNull())
    return rows.select(*chapter, F.array_join(elements, "\n").alias("html"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with their bytes as they stand in the archive, checksum and sizes."""
    for batch in batches:
        out = []
        for body, stored in zip(batch.column("body"), batch.column("stored").to_pylist(), strict=True):
            raw = body.as_py() or b""
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            out.append((raw if stored else deflate.compress(raw) + deflate.flush(), zlib.crc32(raw), len(raw)))
        data, crc, size = zip(*out, strict=True) if out else ((), (), ())
        kept = [batch.column(c) for c in ("book", "ord", "name", "stored")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary()), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], ["book", "ord", "name", "stored", "data", "crc", "size"])


def _fields(stored: bool, crc: int, packed: int, size: int, name: bytes) -> bytes:
    return struct.pack("<HHHHHIIIHH", 20, _UTF8, 0 if stored else 8, 0, _DATE, crc, packed, size, len(name), 0)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("name", "stored", "data", "crc", "size")), strict=True)
        out = [b"PK\x03\x04" + _fields(stored, crc, len(data), size, n := name.encode()) + n + data for name, stored, data, crc, size in rows]
        yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("ord"), pa.array(out, pa.binary())], ["book", "ord", "bytes"])


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for entries in batch.column("entries").to_pylist():
            rows = [b"PK\x01\x02" + struct.pack("<H", 20) + _fields(e["stored"], e["crc"], e["packed"], e["size"], n := e["name"].encode()) + struct.pack("<HHHII", 0, 0, 0, 0, e["offset"]) + n for e in entries]
            at, body = entries[-1]["offset"] + entries[-1]["length"], b"".join(rows)
            out.append(body + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(rows), len(rows), len(body), at, 0))
        yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("ord"), pa.array(out, pa.binary())], ["book", "ord", "bytes"])


def archive_parts(members: DataFrame) -> DataFrame:
    """Rows book, ord, bytes: the parts of each book's archive, of members book, ord, name, body, stored; in order they are the archive."""
    kind = members.schema["book"].dataType.simpleString()
    packed = members.mapInArrow(_packed, f"book {kind}, ord long, name string, stored boolean, data binary, crc long, size long")
    length = F.lit(30) + F.octet_length("name") + F.octet_length("data")
    placed = cut(runs.scanned(packed, ["book"], ["ord"], {"upto": length}).drop(runs.AT, runs.SEGMENT))
    entry = F.struct("ord", "name", "stored", "crc", "size", F.octet_length("data").cast("long").alias("packed"), (F.col("upto") - length).alias("offset"), length.cast("long").alias("length"))
    ends = placed.groupBy("book").agg(F.array_sort(F.collect_list(entry)).alias("entries"), (F.max("ord") + 1).alias("ord"))
    schema = f"book {kind}, ord long, bytes binary"
    return placed.select("book", "ord", "name", "stored", "data", "crc", "size").mapInArrow(_local, schema).unionByName(ends.select("book", "ord", "entries").mapInArrow(_directory, schema))


def sliced(paras: DataFrame, book: str, order: str, head: str, text: str) -> DataFrame:
    """Rows book, k (from 1), label, start, n, html, plain: a book's paragraphs by chapter; headed ones begin one, and their text is its label.

    What stands before the first head is a chapter without a label if it is more than a fifth of the book, or all of it; else it is left out, as in the ranges of chapters.
    """
    rows = paras.select(F.col(book).alias("book"), F.col(order).alias("o"), F.col(head).alias("head"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = runs.scanned(rows, ["book"], ["o"], {"n": F.lit(1), "k": F.col("head").cast("int")})
    own = rows.groupBy("book", "k").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("rows"), F.count(F.lit(1)).alias("n"), (F.min("n") - 1).alias("start"))
    elements = F.filter(F.transform("rows", lambda r, i: paragraph_html(r["t"], i == 0)), lambda e: e.isNotNull())
    own = cut(own.select("book", "k", "n", "start", F.when(F.col("k") > 0, F.get("rows", F.lit(0))["t"]).otherwise("").alias("label"), F.array_join(elements, "\n").alias("html"), F.array_join(F.transform("rows", lambda r: X.strip_inline(r["t"])), "\n\n").alias("plain")))
    all_ = runs.with_totals(own, ["book"], total=F.sum("n"), heads=F.max("k"), before=F.coalesce(F.max(F.when(F.col("k") == 0, F.col("n"))), F.lit(0)))
    untitled = (F.col("before") > 0) & ((F.col("heads") == 0) | (F.col("before") > 0.2 * F.col("total")))
    return all_.filter((F.col("k") > 0) | untitled).select("book", (F.col("k") + untitled.cast("int")).cast("int").alias("k"), "label", "start", "n", "html", "plain")
