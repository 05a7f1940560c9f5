"""Writers of texts and books, and the rows that manifests, logs and reset runs consist of."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X

#: A first paragraph of this length or less is a chapter's heading.
HEADING_CHARS = 60
#: The date in every entry of an archive, so that equal books are equal bytes.
DATE = (2000, 1, 1, 0, 0, 0)


def write_text(paras: DataFrame, path: str, book: str, order: str, text: str) -> None:
    """A folder for each book; its part files, in order of name, hold the paragraphs in order, each followed by a blank line.

    Rows are ranged by book and order, so that a large book is many files and no task holds it whole.
    """
    rows = paras.repartitionByRange(book, order).sortWithinPartitions(book, order)
    rows.select(book, F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(book).option("lineSep", "\n\n").text(path)


def paragraph_html(text: Column, first: Column) -> Column:
    """A paragraph's element; a short first one is a heading. Empty ones have none (null)."""
    body = X.inline_html(text)
    element = F.when(first & (F.length(text) <= HEADING_CHARS), F.concat(F.lit("<h2>"), body, F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    return F.when(F.length(text) > 0, element)


def epubs(paras: DataFrame, book: str, chapter: str, order: str, text: str, language: str = "ko", covers: dict[str, bytes] | None = None) -> DataFrame:
    """Rows book, epub: an archive for each book from its paragraphs; one book has to fit one task. covers: JPEG images of books that have one."""
    covers = covers or {}
    marked = paras.select(F.col(book).cast("string").alias("book"), F.col(chapter).cast("string").alias("chapter"), F.col(order).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    heads = marked.groupBy("book", "chapter").agg(F.min("ord").alias("head"))
    marked = marked.join(heads, ["book", "chapter"]).withColumn("element", paragraph_html(F.col("text"), F.col("ord") == F.col("head")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        title = rows["book"].iloc[0]
        chapters = [(name, part.sort_values("ord")["element"].dropna().tolist()) for name, part in rows.sort_values("head").groupby("chapter", sort=False)]
        return pd.DataFrame({"book": [title], "epub": [archive(title, chapters, language, covers.get(title))]})

    return marked.select("book", "chapter", "ord", "head", "element").groupBy("book").applyInPandas(pack, "book string, epub binary")


def archive(title: str, chapters: list[tuple[str, list[str]]], language: str = "ko", cover: bytes | None = None) -> bytes:
    """A minimal EPUB 3: mimetype first and stored, a navigation file, a file for each chapter, and the cover if there is one."""
    out = io.BytesIO()
    uid = "folioflow-" + re.sub(r"\W+", "-", title.lower()).strip("-")
    page = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head><title>{}</title></head>\n<body>{}</body></html>\n'
    files = [(f"c{i:04d}.xhtml", name or str(i), elements) for i, (name, elements) in enumerate(chapters, 1)]
    items = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, (f, _, _) in enumerate(files, 1))
    items += '<item id="cover" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>' if cover else ""
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(files) + 1))
    links = "".join(f'<li><a href="{f}">{html.escape(name)}</a></li>' for f, name, _ in files)
    parts = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{uid}</dc:identifier><dc:title>{html.escape(title)}</dc:title><dc:language>{html.escape(language)}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>',
        "OEBPS/nav.xhtml": page.format(html.escape(title), f'<nav epub:type="toc"><ol>{links}</ol></nav>'),
    } | {f"OEBPS/{f}": page.format(html.escape(name), "\n".join(elements)) for f, name, elements in files}
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", DATE), "application/epub+zip", zipfile.ZIP_STORED)
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, DATE), body, zipfile.ZIP_DEFLATED)
        if cover:
            z.writestr(zipfile.ZipInfo("OEBPS/cover.jpg", DATE), cover, zipfile.ZIP_STORED)
    return out.getvalue()


def replace_pages(manifest: DataFrame, fresh: DataFrame, page: str) -> DataFrame:
    """manifest without the rows of pages that fresh holds, and fresh's rows."""
    pages = fresh.select(F.col(page).alias("fresh_page")).distinct()
    return manifest.join(pages, F.col(page).eqNullSafe(F.col("fresh_page")), "left_anti").unionByName(fresh)


def embedded(json: Column) -> Column:
    """JSON text that may stand in a script element: no closing tag in it."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def log_lines(report: DataFrame, name: str, status: str, note: str) -> DataFrame:
    """Rows line: tab-separated, for what is not ok."""
    return report.filter(F.coalesce(F.col(status), F.lit("")) != "ok").select(F.concat_ws("\t", F.coalesce(F.col(name).cast("string"), F.lit("")), F.coalesce(status, F.lit("")), F.coalesce(note, F.lit(""))).alias("line"))


def archive_manifest(finals: DataFrame, locks: DataFrame, stem: str) -> DataFrame:
    """Rows stem, locked: what an archive of final pages holds; a page without an own row is not locked."""
    flag = locks.select(F.col(stem).alias("lock_stem")).distinct().withColumn("on", F.lit(1))
    return finals.select(stem).distinct().join(flag, F.col(stem).eqNullSafe(F.col("lock_stem")), "left").select(stem, F.coalesce("on", F.lit(0)).alias("locked"))


def cached(pages: DataFrame, cache: DataFrame, page: str, params: list[str], shape: list[str]) -> DataFrame:
    """pages with key (their time and parameters) and hit: whether the cache holds that key with the same shape."""
    key = F.concat_ws("-", *[F.col(p).cast("string") for p in params])
    side = cache.select(F.col(page).alias("cache_page"), F.col("key").alias("cache_key"), *[F.col(s).alias(f"cache_{s}") for s in shape])
    same = F.col("key").eqNullSafe(F.col("cache_key"))
    for s in shape:
        same = same & F.col(s).eqNullSafe(F.col(f"cache_{s}"))
    both = pages.withColumn("key", key).join(side, F.col(page) == F.col("cache_page"), "left")
    return both.select(*pages.columns, "key", F.when(same, 1).otherwise(0).alias("hit"))


def reset(state: DataFrame, kind: str, mode: str) -> DataFrame:
    """state with moved: what a run that starts anew puts aside; xlat: translations alone, all: pages and book too."""
    if mode not in ("xlat", "all"):
        raise ValueError(f"no such mode: {mode}")
    kinds = ["xlat"] if mode == "xlat" else ["xlat", "book", "pages"]
    return state.withColumn("moved", F.when(F.col(kind).isin(*kinds), 1).otherwise(0))
