"""What a book is read from: page listings, cached page texts, stored state, and the rules that choose among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as X

#: Suffixes of page images.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
#: The first pages that tell whether a file has a text layer, and the characters that a page of one has.
PROBED, TEXT_CHARS = 8, 200
#: What int() takes as a whole number.
WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def list_pages(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """Rows name, path, length: the folder's files of these suffixes. Contents are not read, as the scan drops that column."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length").filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes))


def probe(pages: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """Rows book, n_pages, n_text, kind: text if half of the first pages or more have a text layer, else scan.

    The row limit is applied in each partition before the shuffle, so a hot book is no hot task.
    """
    n = pages.groupBy(F.col(book).alias("book")).agg(F.count(F.lit(1)).alias("n_pages"))
    first = pages.select(F.col(book).alias("first_book"), F.col(order).alias("ord"), (F.length(X.strip(F.coalesce(F.col(text), F.lit("")))) >= TEXT_CHARS).alias("has_text"))
    first = first.withColumn("pos", F.row_number().over(W.partitionBy("first_book").orderBy("ord"))).filter(F.col("pos") <= PROBED)
    first = first.groupBy("first_book").agg(F.count_if("has_text").alias("n_text"), F.count(F.lit(1)).alias("k"))
    both = n.join(first, F.col("book").eqNullSafe(F.col("first_book")))
    return both.select("book", "n_pages", "n_text", F.when(F.col("n_text") >= F.greatest(F.lit(1), F.floor(F.col("k") / 2)), "pdf-text").otherwise("pdf-scan").alias("kind"))


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows page, text, done: stored page texts; a blank one is to be done again."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), "value")
    return rows.select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("page"), F.col("value").alias("text"), not_blank(F.col("value")).alias("done"))


def not_blank(c: Column) -> Column:
    return F.length(X.strip(F.coalesce(c, F.lit("")))) > 0


def paragraphs(text: Column) -> Column:
    """A stored text's paragraphs: what blank lines part, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), X.strip), lambda p: F.length(p) > 0)


def book_of_text(books: DataFrame, key: str, text: str) -> DataFrame:
    """Rows key, idx, src, page, source_lang: a book that has only its source text; the language is taken to be German, pages have no label."""
    rows = books.select(key, F.posexplode(paragraphs(F.col(text))).alias("idx", "src"))
    return rows.withColumn("page", F.lit("")).withColumn("source_lang", F.lit("de"))


def load_book(spark: SparkSession, folder: str) -> DataFrame:
    """Rows title, idx, src, page, source_lang of every state file book.json under the folder."""
    state = "title string, source_lang string, paras array<struct<src: string, page: string>>"
    rows = spark.read.schema(state).json(folder, multiLine=True, pathGlobFilter="book.json", recursiveFileLookup=True)
    return rows.select("title", "source_lang", F.posexplode("paras").alias("idx", "p")).select("title", "idx", "p.src", "p.page", "source_lang")


def int_keys(entries: DataFrame, book: str, key: str) -> DataFrame:
    """entries with whole-number keys; a book with any other key has none at all."""
    bad = entries.filter(F.col(key).isNull() | ~F.col(key).rlike(WHOLE) | F.regexp_replace(F.regexp_replace(key, r"\s", ""), "_", "").try_cast("long").isNull()).select(F.col(book).alias("bad_book")).distinct()
    kept = entries.join(bad, F.col(book).eqNullSafe(F.col("bad_book")), "left_anti")
    return kept.withColumn(key, F.regexp_replace(F.btrim(F.regexp_replace(key, r"\s", "")), "_", "").try_cast("long"))


def locked(report: DataFrame, name: str, flag: str) -> DataFrame:
    """Distinct names that a report's rows lock."""
    return report.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).select(name).distinct()


def by_page(entries: DataFrame, page: str, order: str, *columns: str) -> DataFrame:
    """Entries of a page as one sorted list; a page's entries are few."""
    return entries.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("entries"))


def first_not_blank(*texts: Column) -> Column:
    """The first of the texts that isn't blank, stripped; else an empty text."""
    return F.coalesce(*[F.when(not_blank(t), X.strip(t)) for t in texts], F.lit(""))


def overlay(own: DataFrame, other: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """own, its empty fields filled from other's columns (own's name: other's)."""
    side = other.select(F.col(key).alias("other_key"), *[F.col(b).alias(f"other_{a}") for a, b in names.items()])
    both = own.join(side, F.col(key).eqNullSafe(F.col("other_key")), "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return both.select(*[F.when(empty(c), F.coalesce(F.col(f"other_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in own.columns])


def resolve_presets(hits: DataFrame, preset: str, folder: str, pattern: str, name: str) -> DataFrame:
    """For each preset the first folder's first pattern with a hit, and of its hits the smallest name."""
    best = hits.groupBy(preset).agg(F.min(F.struct(folder, pattern, name)).alias("hit"))
    return best.select(preset, "hit.*")


def data_url(c: Column) -> Column:
    """The bytes that follow the first comma of a data URL, or of all the text if it has none."""
    return F.unbase64(F.when(F.locate(",", c) > 0, F.substring(c, F.locate(",", c) + 1, F.length(c))).otherwise(c))


def cover(pages: DataFrame, book: str, order: str, label: str, chosen: Column) -> DataFrame:
    """Rows book, cover: the label of the chosen page, else of the first one."""
    ranked = F.struct(F.when(chosen, 0).otherwise(1).alias("rank"), F.col(order).alias("ord"), F.col(label).alias("label"))
    return pages.groupBy(F.col(book).alias("book")).agg(F.min(ranked).alias("r")).select("book", F.col("r.label").alias("cover"))
