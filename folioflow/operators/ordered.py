"""Order-dependent operators: folds over ordered rows, and islands.

A fold whose state may be cut at known places runs over the segments between them, which are found over sorted partitions (runs). The others run per group
over an ordered array, as their state depends on all that they decided before. Islands use windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import runs
from folioflow.operators.kept import cut, sized


def in_order(order: str, *fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *fields)))


def join_pieces(left: Column, right: Column) -> Column:
    """left and right as one paragraph: a hyphen at the line's end goes, CJK needs no space."""
    left = F.rtrim(left)
    hyphen = left.endswith("-") & ~left.endswith(" -")
    cjk = F.right(left, F.lit(1)).rlike(T.CJK) & F.left(right, F.lit(1)).rlike(T.CJK)
    return F.when(hyphen, F.concat(F.left(left, F.length(left) - 1), right)).when(cjk, F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))


def merged_pieces(pieces: DataFrame, group: str, order: list[str], piece: str, place: str) -> DataFrame:
    """Rows group, idx, text, first, last (the places of its first and last piece): paragraphs of pieces, in order.

    A piece is joined to what stands before it unless either is a heading or that ends a sentence. Whether a piece is a heading, and whether what ends with it ends
    a sentence, is known from the piece alone; so paragraphs break for certain around those, and a group falls into segments that are folded on their own. Inside a
    segment one more thing breaks: pieces that are no heading alone may be one when joined. No row holds more than a segment, and a group is numbered over its partitions.
    """
    marked = runs.scanned(pieces.select(group, *order, F.col(piece).alias("piece_"), F.col(place).alias("place_")), [group], order, opens=T.is_heading(F.col("piece_")), closes=T.is_heading(F.col("piece_")) | T.ends_sentence(F.rtrim("piece_")))
    rows = marked.groupBy(group, runs.SEGMENT).agg(F.array_sort(F.collect_list(F.struct(runs.AT, "piece_", "place_"))).alias("rows"))
    kind = pieces.schema[place].dataType.simpleString()
    para = f"struct<text:string,first:{kind},last:{kind}>"

    def step(acc: Column, row: Column) -> Column:
        last, now = acc["last"], row["piece_"]
        joins = last.isNotNull() & ~T.is_heading(last["text"]) & ~T.is_heading(now) & ~T.ends_sentence(F.rtrim(last["text"]))
        new = F.struct(F.when(joins, join_pieces(last["text"], now)).otherwise(now).alias("text"), F.when(joins, last["first"]).otherwise(row["place_"]).alias("first"), row["place_"].alias("last"))
        return F.struct(F.when(joins | last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last)).alias("done"), new.alias("last"))

    start = F.struct(F.array().cast(f"array<{para}>").alias("done"), F.lit(None).cast(para).alias("last"))
    merged = F.aggregate("rows", start, step, lambda a: F.array_append(a["done"], a["last"]))
    paras = rows.select(group, F.col(runs.SEGMENT).alias("seg"), F.posexplode(merged).alias("part", "p")).select(group, "seg", "part", "p.*")
    return runs.ordinals(paras, [group], ["seg", "part"], "n").select(group, (F.col("n") - 1).cast("int").alias("idx"), "text", "first", "last")


def merge_paragraphs(pieces: DataFrame, group: str, order: str, piece: str) -> DataFrame:
    """Rows group, idx, text: a piece is joined to what stands before it unless either is a heading or that ends a sentence."""
    return merged_pieces(pieces, group, [order], piece, order).select(group, "idx", "text")


def greedy_chunks(rows: DataFrame, group: str, order: str, size: str, limit: int, before: bool = False) -> DataFrame:
    """rows (group, order, size) with chunk: a chunk closes once it holds limit; with before, rather than to exceed limit.

    The fold keeps where chunks begin, not a number for each row, so that its state grows with the chunks alone.
    """
    packed = rows.groupBy(group).agg(in_order(order, size).alias("rows"))

    def step(acc: Column, row: Column) -> Column:
        n = row[size].cast("long")
        begins = (acc["at"] == 0) | (((acc["sum"] + n > limit) & (acc["sum"] > 0)) if before else (acc["sum"] >= limit))
        starts = F.when(begins, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"])
        return F.struct((acc["at"] + 1).alias("at"), F.when(begins, n).otherwise(acc["sum"] + n).alias("sum"), starts.alias("starts"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("starts"))
    out = packed.select(group, "rows", F.aggregate("rows", start, step, lambda a: a["starts"]).alias("starts"))
    out = out.select(group, "rows", "starts", F.posexplode("starts").alias("chunk", "s"))
    end = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("rows"))
    own = out.select(group, "chunk", F.explode(F.slice("rows", F.col("s") + 1, end - F.col("s"))).alias("r"))
    return own.select(group, F.col(f"r.{order}").alias(order), F.col(f"r.{size}").alias(size), "chunk")


def islands(rows: DataFrame, group: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """rows with the number of the island they are in; starts is true where one begins (null at the first row)."""
    by = W.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("starts_", F.coalesce(starts, F.lit(False)).cast("int"))
    return marked.withColumn(name, F.sum("starts_").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("starts_")


def ranges(heads: DataFrame, group: str, idx: str, n: str) -> DataFrame:
    """Half-open ranges from each idx to the next, the last to n."""
    by = W.partitionBy(group).orderBy(idx)
    return heads.withColumn("end", F.coalesce(F.lead(idx).over(by), F.col(n)))


def chapter_ranges(pages: DataFrame, group: str, order: str, head: str) -> DataFrame:
    """Rows group, start, end: half-open ranges from each headed page to the next one, the last to the group's end; pages count from 0.

    If no head comes in the first fifth, the group's first page begins a chapter too. Heads are numbered over sorted partitions, and a chapter's end is
    found by the number of the next head: no window holds a group.
    """
    rows = runs.scanned(pages.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(head).alias("head")), ["group"], ["order"], {"n": F.lit(1), "k": F.col("head").cast("int")})
    rows = cut(rows.select("group", "head", "n", "k"))
    of = rows.groupBy("group").agg(F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("head"), F.col("n") - 1)).alias("first"), F.max("k").alias("heads"))
    of = cut(of.withColumn("untitled", F.col("first").isNull() | (F.col("first") > 0.2 * F.col("total"))))
    heads = rows.filter("head").select("group", "k", (F.col("n") - 1).alias("start")).unionByName(of.filter("untitled").select("group", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("start")))
    nexts = heads.filter("k > 0").select(F.col("group").alias("of"), (F.col("k") - 1).alias("before"), F.col("start").alias("end"))
    ends = heads.join(nexts, F.col("group").eqNullSafe(F.col("of")) & (F.col("k") == F.col("before")), "left").drop("of", "before")
    totals = sized(of.select(F.col("group").alias("of"), "total"))
    return ends.join(totals, F.col("group").eqNullSafe(F.col("of"))).select("group", "start", F.coalesce("end", "total").alias("end"))


def middles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows group, upper (the upper one of the middle), middle (the median) and low (the one above a tenth), exactly and without gathering a group."""
    n = F.col("n")
    picked = runs.selected(rows, group, value, {"upper": F.floor(n / 2), "below": F.floor((n - 1) / 2), "low": F.floor(n / 10)})
    return picked.select(group, "upper", ((F.col("below") + F.col("upper")) / 2).alias("middle"), "low")


def hyphen_joined(c: Column) -> Column:
    """The lines of a paragraph as one: blank ones go, a hyphen at a line's end too, CJK needs no space."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), T.strip), lambda x: x != "")
    return F.coalesce(F.aggregate(lines, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(join_pieces(a, x))), F.lit(""))


def page_pieces(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """Rows book, page, j, piece: the paragraphs of each page, parted by blank lines, hyphen-joined; j counts those that are not blank."""
    own = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n", -1), T.strip), lambda x: x != "")
    rows = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.posexplode(own).alias("j", "piece"))
    return rows.withColumn("piece", hyphen_joined(F.col("piece")))


def repeated_heads(pieces: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """Rows book, head: short first paragraphs of three pages or a tenth of the book's at least, whichever is more."""
    n = pages.groupBy(F.col(book).alias("book")).agg(F.count(F.lit(1)).alias("pages"))
    heads = pieces.filter((F.col("j") == 0) & (F.length("piece") <= T.HEADING_MOST)).groupBy("book", F.lower("piece").alias("head")).agg(F.count(F.lit(1)).alias("n"))
    return heads.join(n, "book").filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 10))).select("book", "head")


def merge_page_spans(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """Rows book, idx, text, page, page_end: a book's paragraphs across its pages, in order of page.

    Page numbers and repeated heads (of the page's first paragraph) go. A piece is joined to what stands before it, on another page too, unless either
    is a heading or that ends a sentence. The pieces are kept, as heads are counted over all of them first.
    """
    pieces = cut(page_pieces(pages, book, page, text))
    heads = repeated_heads(pieces, pages, book)
    kept = pieces.filter((F.col("piece") != "") & ~T.is_page_number(F.col("piece")))
    kept = kept.join(heads, (kept.book == heads.book) & (F.col("j") == 0) & (F.lower("piece") == F.col("head")), "left_anti")
    return merged_pieces(kept, "book", ["page", "j"], "piece", "page").select("book", "idx", "text", F.col("first").alias("page"), F.col("last").alias("page_end"))
