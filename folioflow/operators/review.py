"""Joins and state of transcription review: consensus, alignment, merges, fenced edits, actions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from folioflow.functions import rules as R
from folioflow.functions import text as T
from folioflow.operators import runs
from folioflow.operators.kept import cut, sized

#: Up to so many rules a price list is one expression; a longer one is joined by the prefixes of the names.
FEW_PRICES = 200


def consensus(first: DataFrame, second: DataFrame, verified: DataFrame, keys: list[str], asked: DataFrame | None = None, batch: bool = True) -> DataFrame:
    """Two passes (text, kind, confidence, uncertain) and a verifier's rows: keys, text, kind, confidence, passes, alt_pass1, alt_pass2.

    asked: the keys that were asked for; one that neither pass has is a row that failed. Not in a batch, an unverified row keeps the second reading alone.
    """
    fields = ["text", "kind", "confidence", "uncertain"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in fields], F.lit(True).alias(p + "is"))
    both = side(first, "a_").join(side(second, "b_"), keys, "full_outer")
    both = both if asked is None else asked.select(*keys).join(both, keys, "left")
    both = both.join(side(verified, "v_"), keys, "left")
    blank = lambda p: F.btrim(F.coalesce(F.col(p + "text"), F.lit(""))) == ""
    norm = lambda p: F.array_join(F.transform(F.split(F.btrim(F.coalesce(F.col(p + "text"), F.lit(""))), "\n"), lambda x: F.btrim(x)), "\n")
    agree = (norm("a_") == norm("b_")) & F.col("a_kind").eqNullSafe(F.col("b_kind"))
    sure = (F.col("a_confidence") == "high") & (F.col("b_confidence") == "high") & ~F.col("a_uncertain") & ~F.col("b_uncertain")
    passes = (
        F.when(F.col("a_is").isNull() & F.col("b_is").isNull(), "failed")
        .when(F.col("a_is").isNull() | F.col("b_is").isNull(), "single")
        .when((blank("a_") & blank("b_")) | (agree & sure), "agree")
        .when(F.col("v_is").isNotNull(), "adjudicated")
        .otherwise("unverified")
    )
    how = F.col("passes")
    pick = lambda c: F.when(how == "adjudicated", F.col("v_" + c)).when(F.col("a_is").isNull(), F.col("b_" + c)).otherwise(F.col("a_" + c))
    doubtful = (how == "unverified") | ((how == "single") & pick("uncertain"))
    confidence = F.when(how == "failed", "low").when(doubtful & (pick("confidence") == "high"), "medium").otherwise(pick("confidence"))
    alt1 = F.when((how == "adjudicated") | ((how == "unverified") & F.lit(batch)), F.col("a_text"))
    alt2 = F.when(how.isin("adjudicated", "unverified"), F.col("b_text"))
    kind = F.when(how == "failed", "none").otherwise(pick("kind"))
    return both.withColumn("passes", passes).select(*keys, pick("text").alias("text"), kind.alias("kind"), confidence.alias("confidence"), "passes", alt1.alias("alt_pass1"), alt2.alias("alt_pass2"))


def align_replies(asked: DataFrame, replies: DataFrame, group: str) -> DataFrame:
    """asked (group, ord) with its reply: by id, or by place if ids are fewer than asked for and replies are as many; the last of an id wins."""
    n = asked.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    counts = replies.groupBy(group).agg(F.countDistinct("id").alias("ids"), F.count(F.lit(1)).alias("got"))
    how = n.join(counts, group, "left").select(group, ((F.col("ids") < F.col("n")) & (F.col("got") == F.col("n"))).alias("by_place"))
    keyed = replies.join(how, group).withColumn("key", F.when(F.col("by_place"), F.col("ord")).otherwise(F.col("id")))
    last = keyed.groupBy(group, F.col("key").alias("ord")).agg(F.max_by("text", "ord").alias("text"))
    return asked.join(last, [group, "ord"], "left")


def merge_reports(old: DataFrame, new: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """New rows in order, skipped and locked ones replaced by the old row if there is one; then old rows that are not in new."""
    o = old.select(key, F.col(order).alias("old_ord"), F.col(status).alias("old_status"))
    w = new.select(key, F.col(order).alias("new_ord"), F.col(status).alias("new_status"))
    both = o.join(w, key, "full_outer")
    kept = F.col("new_status").isin("skipped", "locked") & F.col("old_status").isNotNull()
    state = F.when(F.col("new_status").isNull() | kept, F.col("old_status")).otherwise(F.col("new_status"))
    return both.select(key, state.alias(status), F.when(F.col("new_status").isNull(), 1).otherwise(0).alias("part"), F.coalesce("new_ord", "old_ord").alias("ord"))


def by_prefix(rows: DataFrame, prices: DataFrame, name: str) -> DataFrame:
    """rows with usd_in and usd_out of the first price (by ord, then prefix) whose prefix begins name, else null.

    A short list becomes one expression, so that rows are neither shuffled nor joined. For a longer one the different names, which are few beside the rows,
    are taken apart into their beginnings and meet the prices by equality; what each name costs is then joined to the rows.
    """
    rules = prices.orderBy("ord", "prefix").limit(FEW_PRICES + 1).collect()
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    if len(rules) > FEW_PRICES:
        names = cut(rows.select(low.alias("of_")).distinct())
        starts = names.select("of_", F.explode(F.transform(F.sequence(F.lit(0), F.length("of_")), lambda n: F.left("of_", n))).alias("start_"))
        known = prices.select(F.col("prefix").alias("start_"), F.struct("ord", "prefix", "usd_in", "usd_out").alias("p_"))
        found = cut(starts.join(known, "start_").groupBy("of_").agg(F.min("p_").alias("p_")))
        side = sized(found.select("of_", F.col("p_.usd_in").alias("usd_in"), F.col("p_.usd_out").alias("usd_out")), F.length("of_") * 4 + 40)
        return rows.join(side, low == F.col("of_"), "left").drop("of_")

    def first(field: str):
        out = F.lit(None).cast("double")
        for r in reversed(rules):
            out = F.when(low.startswith(r["prefix"]), F.lit(r[field])).otherwise(out)
        return out

    return rows.withColumns({"usd_in": first("usd_in"), "usd_out": first("usd_out")})


def fenced_latest(edits: DataFrame) -> DataFrame:
    """edits (book, seq, fp, idx, text): an fp other than one that is stored (null too) drops what was queued, then the latest of each idx wins.

    What is left is the longest end of a book in which no fp follows another one: rows with the last fp, and, if that is not null, the nulls before them. Three
    passes of sums find where it begins, instead of a window over a book.
    """
    ends = edits.groupBy("book").agg(F.max_by(F.struct("fp"), "seq").alias("e")).select(F.col("book").alias("of"), F.col("e.fp").alias("last_fp"))
    here = lambda side: F.col("book").eqNullSafe(F.col("of"))  # noqa: ARG005, E731
    other = ~F.col("fp").eqNullSafe(F.col("last_fp"))
    one = edits.join(sized(cut(ends)), here(ends)).groupBy("of", "last_fp").agg(F.max(F.when(other, F.struct("seq", F.col("fp").isNull().alias("none")))).alias("o"))
    one = cut(one.select("of", "last_fp", F.col("o.seq").alias("past"), F.coalesce("o.none", F.lit(False)).alias("none")))
    two = edits.join(sized(one.filter("none")), here(one) & (F.col("seq") < F.col("past")) & F.col("fp").isNotNull()).groupBy(F.col("of").alias("of2")).agg(F.max("seq").alias("start"))
    fence = cut(one.join(two, F.col("of").eqNullSafe(F.col("of2")), "left").select("of", F.when(F.col("none"), F.col("start")).otherwise(F.col("past")).alias("fence")))
    rows = edits.join(sized(fence), here(fence)).filter(F.col("fence").isNull() | (F.col("seq") > F.col("fence")))
    return rows.groupBy("book", "idx").agg(F.max_by(F.struct("text", "fp", "seq"), "seq").alias("e")).select("book", "idx", "e.text", "e.fp", "e.seq")


def shifted(keys: DataFrame, idx: str, start: int, end: int, n: int) -> DataFrame:
    """Keys after [start, end) was replaced by n rows: those inside go, later ones move."""
    move = n - (end - start)
    return keys.filter((F.col(idx) < start) | (F.col(idx) >= end)).withColumn("new_idx", F.when(F.col(idx) < start, F.col(idx)).otherwise(F.col(idx) + move))


def page_range(text: str) -> tuple[int, int]:
    """'a-b', 'a-', '-b', 'n' (also with a tilde) as first and last page; blank is all."""
    s = text.strip().replace("~", "-").replace(" ", "")
    if not s:
        return 1, 10**9
    a, dash, b = s.partition("-")
    if not (a or b) or "-" in b:
        raise ValueError(f"not a page range: {text!r}")
    first = int(a) if a else 1
    last = (int(b) if b else 10**9) if dash else first
    if first < 1 or last < first:
        raise ValueError(f"not a page range: {text!r}")
    return first, last


#: Fields that a new reading brings along if it has something in them.
BROUGHT = ("alt", "fixed", "uncertain", "src")


def rework(rows: DataFrame) -> DataFrame:
    """rows with a new reading (text, kind, confidence, passes and BROUGHT) and what stands there (the same with old_, and retyped), whether hand and sfx are set:

    what holds from now on. A shown text stays if the new one would not be shown, which is kept beside it in alt with its kind and confidence; a text that was not
    shown and is asked for is set. alt is a map of texts.
    """
    special = ((F.col("kind") == "hand") & F.col("hand")) | ((F.col("kind") == "sfx") & F.col("sfx"))
    shows = ~R.blank(F.col("text")) & (F.col("confidence") == "high") & (F.col("kind").isin(R.ALWAYS_SET) | special)
    how = F.concat(F.lit("rework-"), F.coalesce(F.nullif("passes", F.lit("")), F.lit("ai")))
    rows = rows.withColumn("how_", F.when(F.col("retyped") & ~shows, "rework-kept").when(~F.col("retyped") & ~shows & ~R.blank(F.col("text")), "rework-forced").otherwise(how))
    kept, forced = F.col("how_") == "rework-kept", F.col("how_") == "rework-forced"
    kind = F.when(kept, F.col("old_kind")).when(forced & ~special & ~F.col("kind").isin("caption", "shout"), "dialogue").otherwise(F.col("kind"))
    confidence = F.when(kept, F.col("old_confidence")).when(forced, "high").otherwise(F.col("confidence"))
    holds = {"alt": F.size("alt") > 0, "fixed": F.col("fixed"), "uncertain": F.col("uncertain"), "src": F.col("src") != ""}
    refused = F.create_map(F.lit("rework_text"), "text", F.lit("kind"), "kind", F.lit("confidence"), "confidence")
    brought = {c: F.when(~kept & F.coalesce(holds[c], F.lit(False)), F.col(c)).otherwise(F.col(f"old_{c}")) for c in BROUGHT}
    brought["alt"] = F.when(kept, refused).otherwise(brought["alt"])
    return rows.withColumns({"passes": F.col("how_"), **brought, "text": F.when(kept, F.col("old_text")).otherwise(F.col("text")), "kind": kind, "confidence": confidence}).drop("how_")


def translated(rows: DataFrame) -> DataFrame:
    """rows (text, kind, confidence, passes) after a translation tr, or none at all if it failed: a missing one is held back, a failure keeps the source."""
    found = F.when(~R.blank(F.col("tr")), T.strip(F.col("tr")))
    text = F.when(F.col("failed"), F.col("text")).otherwise(found)
    held = ~F.col("failed") & found.isNull()
    confidence = F.when(F.col("failed") & (F.col("confidence") == "high"), "medium").when(held, "low").otherwise(F.col("confidence"))
    passes = F.concat(F.coalesce("passes", F.lit("ocr")), F.when(F.col("failed"), "+xlat-failed").otherwise("+xlat"))
    return rows.withColumns({"src": F.col("text"), "text": text, "kind": F.when(held, "none").otherwise(F.col("kind")), "confidence": confidence, "passes": passes})


def with_unlisted(own: DataFrame, finals: DataFrame, key: str) -> DataFrame:
    """own pages, then finals that are not among them, to be seen only."""
    rest = finals.join(own, key, "left_anti").select(key, F.lit(True).alias("locked"), F.lit(1).alias("part"))
    return own.select(key, F.lit(False).alias("locked"), F.lit(0).alias("part")).unionByName(rest)


def apply_edits(paras: DataFrame, edits: DataFrame, versions: DataFrame, order: str = "key") -> DataFrame:
    """paras (book, idx, src, text) after edits (book, key, has_src, src, has_text, text, fp, count), in order.

    Of the edits whose keys are one index ("0", "00") the last source and the last text hold. A book's edits hold if fp and count are those of versions (book, fp, count), both; keys that are no index of the book are passed over; a blank text becomes null.
    """
    now = versions.select(F.col("book").alias("now_book"), F.col("fp").alias("now_fp"), F.col("count").alias("now_count"))
    held = edits.join(now, (F.col("book") == F.col("now_book")) & F.col("fp").eqNullSafe(F.col("now_fp")) & F.col("count").eqNullSafe(F.col("now_count")))
    own = held.withColumn("idx", R.index_in(F.col("key"), F.col("now_count"))).filter("idx is not null")
    src, text = T.clean_source(F.coalesce("src", F.lit(""))), F.nullif(T.clean_text(F.coalesce("text", F.lit(""))), F.lit(""))
    last = lambda has, value: F.max_by(F.when(F.col(has), F.struct(value.alias("v"))), F.when(F.col(has), F.col(order)))["v"]
    own = own.groupBy("book", "idx").agg(F.bool_or("has_src").alias("has_src"), last("has_src", src).alias("new_src"), F.bool_or("has_text").alias("has_text"), last("has_text", text).alias("new_text"))
    both = paras.join(own, ["book", "idx"], "left")
    return both.select("book", "idx", F.when(F.col("has_src"), F.col("new_src")).otherwise(F.col("src")).alias("src"), F.when(F.col("has_text"), F.col("new_text")).otherwise(F.col("text")).alias("text"))


def line_paragraphs(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (group, x, y0, y1) with para: a gap over 1.8 of the median one and 0.55 of the median height, or an indent over 1.2 heights, begins one."""
    by = W.partitionBy(group).orderBy(*order)
    gaps = rows.withColumn("gap", F.col("y0") - F.lag("y1").over(by))
    height = F.coalesce(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))), F.lit(20.0))
    middle = F.coalesce(F.median(F.when(F.col("gap").isNotNull(), F.greatest(F.lit(0), "gap"))), F.lit(0.0))
    base = F.get(F.array_sort(F.collect_list("x")), F.floor(F.count(F.lit(1)) / 10).cast("int"))
    page = gaps.groupBy(group).agg(height.alias("height"), middle.alias("middle"), base.alias("base"))
    begins = F.col("gap").isNotNull() & ((F.col("gap") > F.greatest(F.col("middle") * 1.8, F.col("height") * 0.55)) | (F.col("x") - F.col("base") > F.col("height") * 1.2))
    marked = gaps.join(page, group).withColumn("begins", begins.cast("int"))
    return marked.withColumn("para", F.sum("begins").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("begins")


def rescan_windows(paras: DataFrame) -> DataFrame:
    """For each page of a book the window [s, e) of paragraphs to replace and the pages q to r that it covers.

    paras: book, idx, s, e (first and last page, rising with idx; null for a page that is not known, which counts as the one looked at). Spans are dealt to the
    pages they touch, so that no paragraph meets a page that it has nothing to do with.
    """
    books = paras.groupBy("book").agg(F.coalesce(F.max("e"), F.lit(0)).alias("last"), F.count(F.lit(1)).alias("n"), F.max("s").isNull().alias("none"))
    pages = books.select("book", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("page"))
    known = paras.filter("s is not null")
    touching = known.select("book", "idx", "s", "e", F.explode(F.sequence(F.col("s").cast("long"), F.col("e").cast("long"))).alias("page"))
    own = touching.groupBy("book", "page").agg(F.min("s").alias("q"), F.max("e").alias("r"), F.min("idx").alias("first"), F.max("idx").alias("final"))
    lost = paras.filter("s is null").groupBy("book").agg(F.min("idx").alias("first_lost"), F.max("idx").alias("final_lost"))
    # The least idx that begins after a page: of each page the first that begins there, looked at from the end.
    firsts = pages.join(known.groupBy("book", F.col("s").cast("long").alias("page")).agg(F.min("idx").alias("begins")), ["book", "page"], "left")
    after = W.partitionBy("book").orderBy("page").rowsBetween(1, W.unboundedFollowing)
    nexts = firsts.select("book", "page", "n", F.min("begins").over(after).alias("later"))
    rows = nexts.join(own, ["book", "page"], "left").join(lost, "book", "left")
    rows = rows.withColumns({"q": F.least("q", "page"), "r": F.greatest("r", "page"), "first": F.least("first", "first_lost"), "past": F.greatest("final", "final_lost") + 1})
    # Past the window's last paragraph the first that begins after page r; spans rise, so it is the first after r or the paragraph past the window.
    ends = nexts.select("book", F.col("page").alias("r"), F.col("later").alias("stop"))
    rows = rows.join(ends, ["book", "r"], "left")
    none = F.col("first").isNull()
    end = F.when(F.col("stop").isNull(), F.col("n")).otherwise(F.greatest("stop", "past"))
    return rows.select("book", "page", F.coalesce("q", "page").cast("long").alias("q"), F.coalesce("r", "page").cast("long").alias("r"), F.when(none, F.coalesce("later", "n")).otherwise(F.col("first")).cast("long").alias("s"), F.when(none, F.coalesce("later", "n")).otherwise(end).cast("long").alias("e"))


def limited(rows: DataFrame, book: str, order: str, pages: str, most: int, sample: int) -> DataFrame:
    """Rows of the page range with whether they are within the limit, and the sample page, held within the book."""
    first, last = page_range(pages)
    numbered = runs.with_totals(cut(runs.ordinals(rows, [book], [order], "n")), [book], total=F.count(F.lit(1)))
    within = F.col("n").between(first, min(last, first + most - 1))
    at = F.col("n") == F.least(F.lit(max(sample, 1)), F.col("total"))
    return numbered.filter(within | at).select(book, order, within.alias("within_limit"), at.alias("sample"))


def union_area(boxes: list[tuple[int, int, int, int]]) -> int:
    """The area that boxes (left, top, right, bottom; any whole numbers) cover together: a sweep over their left and right edges."""
    edges = sorted({x for box in boxes for x in (box[0], box[2])})
    by_top, total = sorted(boxes, key=lambda box: box[1]), 0
    for left, right in zip(edges, edges[1:], strict=False):
        reach, covered = None, 0
        for own_left, top, own_right, bottom in by_top:
            if own_left <= left and own_right >= right:
                if reach is None or top > reach:
                    covered, reach = covered + bottom - top, bottom
                elif bottom > reach:
                    covered, reach = covered + bottom - reach, bottom
        total += covered * (right - left)
    return total


#: Kept boxes from which those that meet another one are looked up in an array.
IN_ARRAY = 64


def _suppressed(boxes: list[tuple[int, int, int, int]], order: list[int], share: float) -> list[int]:
    """Those of order, places of boxes (left, top, right, bottom) by area, that are kept."""
    kept, union, array, n = [], [], np.empty((0, 4), dtype=np.int64), 0
    for i in order:
        l, t, r, b = boxes[i]
        near = union
        if len(union) > IN_ARRAY:
            if len(array) < len(union):
                array = np.concatenate([array, np.empty((2 * len(union) - len(array), 4), dtype=np.int64)])
            if n < len(union):
                array[n : len(union)], n = union[n:], len(union)
            have = array[:n]
            near = [union[k] for k in np.flatnonzero((have[:, 0] < r) & (have[:, 2] > l) & (have[:, 1] < b) & (have[:, 3] > t))]
        met = [(max(x, l), max(y, t), min(u, r), min(v, b)) for x, y, u, v in near if x < r and u > l and y < b and v > t]
        area = (r - l) * (b - t)
        if not met or union_area(met) <= share * area:
            kept.append(i)
            if area:
                union.append(boxes[i])
    return kept


def overlap_suppressed(boxes: DataFrame, group: str, share: float = 0.25) -> DataFrame:
    """boxes (group, id, x, y, w, h) with kept: by area, a box goes if more than share of its own area lies in the union of the kept ones.

    The union depends on what was kept before, so that a group, the boxes of one page, is one task's; a task takes the groups of its sorted partition one after
    another and holds the rows of an open one. Only kept boxes that meet the one at hand are looked at, cut to it: work and memory follow the boxes, not the
    page's size, and boxes may lie anywhere. A box without area stays, and covers nothing.
    """

    def decided(parts: list[pa.RecordBatch], starts: list[int]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        ids, x, y, w, h = (table.column(c).to_pylist() for c in ("id", "x", "y", "w", "h"))
        all_ = [(a, b, a + max(c, 0), b + max(d, 0)) for a, b, c, d in zip(x, y, w, h, strict=True)]
        kept = [False] * len(all_)
        for s, e in zip(starts, [*starts[1:], len(all_)], strict=True):
            order = sorted(range(s, e), key=lambda i: (-max(w[i], 0) * max(h[i], 0), ids[i])) if e - s > 1 else [s]
            for i in _suppressed(all_, order, share):
                kept[i] = True
        yield from table.append_column("kept", pa.array(kept)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None
        for batch in batches:
            keys = batch.column(group).to_pylist()
            begins = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else key) or not (i or held)]
            if begins:
                if held or begins[-1]:
                    yield from decided([*held, batch.slice(0, begins[-1])], [0, *(n + i for i in begins[:-1] if n + i)])
                held, n = [batch.slice(begins[-1])], batch.num_rows - begins[-1]
                key = keys[-1]
            elif keys:
                held, n = [*held, batch], n + batch.num_rows
        if held:
            yield from decided(held, [0])

    rows = boxes.repartition(group).sortWithinPartitions(group)
    return rows.mapInArrow(run, T_.StructType([*boxes.schema.fields, T_.StructField("kept", T_.BooleanType())]))


def usage_labels(usage: DataFrame, part: str, model: str, cost: str) -> DataFrame:
    """Rows part, labels (model:label, sorted), total, total_label: an unknown price is unregistered, none is free, else dollars; the total leaves unknown ones out and says so."""
    dollars = lambda c: F.format_string("$%.4f", c)
    label = F.when(F.col(cost).isNull(), "unregistered").when(F.col(cost) == 0, "free").otherwise(dollars(F.col(cost)))
    known = F.coalesce(F.sum(cost), F.lit(0.0))
    out = usage.groupBy(part).agg(F.array_sort(F.collect_list(F.concat(F.col(model), F.lit(":"), label))).alias("labels"), known.alias("total"), F.bool_or(F.col(cost).isNull()).alias("unknown"))
    return out.withColumn("total_label", F.concat(dollars(F.col("total")), F.when(F.col("unknown"), " + unregistered").otherwise("")))


#: A language sample: characters after which no page is added, pages of a text layer, characters below which pages are read, how many, and when that ends.
SAMPLE_CHARS, LAYER_PAGES, SCARCE, READ_PAGES, READ_CHARS = 600, 5, 200, 4, 300


def language_samples(pages: DataFrame, book: str, order: str) -> DataFrame:
    """Rows book, sample, of pages (book, order, layer: whether the book has a text layer, text: the layer's or a stored text, reading: what reading the page gives).

    Pages are added until SAMPLE_CHARS, of a layer LAYER_PAGES at most, of stored texts those that there are. If these hold less than SCARCE characters, the first
    READ_PAGES are read too, until the whole has READ_CHARS; a page that cannot be read (null) is passed over. Sums run over sorted partitions: no book is gathered.
    """
    rows = pages.select(F.col(book).alias("b"), F.col(order).alias("o"), "layer", "text", "reading")
    rows = cut(runs.scanned(rows, ["b"], ["o"], {"n": F.lit(1), "upto": F.coalesce(F.length("text"), F.lit(0))}))
    taken = F.col("text").isNotNull() & (F.col("upto") - F.length("text") < SAMPLE_CHARS) & (~F.col("layer") | (F.col("n") <= LAYER_PAGES))
    listed = lambda when, c: F.array_sort(F.collect_list(F.when(when, F.struct("n", F.col(c).alias("t")))))
    own = rows.filter(taken | (F.col("n") <= READ_PAGES)).groupBy("b").agg(F.bool_or("layer").alias("layer"), listed(taken, "text").alias("texts"), listed(F.col("n") <= READ_PAGES, "reading").alias("readings"))
    first = F.array_join(F.transform("texts", lambda r: r["t"]), "")
    add = lambda a, r: F.when(a["ended"] | r["t"].isNull(), a).otherwise(F.struct(F.concat(a["s"], F.lit("\n"), r["t"]).alias("s"), (F.length(T.strip(F.concat(a["s"], F.lit("\n"), r["t"]))) >= READ_CHARS).alias("ended")))
    read = F.aggregate("readings", F.struct(F.col("first").alias("s"), F.lit(False).alias("ended")), add)["s"]
    own = own.withColumn("first", first)
    return own.select(F.col("b").alias(book), F.when(~F.col("layer") & (F.length("first") < SCARCE), read).otherwise(F.col("first")).alias("sample"))


#: Unpinned entries that a list of recent books keeps.
RECENT_MOST = 15


def recents(used: DataFrame, owner: str, most: int = RECENT_MOST) -> DataFrame:
    """Rows owner, src, title, pin, ts, place of uses (owner, src, title, pin, ts, kind: use or pin), in order of ts.

    A book is one entry, by its source without blanks around it; its last use gives title and time, its last pin (or none) whether it is pinned. Pinned ones come first
    and all stay; of the others the newest ones do, so that a list never needs more than its top.
    """
    key = T.strip(F.coalesce("src", F.lit("")))
    at = F.struct("ts", "title")
    one = used.withColumn("src", key).filter("src <> ''").groupBy(owner, "src").agg(
        F.max(F.when(F.col("kind") == "use", at)).alias("last"), F.coalesce(F.max_by(F.when(F.col("kind") == "pin", F.col("pin")), F.when(F.col("kind") == "pin", F.col("ts"))), F.lit(False)).alias("pin"))
    one = one.filter("last is not null").select(owner, "src", F.col("last.title").alias("title"), "pin", F.col("last.ts").alias("ts"))
    newest = W.partitionBy(owner, "pin").orderBy(F.desc("ts"), "src")
    ranked = one.withColumn("n", F.row_number().over(newest)).filter(F.col("pin") | (F.col("n") <= most))
    pins = F.count_if("pin").over(W.partitionBy(owner))
    return ranked.withColumn("place", F.when(F.col("pin"), F.col("n")).otherwise(F.col("n") + pins).cast("int")).drop("n")


#: Tags of actions that set font, and those that rebuild their page.
_WITH_FONT, _WHOLE_PAGE = ["text", "src", "font", "style", "layout", "ai"], ["lock", "unlock", "page_crop", "set_default", "revert"]


def apply_actions(entries: DataFrame, pages: DataFrame, actions: DataFrame) -> DataFrame:
    """What entries (page, id, text, src, kind, confidence, passes, font, region, clean, hand, sfx) of pages (page, locked) are after actions
    (page, ord, action, id, text, src, has_font, font, w, h, clean), with the page's lock and crop.

    Locks and crops hold first, whatever their place among the actions. Then, on pages that are not locked, the last of each kind of change to an entry counts, in order of ord; ids
    that are not there are passed over; added boxes of 8 pixels get the next ids. A revert comes last and gives back the entries from before, another one
    takes that back. What a model reads again is not told here (rework).
    """
    a, ord_ = F.col("action"), F.col("ord")
    last = lambda when, value: F.max_by(F.when(when, value), F.when(when, ord_))
    page = actions.groupBy("page").agg(
        last(a.isin("lock", "unlock"), a).alias("lock"),
        last(a == "page_crop", F.when((F.col("w") >= 16) & (F.col("h") >= 16), F.concat_ws("x", "w", "h")).otherwise("")).alias("crop"),
        F.bool_or(~a.isin(_WHOLE_PAGE)).alias("touched"),
        (F.count_if(a == "revert") % 2 == 1).alias("reverted"),
    )
    state = pages.join(page, "page", "left").select("page", F.when(F.col("lock").isNotNull(), F.col("lock") == "lock").otherwise(F.col("locked")).alias("locked"), F.nullif("crop", F.lit("")).alias("crop"), F.coalesce(F.col("touched") & F.col("reverted"), F.lit(False)).alias("back"))
    text, src = T.clean_spaces(F.coalesce("text", F.lit(""))), T.clean_spaces(F.coalesce("src", F.lit("")))
    has_src = a.isin("text", "src") & ~R.blank(F.col("src"))
    at = lambda when, pick: pick(F.when(when, ord_))
    how = F.when(a == "text", "manual").when((a == "src") & has_src, "src-edit").when(a == "keep", "keep").when(a.isin("font", "style", "layout"), "style")
    item = actions.groupBy("page", "id").agg(
        at(a == "text", F.max).alias("text_at"), at(a == "keep", F.min).alias("keep_first"), at(a == "keep", F.max).alias("keep_at"),
        last(a == "text", F.when(R.blank(F.col("text")), "").otherwise(text)).alias("new_text"),
        last(has_src, src).alias("new_src"), last(how.isNotNull(), how).alias("new_passes"),
        last(a.isin(_WITH_FONT) & F.col("has_font"), F.coalesce("font", F.lit(""))).alias("new_font"),
        last(a == "region", F.when((F.col("w") >= 8) & (F.col("h") >= 8), F.concat_ws("x", "w", "h")).otherwise("")).alias("new_region"),
        last(a == "clean", F.col("clean")).alias("new_clean"),
    )
    rows = entries.join(state, "page").join(item, ["page", "id"], "left")
    open_ = ~F.col("locked") & ~F.col("back")
    fixed = F.when(F.col("keep_first") < F.col("text_at"), "dialogue").otherwise(R.fixed_kind(F.col("kind"), F.col("hand"), F.col("sfx")))
    kind = F.when(F.col("keep_at") > F.coalesce("text_at", F.lit(-1)), "preserved").when(F.col("text_at").isNotNull(), fixed).otherwise(F.col("kind"))
    now = lambda c, new: F.when(open_, new).otherwise(F.col(c)).alias(c)
    patched = lambda c: now(c, R.patched(F.col(c), F.col("new_" + c).isNotNull(), F.col("new_" + c)))
    kept = rows.select(
        "page", "id", patched("text"), now("src", F.coalesce("new_src", "src")), now("kind", kind), now("confidence", F.when(F.col("text_at").isNotNull(), "high").otherwise(F.col("confidence"))),
        now("passes", F.coalesce("new_passes", "passes")), patched("font"), patched("region"), now("clean", F.coalesce("new_clean", "clean")), "locked", "crop")
    top = entries.groupBy("page").agg(F.max("id").alias("top"))
    adds = actions.filter((a == "add") & (F.col("w") >= 8) & (F.col("h") >= 8)).join(state.filter(open_), "page").join(top, "page", "left")
    number = F.coalesce("top", F.lit(0)) + F.row_number().over(W.partitionBy("page").orderBy("ord"))
    none = F.lit(None).cast("string")
    added = adds.select(
        "page", number.alias("id"), F.when(~R.blank(F.col("text")), F.col("text")).alias("text"), none.alias("src"), F.lit("dialogue").alias("kind"), F.lit("high").alias("confidence"), F.when(R.blank(F.col("text")), "add-ai").otherwise("manual-add").alias("passes"),
        F.when(F.col("has_font"), F.nullif("font", F.lit(""))).alias("font"), none.alias("region"), F.lit(False).alias("clean"), "locked", "crop")
    return kept.unionByName(added)
