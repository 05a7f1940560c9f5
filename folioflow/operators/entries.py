"""Entries of a report on their way out and back, recognised words as text, groups by first appearance, replies by identifier or place.

Nulls: a null group is a group of its own; null or blank words are no words; rows that repeat count as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import runs

C = F.col


def numbered(boxes: DataFrame, page: str, order: list[str], retyped: str) -> DataFrame:
    """A page's boxes as report rows: id from 1 on in order, with the page's bubbles and how many of them are set. No row or task holds a page."""
    totals = {"bubbles": F.count(F.lit(1)), "set": F.count_if(F.coalesce(C(retyped), F.lit(False)))}
    return runs.with_totals(runs.ordinals(boxes, [page], order, "id"), [page], **totals)


def kept_entry(e: dict[str, Column]) -> Column:
    """The struct of a report's entry that goes back into work: kind and confidence have defaults where they are missing, the other fields stay only if they hold something.

    e: id, text, kind, confidence, src, manual_bbox, font, font_index, layout, region_bbox, clean. A font's index is 0 if it is missing and goes with the font.
    """
    some = lambda name: F.nullif(e[name], F.lit(""))
    box = lambda name: F.when(F.size(e[name]) > 0, e[name])
    font = some("font")
    return F.struct(
        e["id"].alias("id"), e["text"].alias("text"), F.coalesce(e["kind"], F.lit("none")).alias("kind"), F.coalesce(e["confidence"], F.lit("low")).alias("confidence"),
        some("src").alias("src"), box("manual_bbox").alias("manual_bbox"), font.alias("font"), F.when(font.isNotNull(), F.coalesce(e["font_index"], F.lit(0))).alias("font_index"),
        some("layout").alias("layout"), box("region_bbox").alias("region_bbox"), F.when(e["clean"], True).alias("clean"),
    )


def words_to_text(words: DataFrame, page: str, order: list[str], least: float = 25) -> DataFrame:
    """Recognised words (block, par, line, w, conf) as one text a page, which is as long as the page is.

    Words keep their order in a line, lines and paragraphs go by their numbers; words under the least confidence are noise, those whose confidence is no number stay.
    """
    joined = lambda by, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, C(value).alias("v")))), lambda x: x["v"]), sep)
    kept = words.withColumn("w", F.trim("w")).filter((C("w") != "") & F.coalesce(C("conf").try_cast("double") >= least, F.lit(True)))
    lines = kept.groupBy(page, "block", "par", "line").agg(joined(order, "w", " ").alias("t"))
    paragraphs = lines.groupBy(page, "block", "par").agg(joined(["line"], "t", "\n").alias("t"))
    return paragraphs.groupBy(page).agg(joined(["block", "par"], "t", "\n\n").alias("text"), F.count(F.lit(1)).alias("paragraphs"))


def by_appearance(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Each group with its first place in the order, its rows, and its number in the order of first appearance, from 1 on."""
    firsts = rows.groupBy(group).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("all_", F.lit(0))
    return runs.ordinals(firsts, ["all_"], ["first", group], "place").drop("all_")


def views(pages: DataFrame, todo: str) -> DataFrame:
    """pages once for each view that shows them: all, and todo or done; what is not known to need work is done."""
    return pages.withColumn("view", F.explode(F.array(F.lit("all"), F.when(C(todo), "todo").otherwise("done"))))


def by_id_or_place(asked: DataFrame, items: DataFrame, request: str) -> DataFrame:
    """What was asked (request, i from 1 on) with the value of its reply item (request, n from 1 on, id as text, value), null if there is none.

    An item stands for its id, or for its own place if that is missing or no whole number; of several for one id the last holds.
    """
    number = F.when(F.trim("id").rlike(r"^[+-]?[0-9]+$"), F.trim("id").try_cast("long"))
    last = items.withColumn("i", F.coalesce(number, C("n").cast("long"))).groupBy(request, "i").agg(F.max_by(F.struct("value"), "n")["value"].alias("value"))
    return asked.join(last, [request, "i"], "left")
