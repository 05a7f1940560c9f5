"""Decisions on transcripts, pages and requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

HANGUL = "[가-힣]"
#: What in a message tells that every further request would fail as well.
FATAL = ["credit balance", "api key", "api 키", "unauthorized", "401", "403", "비전 미지원", "404", "not found", "does not exist", "is not supported", "지원되지"]
#: Kinds that are always set again, and those that a reader must look at.
ALWAYS_SET, LOOKED_AT = ["dialogue", "caption", "shout"], ["dialogue", "caption", "shout", "hand"]
#: Engines that read images on the machine itself.
LOCAL_READERS = ["tesseract", "easyocr", "windows"]


def is_local_reader(engine: Column) -> Column:
    return F.lower(engine).isin(LOCAL_READERS)


def is_local_model(engine: Column) -> Column:
    return F.lower(engine).startswith("ollama:")


def needs_key(engine: Column) -> Column:
    return (engine != "") & ~is_local_reader(engine) & ~is_local_model(engine)


def blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) == ""


def is_untranslated(src: Column, tr: Column, lang: Column) -> Column:
    """Blank, or without Hangul and equal to the source, or Japanese with its script left."""
    own, other = (T.strip(F.coalesce(c, F.lit(""))) for c in (tr, src))
    return F.when(own == "", True).when(own.rlike(HANGUL), False).otherwise((own == other) | ((lang == "ja") & own.rlike(T.CJK)))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 85, "high").when(c >= 60, "medium").otherwise("low")


def is_text(c: Column, lang: Column) -> Column:
    """Hangul for Korean, any letter for others."""
    return ~blank(c) & F.when(lang == "ko", c.rlike(HANGUL)).otherwise(c.rlike(r"\p{L}"))


def ocr_gate(words: Column, hangul: Column, ratio: Column, conf: Column) -> Column:
    """What becomes of a candidate: foreign print is rejected, Hangul accepted, the rest cleared alone."""
    return F.when((conf >= 70) & (hangul == 0) & (words >= 2), "REJECT").when((hangul >= 2) & (ratio >= 0.40) & (conf >= 35), "ACCEPT").otherwise("CLEAR-ONLY")


def can_set(kind: Column, hand: Column, sfx: Column) -> Column:
    """Kinds that are set again; hand and sfx say whether their setting and font are there."""
    return kind.isin(ALWAYS_SET) | ((kind == "sfx") & sfx) | ((kind == "hand") & hand)


def is_retypable(text: Column, kind: Column, confidence: Column, strict: Column, hand: Column, sfx: Column) -> Column:
    return F.coalesce((F.coalesce(text, F.lit("")) != "") & ((confidence == "high") | ~strict) & can_set(kind, hand, sfx), F.lit(False))


def fixed_kind(kind: Column, hand: Column, sfx: Column) -> Column:
    """The kind that makes sure that a corrected text is set."""
    return F.when(kind.isin("caption", "shout") | ((kind == "hand") & hand) | ((kind == "sfx") & sfx), kind).otherwise("dialogue")


def is_fatal(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, FATAL)), lambda k: F.contains(low, k))


def index_in(key: Column, n: Column) -> Column:
    """key as an index below n, else null."""
    i = key.try_cast("long")
    return F.when((i >= 0) & (i < n), i)


def position_in(key: Column, n: Column) -> Column:
    p = key.try_cast("double")
    return F.when((p >= 0) & (p < n), F.round(p, 3))


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box within the page, one pixel at least: left, top, right, bottom."""
    left, top = (F.greatest(F.lit(0), F.least(a, n - 1)) for a, n in ((x, width), (y, height)))
    right, bottom = (F.greatest(a + 1, F.least(a + b, n)) for a, b, n in ((left, w, width), (top, h, height)))
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def fitted(size: Column, longest: Column, edge: int) -> Column:
    """size scaled down so that the longest side is edge; never up."""
    scale = F.lit(float(edge)) / longest
    return F.when(scale < 1, F.greatest(F.lit(1.0), F.bround(size * scale))).otherwise(size.cast("double")).cast("long")


def corner_background(corners: Column) -> Column:
    """The mean of the two middle ones of four values."""
    own = F.array_sort(corners)
    return F.floor((F.get(own, F.lit(1)) + F.get(own, F.lit(2))) / 2).cast("long")


def progress_percent(pos: Column, count: Column) -> Column:
    return F.when(count > 0, F.least(F.lit(100), F.floor((F.floor(pos) + 1) / count * 100 + 0.5))).cast("int")


def book_name(file: Column) -> Column:
    """The book that a file belongs to; null for system files and others."""
    name = F.when(file.endswith(".html"), F.regexp_replace(file, r"\.html$", "")).when(file.endswith(".data.json"), F.regexp_replace(file, r"\.data\.json$", ""))
    return F.when(~file.startswith("_") & (name != ""), name)


def label_index(label: Column) -> Column:
    """The inverse of a page's label."""
    return F.substring(label, 2, 20).try_cast("int") - 1


def title_or_stem(title: Column, path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.nullif(T.strip(title), F.lit("")), stem)


def allowed_temperature(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"(?i)only\s*([0-9]*\.?[0-9]+)\s*is allowed", 1), F.lit("")).cast("double")


def progress_of(line: Column) -> Column:
    """i and n of a line with [i/n] or (stage) i/n."""
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(line, p, k), F.lit("")) for p in (r"\[(\d+)/(\d+)\]", r"\([^)]*\) (\d+)/(\d+)")]).cast("int")
    return F.struct(part(1).alias("i"), part(2).alias("n"))


def safe_name(c: Column) -> Column:
    """Characters that paths cannot hold become underscores."""
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def word_slug(c: Column) -> Column:
    """Runs of what is no word character in any script become hyphens."""
    return F.btrim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "-")), F.lit("-"))


def model_or(c: Column, default: str, retired: list[str]) -> Column:
    own = T.strip(F.coalesce(c, F.lit("")))
    return F.when((own == "") | own.isin(retired), F.lit(default)).otherwise(own)


def box_colour(retyped: Column, overlap: Column, text: Column) -> Column:
    """The debug frame: to be checked, set, read, or empty."""
    return F.when(retyped & (overlap > 0.03), "magenta").when(retyped, "green").when(F.coalesce(text, F.lit("")) != "", "orange").otherwise("red")


def overlaid(default: Column, item: Column) -> Column:
    """Maps: what item says, else the default."""
    return F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(item, k)), item)


def patched(old: Column, has: Column, new: Column) -> Column:
    """Absent keeps, empty removes, a value sets."""
    return F.when(has, F.nullif(new, F.lit(""))).otherwise(old)


def map_text(m: Column) -> Column:
    """A map as sorted text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
