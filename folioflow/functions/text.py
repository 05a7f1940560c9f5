"""Text rules of page transcripts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words counted by language, letters, marks and white space, as results depend on them.
DE_WORDS = "der die das und nicht ist ein eine zu mit den von sich auf auch als aber wir nur wie noch nach bei aus wenn dann war ihm ihr sein hatte".split()
EN_WORDS = "the and of to in is that it was for with as his her on at by not this but from they have had were been would there what when".split()
KANA = "[ぁ-んァ-ヶー]"
UMLAUTS = "[äöüß]"
CJK = "[　-ヿ㐀-鿿豈-﫿！-｠]"
SENTENCE_END = ".!?\"»«“”’:;。」』？！…"
PAGE_NUMBER = r"^[\s\-–—·.]*[0-9０-９]{1,4}[\s\-–—·.]*$"
CHAPTER = r"(?i)^(kapitel|chapter|teil|part|prolog|prologue|epilog|epilogue|buch|book)\b[\s\d.:IVXLC-]*$"
CHAPTER_JA = "^(第[〇一二三四五六七八九十百千万0-9０-９]+[章話部巻節]|序章|終章|序|プロローグ|エピローグ|まえがき|あとがき|目次)"
TO_SPACE = "               "
TO_NOTHING = "​‌‍‎‏⁠⁡⁢⁣﻿­"
#: White space that ends are stripped of.
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85                 　"
HEADING_MARK = "## "
HEADING_MOST, CAPITALS_MOST = 60, 30


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is computed once a row: named twice, or within a lambda, it would be computed as often, or anew for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def clean_spaces(c: Column) -> Column:
    """Uncommon spaces become spaces, characters without width go; the ideographic space stays."""
    return F.translate(c, TO_SPACE + TO_NOTHING, " " * len(TO_SPACE))


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(strip(c), "\n", -1), strip), "\n")


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def ends_sentence(c: Column) -> Column:
    return (F.length(c) > 0) & F.lit(SENTENCE_END).contains(F.right(c, F.lit(1)))


def is_heading(c: Column) -> Column:
    s = strip(c)
    plain = (s != "") & (F.length(s) <= HEADING_MOST) & ~ends_sentence(s)
    capitals = (F.length(s) <= CAPITALS_MOST) & (s == F.upper(s)) & (s != F.lower(s))
    return s.startswith(HEADING_MARK) | (plain & (s.rlike(CHAPTER) | s.rlike(CHAPTER_JA) | capitals))


def without_mark(c: Column) -> Column:
    s = strip(c)
    return F.when(s.startswith(HEADING_MARK), F.ltrim(F.substring(s, 4, 1 << 30))).otherwise(s)


def strip_inline(c: Column) -> Column:
    """Marks of strong, struck, underlined and slanted text go, and the marks of lines set right."""
    out = F.regexp_replace(c, r"(?m)^[ \t\u3000]*(?:>>|＞＞)\s+", "")
    for mark in (r"\*\*", "~~", r"\+\+", r"\*"):
        out = F.regexp_replace(out, f"(?s){mark}(.+?){mark}", "$1")
    return out


def inline_tags(c: Column) -> Column:
    out = escape(c)
    for mark, tag in ((r"\*\*", "strong"), ("~~", "s"), (r"\+\+", "u"), (r"\*", "em")):
        out = F.regexp_replace(out, f"(?s){mark}(.+?){mark}", f"<{tag}>$1</{tag}>")
    return out


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline_html(c: Column) -> Column:
    """A paragraph as it is exported: escaped, marks as tags, runs of spaces kept, lines broken; a line marked so is set right, a blank one is a gap."""
    spaced = F.regexp_replace(inline_tags(F.coalesce(c, F.lit(""))), " (?= )", "&#160;")
    right = r"^[ \t\u3000]*(?:&gt;&gt;|＞＞)[\s\u3000]+"
    lines = F.transform(F.split(spaced, "\n", -1), lambda x: F.when(x.rlike(right), F.struct(F.lit("r").alias("k"), x.alias("x"))).when(strip(x) == "", F.struct(F.lit("b").alias("k"), x.alias("x"))).otherwise(F.struct(F.lit("t").alias("k"), x.alias("x"))))
    style = F.lit('<span style="display:block;text-align:right;text-indent:0">')
    shown = lambda x: F.when(x["k"] == "r", F.concat(style, F.ltrim(F.regexp_replace(x["x"], right, "")), F.lit("</span>"))).when(x["k"] == "b", "<br/><br/>").otherwise(x["x"])
    # A break stands between two lines of text that follow one another.
    before = lambda all_, i: F.when((i > 0) & (F.get(all_, i)["k"] == "t") & (F.get(all_, i - 1)["k"] == "t"), "<br/>").otherwise("")
    return bound(lines, lambda all_: F.array_join(F.transform(all_, lambda x, i: F.concat(before(all_, i), shown(x))), ""))


def clean_source(c: Column) -> Column:
    """Blank lines between lines go."""
    return clean_spaces(strip(F.regexp_replace(c, r"[ \t]*\n[ \t]*\n+", "\n")))


def clean_text(c: Column) -> Column:
    """Spaces at line ends go, and of blank lines all but one."""
    return clean_spaces(strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")))


def without_commas_at_ends(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([\]}])", "$1")


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<think>.*?(</think>|$)", "")


def widest_list(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def page_label(n: Column) -> Column:
    return F.format_string("p%04d", n + 1)


def size_label(n: Column) -> Column:
    big = float(1 << 30)
    return F.when(n >= big, F.format_string("%,.2f GB", n / big)).otherwise(F.format_string("%,.1f MB", n / float(1 << 20)))


def language_scores(c: Column) -> tuple[Column, Column, Column]:
    """Scores of ja, de and en."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.slice(F.regexp_extract_all(low, F.lit("[a-zäöüß]+"), F.lit(0)), 1, 1000)
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    de = count(DE_WORDS) + 3 * F.least(F.lit(30), F.regexp_count(low, F.lit(UMLAUTS)))
    return F.regexp_count(low, F.lit(KANA)), de, count(EN_WORDS)


def language(ja: Column, de: Column, en: Column) -> Column:
    return F.when((ja >= 5) & (ja >= F.floor(F.greatest(de, en) / 3)), "ja").when(de >= en, "de").otherwise("en")


def hangul_ratio(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n > 0, F.regexp_count(c, F.lit("[가-힣]")) / n).otherwise(F.lit(0.0))
