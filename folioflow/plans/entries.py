"""Registered queries of report entries, recognised words, first appearance and replies, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import rules as R
from folioflow.operators import entries as E
from folioflow.plans.catalogue import query, read
from folioflow.plans.rules import _CAN, _ENTRY, _WORDS, _entries, _words

C = F.col
_BY = ["id_", "p", "s", "q", "tax", "text", "confidence"]
_RETYPED = f"text <> '' AND (confidence = 'high' OR NOT strict) AND {_CAN}"


def _report(spark, sf_dir):
    retyped = R.is_retypable(C("text"), C("kind"), C("confidence"), C("strict"), C("hand"), C("sfx"))
    return E.numbered(_entries(spark, sf_dir).withColumn("retyped", retyped).withColumnRenamed("id", "id_"), "page", _BY, "retyped")


_REPORT = f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY id, p, s, q, tax, text, confidence) AS id, p, s, text, kind, confidence, {_RETYPED} AS retyped,
 count(*) OVER (PARTITION BY page) AS bubbles, count(*) FILTER (WHERE {_RETYPED}) OVER (PARTITION BY page) AS set FROM ({_ENTRY})"""


@query(f"SELECT page, id, text, kind, confidence, retyped, bubbles, set FROM ({_REPORT})")
def report_rows(spark, sf_dir):
    return _report(spark, sf_dir).select("page", "id", "text", "kind", "confidence", "retyped", "bubbles", "set")


@query(f"""SELECT page, id, text, CASE WHEN p % 9 = 0 THEN 'none' ELSE kind END AS kind, CASE WHEN p % 8 = 0 THEN 'low' ELSE confidence END AS confidence, CASE WHEN s % 2 = 0 THEN 'S' || s END AS src, CASE WHEN p % 4 = 0 THEN p || ',' || s END AS manual_bbox,
 CASE WHEN s % 3 = 0 THEN 'F' END AS font, CAST(CASE WHEN s % 3 = 0 THEN CASE WHEN p % 2 = 0 THEN p % 5 ELSE 0 END END AS INT) AS font_index, CASE WHEN p % 5 = 0 THEN 'wide' END AS layout, CASE WHEN s % 4 = 1 THEN s || ',' || p END AS region_bbox, CASE WHEN s % 7 = 0 THEN true END AS clean FROM ({_REPORT})""")
def kept_entries(spark, sf_dir):
    """Report rows as the entries that go back; missing and empty fields by turns, of which the SQL states what stays."""
    p, s = C("p"), C("s")
    pair = lambda when, a, b: F.when(when, F.array(a, b)).otherwise(F.array().cast("array<bigint>"))
    fields = {
        "id": C("id"), "text": C("text"), "kind": F.when(p % 9 != 0, C("kind")), "confidence": F.when(p % 8 != 0, C("confidence")),
        "src": F.when(s % 2 == 0, F.concat(F.lit("S"), s.cast("string"))).otherwise(""), "manual_bbox": F.when(p % 12 != 1, pair(p % 4 == 0, p, s)),
        "font": F.when(s % 3 == 0, "F").otherwise(""), "font_index": F.when(p % 2 == 0, p % 5).cast("int"), "layout": F.when(p % 5 == 0, "wide").when(p % 5 == 1, ""),
        "region_bbox": pair(s % 4 == 1, s, p), "clean": F.when(s % 7 == 0, True).when(s % 7 == 1, False),
    }
    entry = _report(spark, sf_dir).select("page", E.kept_entry(fields).alias("e")).select("page", "e.*")
    shown = {c: F.when(C(c).isNotNull(), F.array_join(C(c).cast("array<string>"), ",")) for c in ("manual_bbox", "region_bbox")}
    return entry.withColumns(shown)


@query(f"""WITH w AS (SELECT conv_id, turn % 3 AS block, turn // 3 % 2 AS par, turn // 6 AS line, turn, pos, trim(w) AS w FROM ({_WORDS}) WHERE trim(w) <> '' AND coalesce(TRY_CAST(conf AS DOUBLE) >= 25, true)),
l AS (SELECT conv_id, block, par, line, string_agg(w, ' ' ORDER BY turn, pos) AS t FROM w GROUP BY ALL), p AS (SELECT conv_id, block, par, string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY ALL)
SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY block, par)) AS text, CAST(count(*) AS BIGINT) AS paragraphs FROM p GROUP BY conv_id""")
def words_to_text(spark, sf_dir):
    words = _words(spark, sf_dir).withColumns({"block": C("turn") % 3, "par": F.expr("turn div 3 % 2"), "line": F.expr("turn div 6")})
    return E.words_to_text(words, "conv_id", ["turn", "pos"]).withColumn("text", F.md5("text"))


@query("""SELECT grp, min(event_id) AS first, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY min(event_id), grp) AS BIGINT) AS place FROM (SELECT event_id, user_id AS grp FROM events) GROUP BY grp""")
def first_appearance(spark, sf_dir):
    """Actions by page, pages in the order in which they come up first."""
    return E.by_appearance(read(spark, sf_dir, "events").select("event_id", C("user_id").alias("grp")), "grp", "event_id").withColumn("place", C("place").cast("long"))


@query(f"""WITH t AS (SELECT page, bool_or(kind IN ('dialogue', 'caption', 'shout', 'hand') AND NOT (text <> '' AND tax > 0.03)) AS todo FROM ({_ENTRY}) GROUP BY page)
SELECT page, 'all' AS view FROM t UNION ALL SELECT page, CASE WHEN todo THEN 'todo' ELSE 'done' END FROM t""")
def page_views(spark, sf_dir):
    open_ = C("kind").isin(R.LOOKED_AT) & ~((C("text") != "") & (C("tax") > 0.03))
    return E.views(_entries(spark, sf_dir).groupBy("page").agg(F.bool_or(open_).alias("todo")), "todo").select("page", "view")


_ITEM_ID = "CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' || turn WHEN 2 THEN ' ' || turn || ' ' ELSE CAST(turn + 2 AS VARCHAR) END"


@query(f"""WITH r AS (SELECT conv_id, turn + 1 AS n, coalesce(CASE WHEN regexp_matches(trim({_ITEM_ID}), '^[+-]?[0-9]+$') THEN CAST(trim({_ITEM_ID}) AS BIGINT) END, turn + 1) AS i, md5(text) AS value FROM conversations),
l AS (SELECT conv_id, i, arg_max(value, n) AS value FROM r GROUP BY conv_id, i)
SELECT a.conv_id, a.i, l.value FROM (SELECT conv_id, CAST(turn + 1 AS BIGINT) AS i FROM conversations) a LEFT JOIN l ON a.conv_id = l.conv_id AND a.i = l.i""")
def reply_items(spark, sf_dir):
    """Items of a reply with identifiers, some missing, some no numbers, some twice."""
    rows, t = read(spark, sf_dir, "conversations"), C("turn").cast("string")
    item = F.when(C("turn") % 5 == 0, None).when(C("turn") % 5 == 1, F.concat(F.lit("x"), t)).when(C("turn") % 5 == 2, F.concat(F.lit(" "), t, F.lit(" "))).otherwise((C("turn") + 2).cast("string"))
    items = rows.select("conv_id", (C("turn") + 1).alias("n"), item.alias("id"), F.md5("text").alias("value"))
    return E.by_id_or_place(rows.select("conv_id", (C("turn") + 1).cast("long").alias("i")), items, "conv_id")
