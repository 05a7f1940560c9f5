"""Registered queries of decision rules, review state and geometry, each beside the SQL that gives the same rows.

Columns that the driver's tables lack (confidences, kinds, marks) are stated functions of their keys, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import replies as Y
from folioflow.functions import rules as R
from folioflow.functions import text as T
from folioflow.operators import ordered as O
from folioflow.operators import review as V
from folioflow.operators.kept import spread
from folioflow.plans.catalogue import dealt, docs, lines, query, read
from folioflow.sinks import archives as A
from folioflow.sinks import books as K

C = F.col
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


def pick(values: list[str], i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def pick_sql(values: list[str], i: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({i}) % {len(values)} AS INT) + 1]"


# --- recognised words -------------------------------------------------------------------------------------------

_H = "(conv_id * 31 + turn * 17 + pos * 7) % 101"
_WORDS = f"""SELECT conv_id, turn, pos, CASE WHEN {_H} % 4 = 0 THEN '한글' WHEN {_H} % 9 = 0 THEN '' ELSE w END AS w, CASE WHEN {_H} % 13 = 0 THEN '-' WHEN {_H} % 11 = 0 THEN '-1' ELSE CAST({_H} AS VARCHAR) END AS conf
 FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations)"""


def _words(spark, sf_dir):
    """Words of a box (conv_id, turn) with a confidence that may not be a number."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("pos", "w"))
    h = (C("conv_id") * 31 + C("turn") * 17 + C("pos") * 7) % 101
    word = F.when(h % 4 == 0, "한글").when(h % 9 == 0, "").otherwise(C("w"))
    return rows.select("conv_id", "turn", "pos", word.alias("w"), F.when(h % 13 == 0, "-").when(h % 11 == 0, "-1").otherwise(h.cast("string")).alias("conf"))


_GATED = f"""SELECT conv_id, turn, count(*) FILTER (WHERE ok) AS words, coalesce(sum(len(regexp_extract_all(w, '[가-힣]'))) FILTER (WHERE ok), 0) AS hangul, coalesce(sum(length(regexp_replace(w, '\\s', '', 'g'))) FILTER (WHERE ok), 0) AS chars,
 coalesce(avg(c) FILTER (WHERE ok), 0.0) AS conf, md5(coalesce(string_agg(trim(w), ' ' ORDER BY pos) FILTER (WHERE ok), '')) AS text FROM (SELECT *, coalesce(c >= 30 AND trim(w) <> '', false) AS ok FROM (SELECT *, TRY_CAST(conf AS DOUBLE) AS c FROM ({_WORDS}))) GROUP BY conv_id, turn"""


@query(f"""WITH g AS ({_GATED}), r AS (SELECT *, CASE WHEN chars > 0 THEN hangul / chars ELSE 0.0 END AS ratio FROM g),
d AS (SELECT *, CASE WHEN conf >= 70 AND hangul = 0 AND words >= 2 THEN 'REJECT' WHEN hangul >= 2 AND ratio >= 0.40 AND conf >= 35 THEN 'ACCEPT' ELSE 'CLEAR-ONLY' END AS decision FROM r)
SELECT conv_id, turn, CAST(words AS BIGINT) AS words, CAST(hangul AS BIGINT) AS hangul, round(ratio, 9) AS ratio, round(conf, 9) AS conf, decision, CASE WHEN decision = 'ACCEPT' THEN text ELSE md5('') END AS text FROM d""")
def ocr_gate(spark, sf_dir):
    """Words of confidence 30 or more that are not blank; one whose confidence is no number is dropped."""
    conf = C("conf").try_cast("double")
    rows = _words(spark, sf_dir).withColumn("c", conf).withColumn("ok", F.coalesce((C("c") >= 30) & (F.trim("w") != ""), F.lit(False)))
    mine = lambda x: F.when(C("ok"), x)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(mine(F.struct("pos", F.trim("w").alias("w"))))), lambda x: x["w"]), " ")
    own = rows.groupBy("conv_id", "turn").agg(
        F.count_if("ok").alias("words"),
        F.coalesce(F.sum(mine(F.regexp_count("w", F.lit(R.HANGUL)))), F.lit(0)).cast("long").alias("hangul"),
        F.coalesce(F.sum(mine(F.length(F.regexp_replace("w", r"\s", "")))), F.lit(0)).alias("chars"),
        F.coalesce(F.avg(mine(C("c"))), F.lit(0.0)).alias("conf"),
        F.md5(text).alias("text"),
    )
    own = own.withColumn("ratio", F.when(C("chars") > 0, C("hangul") / C("chars")).otherwise(0.0)).withColumn("decision", R.ocr_gate(C("words"), C("hangul"), C("ratio"), C("conf")))
    return own.select("conv_id", "turn", "words", "hangul", F.round("ratio", 9).alias("ratio"), F.round("conf", 9).alias("conf"), "decision", F.when(C("decision") == "ACCEPT", C("text")).otherwise(F.md5(F.lit(""))).alias("text"))


@query(f"""SELECT conv_id, turn, round(coalesce(avg(c) FILTER (WHERE c >= 0), 0.0), 9) AS mean, CAST(count(*) FILTER (WHERE coalesce(c >= 25, true)) AS BIGINT) AS kept_by_book,
 CASE WHEN coalesce(avg(c) FILTER (WHERE c >= 0), 0.0) >= 85 THEN 'high' WHEN coalesce(avg(c) FILTER (WHERE c >= 0), 0.0) >= 60 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT *, TRY_CAST(conf AS DOUBLE) AS c FROM ({_WORDS})) GROUP BY conv_id, turn""")
def mean_conf(spark, sf_dir):
    """The mean of the counted confidences, 0 if none is; the book's own rule keeps a word whose confidence is no number."""
    rows = _words(spark, sf_dir).withColumn("c", C("conf").try_cast("double"))
    mean = F.coalesce(F.avg(F.when(C("c") >= 0, C("c"))), F.lit(0.0))
    own = rows.groupBy("conv_id", "turn").agg(mean.alias("m"), F.count_if(F.coalesce(C("c") >= 25, F.lit(True))).alias("kept_by_book"))
    return own.select("conv_id", "turn", F.round("m", 9).alias("mean"), "kept_by_book", R.confidence_tier(C("m")).alias("tier"))


_CONV_TEXT = _TRIM.format("text")


@query(f"""WITH t AS (SELECT conv_id, turn, text AS src, {pick_sql(['ja', 'de', 'en'], 'conv_id')} AS lang, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN '  ' WHEN 2 THEN '번역 ' || text WHEN 3 THEN upper(text) WHEN 4 THEN '漢字 ' || text END AS tr FROM conversations),
s AS (SELECT *, coalesce({_TRIM.format('tr')}, '') AS t, coalesce({_TRIM.format('src')}, '') AS o FROM t)
SELECT conv_id, turn, CASE WHEN t = '' THEN true WHEN regexp_matches(t, '[가-힣]') THEN false ELSE t = o OR (lang = 'ja' AND regexp_matches(t, '{T.CJK}')) END AS again FROM s""")
def untranslated(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    k = C("turn") % 6
    tr = F.when(k == 0, C("text")).when(k == 1, "  ").when(k == 2, F.concat(F.lit("번역 "), "text")).when(k == 3, F.upper("text")).when(k == 4, F.concat(F.lit("漢字 "), "text"))
    return rows.select("conv_id", "turn", R.is_untranslated(C("text"), tr, pick(["ja", "de", "en"], C("conv_id"))).alias("again"))


@query(f"""SELECT conv_id, turn, t <> '' AND CASE WHEN conv_id % 2 = 0 THEN regexp_matches(t, '[가-힣]') ELSE regexp_matches(t, '\\p{{L}}') END AS valid
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {_CONV_TEXT} WHEN 1 THEN '12 .,' WHEN 2 THEN '한글' ELSE '' END AS t FROM conversations)""")
def text_valid(spark, sf_dir):
    k = C("turn") % 4
    text = F.when(k == 0, T.strip(C("text"))).when(k == 1, "12 .,").when(k == 2, "한글").otherwise("")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", R.is_text(text, F.when(C("conv_id") % 2 == 0, "ko").otherwise("de")).alias("valid"))


# --- what is set again ------------------------------------------------------------------------------------------

_KINDS = ["dialogue", "caption", "shout", "sfx", "hand", "none"]
_ENTRY = f"""SELECT l_orderkey AS page, l_linenumber AS id, l_partkey AS p, l_suppkey AS s, {pick_sql(_KINDS, 'l_partkey + l_linenumber')} AS kind, CASE WHEN l_discount > 0.04 THEN 'high' WHEN l_discount > 0.01 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN l_tax < 0.07 THEN l_returnflag || l_linestatus ELSE '' END AS text, l_orderkey % 2 = 0 AS strict, l_suppkey % 2 = 0 AS hand, l_partkey % 2 = 0 AS sfx, l_quantity AS q, l_tax AS tax FROM lineitem"""


def _entries(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    confidence = F.when(C("l_discount") > 0.04, "high").when(C("l_discount") > 0.01, "medium").otherwise("low")
    text = F.when(C("l_tax") < 0.07, F.concat("l_returnflag", "l_linestatus")).otherwise("")
    return rows.select(C("l_orderkey").alias("page"), C("l_linenumber").alias("id"), C("l_partkey").alias("p"), C("l_suppkey").alias("s"), pick(_KINDS, C("l_partkey") + C("l_linenumber")).alias("kind"), confidence.alias("confidence"), text.alias("text"), (C("l_orderkey") % 2 == 0).alias("strict"), (C("l_suppkey") % 2 == 0).alias("hand"), (C("l_partkey") % 2 == 0).alias("sfx"), C("l_quantity").alias("q"), C("l_tax").alias("tax"))


_CAN = "(kind IN ('dialogue', 'caption', 'shout') OR (kind = 'sfx' AND sfx) OR (kind = 'hand' AND hand))"


@query(f"""SELECT page, id, p, text <> '' AND (confidence = 'high' OR NOT strict) AND {_CAN} AS retypable, CASE WHEN kind IN ('caption', 'shout') OR (kind = 'hand' AND hand) OR (kind = 'sfx' AND sfx) THEN kind ELSE 'dialogue' END AS fixed,
 CASE WHEN text <> '' AND tax > 0.03 THEN CASE WHEN q / 1000 > 0.03 THEN 'magenta' ELSE 'green' END WHEN text <> '' THEN 'orange' ELSE 'red' END AS colour FROM ({_ENTRY})""")
def retype_rules(spark, sf_dir):
    e = _entries(spark, sf_dir)
    retyped = (C("text") != "") & (C("tax") > 0.03)
    return e.select("page", "id", "p", R.is_retypable(C("text"), C("kind"), C("confidence"), C("strict"), C("hand"), C("sfx")).alias("retypable"), R.fixed_kind(C("kind"), C("hand"), C("sfx")).alias("fixed"), R.box_colour(retyped, C("q") / 1000, C("text")).alias("colour"))


@query(f"""WITH e AS ({_ENTRY}), n AS (SELECT *, s % 3 = 0 AS was, text <> '' AND confidence = 'high' AND {_CAN} AS shows, (kind = 'hand' AND hand) OR (kind = 'sfx' AND sfx) AS special FROM e),
c AS (SELECT *, CASE WHEN was AND NOT shows THEN 'rework-kept' WHEN NOT was AND NOT shows AND text <> '' THEN 'rework-forced' ELSE 'rework-' || CASE WHEN s % 5 = 0 THEN 'ai' ELSE 'p' || (s % 5) END END AS passes FROM n)
SELECT page, id, p, passes, CASE WHEN passes = 'rework-kept' THEN 'old' ELSE text END AS text, CASE WHEN passes = 'rework-kept' THEN 'rework_text=' || text || ',kind=' || kind || ',confidence=' || confidence WHEN p % 3 = 0 THEN 'pass1=' || p ELSE 'was=1' END AS alt,
 CASE WHEN passes = 'rework-kept' THEN 'dialogue' WHEN passes = 'rework-forced' AND NOT special AND kind NOT IN ('caption', 'shout') THEN 'dialogue' ELSE kind END AS kind, CASE passes WHEN 'rework-kept' THEN 'high' WHEN 'rework-forced' THEN 'high' ELSE confidence END AS confidence,
 CASE WHEN passes <> 'rework-kept' AND p % 4 = 0 THEN true ELSE s % 4 = 0 END AS fixed, CASE WHEN passes <> 'rework-kept' AND p % 5 = 0 THEN true ELSE NULL END AS uncertain, CASE WHEN passes <> 'rework-kept' AND p % 6 > 0 THEN 'S' || p ELSE 'old src' END AS src FROM c""")
def prefer_old(spark, sf_dir):
    """A new reading that would not be shown does not replace one that is; one that the user asked for is set whatever its kind."""
    e, p, s = _entries(spark, sf_dir), C("p"), C("s")
    old = {"old_text": F.lit("old"), "old_kind": F.lit("dialogue"), "old_confidence": F.lit("high"), "old_alt": F.create_map(F.lit("was"), F.lit("1")), "old_fixed": s % 4 == 0, "old_uncertain": F.lit(None).cast("boolean"), "old_src": F.lit("old src")}
    alt = F.when(p % 3 == 0, F.create_map(F.lit("pass1"), p.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    new = {"passes": F.when(s % 5 == 0, "").otherwise(F.concat(F.lit("p"), (s % 5).cast("string"))), "alt": alt, "fixed": p % 4 == 0, "uncertain": p % 5 == 0, "src": F.when(p % 6 > 0, F.concat(F.lit("S"), p.cast("string"))).otherwise("")}
    out = V.rework(e.withColumns({"retyped": s % 3 == 0, **old, **new}))
    listed = F.array_join(F.transform(F.map_entries("alt"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.select("page", "id", "p", "passes", "text", listed.alias("alt"), "kind", "confidence", "fixed", "uncertain", "src")


@query(f"""SELECT page, bool_or(kind IN ('dialogue', 'caption', 'shout', 'hand') AND NOT (text <> '' AND tax > 0.03)) AS todo FROM ({_ENTRY}) GROUP BY page""")
def page_needs_work(spark, sf_dir):
    open_ = C("kind").isin(R.LOOKED_AT) & ~((C("text") != "") & (C("tax") > 0.03))
    return _entries(spark, sf_dir).groupBy("page").agg(F.bool_or(open_).alias("todo"))


@query("""WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0),
p AS (SELECT k FROM r WHERE k IN (SELECT k FROM f))
SELECT k AS page, false AS locked, 0 AS part FROM p UNION ALL SELECT k, true, 1 FROM f WHERE k NOT IN (SELECT k FROM p)""")
def review_pages(spark, sf_dir):
    """Pages that are done and have entries and a final image; then other finals, locked."""
    orders, entries = read(spark, sf_dir, "orders").select(C("o_orderkey").alias("page"), "o_orderstatus"), read(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("page"))
    rows = orders.count() + entries.count()
    finals = spread(rows, orders.filter("page % 3 <> 0").select("page"), "page")
    own = spread(rows, orders.filter("o_orderstatus = 'O'").select("page"), "page").join(spread(rows, entries, "page"), "page", "left_semi").join(finals, "page", "left_semi")
    return V.with_unlisted(own, finals, "page")


@query("""SELECT event_id, CASE WHEN m = '' THEN false ELSE len(list_filter(['credit balance', 'api key', 'api 키', 'unauthorized', '401', '403', '비전 미지원', '404', 'not found', 'does not exist', 'is not supported', '지원되지'], lambda k: contains(lower(m), k))) > 0 END AS fatal, hint, CAST(i AS INT) AS i, CAST(n AS INT) AS n FROM (
 SELECT event_id, m, TRY_CAST(nullif(regexp_extract(m, '(?i)only\\s*([0-9]*\\.?[0-9]+)\\s*is allowed', 1), '') AS DOUBLE) AS hint, coalesce(nullif(regexp_extract(m, '\\[(\\d+)/(\\d+)\\]', 1), ''), nullif(regexp_extract(m, '\\([^)]*\\) (\\d+)/(\\d+)', 1), '')) AS i, coalesce(nullif(regexp_extract(m, '\\[(\\d+)/(\\d+)\\]', 2), ''), nullif(regexp_extract(m, '\\([^)]*\\) (\\d+)/(\\d+)', 2), '')) AS n
 FROM (SELECT event_id, """ + pick_sql(["Invalid API KEY given", "HTTP 404", "time out", "only 0.6 is allowed", "[3/17] page", "(stage) 4/9 done", ""], "event_id") + " || CASE WHEN event_id % 5 = 0 THEN ' Not Found' ELSE '' END AS m FROM events))")
def run_messages(spark, sf_dir):
    m = F.concat(pick(["Invalid API KEY given", "HTTP 404", "time out", "only 0.6 is allowed", "[3/17] page", "(stage) 4/9 done", ""], C("event_id")), F.when(C("event_id") % 5 == 0, " Not Found").otherwise(""))
    at = R.progress_of(m)
    return read(spark, sf_dir, "events").select("event_id", R.is_fatal(m).alias("fatal"), R.allowed_temperature(m).alias("hint"), at["i"].alias("i"), at["n"].alias("n"))


@query(f"""WITH a AS ({_ENTRY}), x AS (SELECT *, p % 11 = 0 AS failed, CASE WHEN s % 4 = 0 THEN ' ' WHEN s % 4 = 1 THEN NULL ELSE 'T' || id END AS tr FROM a WHERE text <> '')
SELECT page, id, p, text AS src, CASE WHEN failed THEN text ELSE nullif(trim(tr), '') END AS text, CASE WHEN failed OR nullif(trim(tr), '') IS NOT NULL THEN kind ELSE 'none' END AS kind,
 CASE WHEN failed THEN CASE WHEN confidence = 'high' THEN 'medium' ELSE confidence END WHEN nullif(trim(tr), '') IS NULL THEN 'low' ELSE confidence END AS confidence, CASE WHEN failed THEN 'ocr+xlat-failed' ELSE 'ocr+xlat' END AS passes FROM x""")
def xlat_outcome(spark, sf_dir):
    tr = F.when(C("s") % 4 == 0, " ").when(C("s") % 4 == 2, F.concat(F.lit("T"), C("id").cast("string"))).when(C("s") % 4 == 3, F.concat(F.lit("T"), C("id").cast("string")))
    rows = _entries(spark, sf_dir).filter("text <> ''").withColumns({"failed": C("p") % 11 == 0, "tr": tr, "passes": F.lit("ocr")})
    return V.translated(rows).select("page", "id", "p", "src", "text", "kind", "confidence", "passes")


# --- edits ------------------------------------------------------------------------------------------------------

_PARAS = "SELECT conv_id AS book, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text AS src, role AS tr FROM conversations"
_EDIT = "SELECT conv_id AS book, CASE WHEN turn % 6 = 5 THEN 'x' ELSE CAST(turn AS VARCHAR) END AS key, turn % 2 = 0 AS has_src, 'S  ' || turn || chr(10) || ' ' || chr(10) || 'z' AS src, turn % 3 <> 1 AS has_text, CASE WHEN turn % 4 = 0 THEN ' ' ELSE 'T' || turn END AS text, CASE WHEN conv_id % 4 = 0 THEN 'old' ELSE 'fp' END AS fp, CASE WHEN conv_id % 5 = 0 THEN -1 ELSE n END AS count FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"""WITH p AS ({_PARAS}), b AS (SELECT book, count(*) AS n FROM p GROUP BY book), e0 AS ({_EDIT}), e AS (SELECT *, 0 AS ord FROM e0 UNION ALL SELECT * REPLACE ('0' || key AS key, NOT has_src AS has_src, 'again' AS src, false AS has_text), 1 FROM e0 WHERE key <> 'x' AND CAST(key AS INT) % 3 = 0),
h AS (SELECT e.book, TRY_CAST(e.key AS BIGINT) AS idx, e.* EXCLUDE (book) FROM e JOIN b ON e.book = b.book WHERE e.fp = 'fp' AND e.count = b.n AND TRY_CAST(e.key AS BIGINT) BETWEEN 0 AND b.n - 1),
g AS (SELECT book, idx, bool_or(has_src) AS has_src, arg_max(src, ord) FILTER (WHERE has_src) AS src, bool_or(has_text) AS has_text, arg_max(text, ord) FILTER (WHERE has_text) AS text FROM h GROUP BY book, idx)
SELECT p.book, CAST(p.idx AS BIGINT) AS idx, md5(CASE WHEN g.has_src THEN trim(regexp_replace(g.src, '[ \\t]*\\n[ \\t]*\\n+', chr(10), 'g'), ' ' || chr(10)) ELSE p.src END) AS src,
 CASE WHEN g.has_text THEN nullif(trim(g.text), '') ELSE p.tr END AS text FROM p LEFT JOIN g ON p.book = g.book AND p.idx = g.idx""")
def apply_edits_fenced(spark, sf_dir):
    """Edits of a book hold only for the version and the number of paragraphs that they were made on."""
    by = W.partitionBy("conv_id")
    conv = read(spark, sf_dir, "conversations")
    paras = conv.select(C("conv_id").alias("book"), (F.row_number().over(by.orderBy("turn")) - 1).cast("long").alias("idx"), C("text").alias("src"), C("role").alias("text"))
    turn = C("turn").cast("string")
    edits = conv.select(
        C("conv_id").alias("book"), F.when(C("turn") % 6 == 5, "x").otherwise(turn).alias("key"), (C("turn") % 2 == 0).alias("has_src"), F.concat(F.lit("S  "), turn, F.lit("\n \nz")).alias("src"), (C("turn") % 3 != 1).alias("has_text"),
        F.when(C("turn") % 4 == 0, " ").otherwise(F.concat(F.lit("T"), turn)).alias("text"), F.when(C("conv_id") % 4 == 0, "old").otherwise("fp").alias("fp"), F.when(C("conv_id") % 5 == 0, -1).otherwise(F.count(F.lit(1)).over(by)).alias("count"))
    versions = paras.groupBy("book").agg(F.lit("fp").alias("fp"), F.count(F.lit(1)).alias("count"))
    again = edits.filter("key <> 'x' and try_cast(key as int) % 3 = 0").withColumns({"key": F.concat(F.lit("0"), "key"), "has_src": ~C("has_src"), "src": F.lit("again"), "has_text": F.lit(False), "ord": F.lit(1)})
    return V.apply_edits(paras, edits.withColumn("ord", F.lit(0)).unionByName(again), versions, "ord").select("book", "idx", F.md5("src").alias("src"), "text")


@query("""SELECT user_id, CASE WHEN bool_or(bad) THEN '' ELSE coalesce(string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY CAST(i AS VARCHAR)) FILTER (WHERE i >= 0 AND i < 5000), '') END AS ids, CAST(count(*) FILTER (WHERE pos >= 0 AND pos < 100) AS BIGINT) AS positions FROM (
 SELECT user_id, TRY_CAST(k AS BIGINT) AS i, TRY_CAST(k AS BIGINT) IS NULL AS bad, value - 5 AS pos FROM (SELECT user_id, value, CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(event_id - 50 AS VARCHAR) END AS k FROM events)) GROUP BY user_id""")
def edit_ranges(spark, sf_dir):
    """Ids that are in the book; one that is no number voids the list. Positions outside of it do not count."""
    key = F.when(C("event_id") % 97 == 0, "n/a").otherwise((C("event_id") - 50).cast("string"))
    rows = read(spark, sf_dir, "events").select("user_id", key.try_cast("long").isNull().alias("bad"), R.index_in(key, F.lit(5000)).alias("i"), R.position_in(C("value") - 5, F.lit(100)).alias("pos"))
    ids = F.array_join(F.array_sort(F.collect_set(C("i").cast("string"))), ",")
    return rows.groupBy("user_id").agg(F.when(F.bool_or("bad"), "").otherwise(ids).alias("ids"), F.count("pos").alias("positions"))


@query("""SELECT page_id, array_to_string(list_sort(list_concat(list_transform(list_filter(['font', 'size', 'fill'], lambda k: NOT list_contains(i, k)), lambda k: k || '=d'), list_transform(i, lambda k: k || '=i'))), ';') AS style,
 CASE WHEN page_id % 3 = 0 THEN 'old' WHEN page_id % 3 = 1 THEN NULL ELSE 'new' END AS font, CAST(CASE WHEN page_id % 3 = 2 THEN coalesce(nullif(page_id % 4, 0), 0) WHEN page_id % 3 = 0 THEN 7 END AS INT) AS font_index FROM (SELECT page_id, list_filter(['size', 'align', 'fill'], lambda k: (page_id + length(k)) % 2 = 0) AS i FROM pages)""")
def overlay_style(spark, sf_dir):
    """The page's default style under each item's own; a font that is given sets, an empty one removes, none keeps."""
    text_map = lambda keys, v: F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(v)))
    item = F.filter(F.array(*map(F.lit, ["size", "align", "fill"])), lambda k: (C("page_id") + F.length(k)) % 2 == 0)
    has, font = C("page_id") % 3 != 0, F.when(C("page_id") % 3 == 2, "new").otherwise("")
    set_font = R.patched(F.lit("old"), has, font)
    index = F.when(set_font.isNull(), None).when(has, C("page_id") % 4).otherwise(7).cast("int")
    return read(spark, sf_dir, "pages").select("page_id", R.map_text(R.overlaid(text_map(F.array(*map(F.lit, ["font", "size", "fill"])), "d"), text_map(item, "i"))).alias("style"), set_font.alias("font"), index.alias("font_index"))


@query(f"""SELECT page, id, p, concat_ws(',', CAST(id AS VARCHAR), text, kind, confidence, CASE WHEN s % 2 = 0 THEN 'src' END, CASE WHEN s % 3 = 0 THEN 'font:' || (s % 5) END, CASE WHEN s % 7 = 0 THEN 'clean' END) AS entry FROM ({_ENTRY})""")
def review_entries(spark, sf_dir):
    """What an entry keeps on its way back: its own fields, and optional ones that hold something."""
    font = F.when(C("s") % 3 == 0, F.concat(F.lit("font:"), (C("s") % 5).cast("string")))
    return _entries(spark, sf_dir).select("page", "id", "p", F.concat_ws(",", C("id").cast("string"), "text", "kind", "confidence", F.when(C("s") % 2 == 0, "src"), font, F.when(C("s") % 7 == 0, "clean")).alias("entry"))


@query("""SELECT conv_id, turn, printf('p%04d', a + 1) AS page, CASE WHEN a <> b THEN printf('p%04d', b + 1) END AS page_end, CAST(a AS INT) AS start FROM (SELECT conv_id, turn, turn // 2 AS a, (turn + turn % 3) // 2 AS b FROM conversations)""")
def para_spans(spark, sf_dir):
    """A paragraph's page, the one it ends on if that is another, and the index that the label stands for."""
    a, b = F.expr("turn div 2"), F.expr("(turn + turn % 3) div 2")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.page_label(a).alias("page"), T.page_label(b).alias("last"))
    return rows.select("conv_id", "turn", "page", F.nullif("last", "page").alias("page_end"), R.label_index(C("page")).alias("start"))


@query("""SELECT p_partkey, nullif(concat_ws(';', CASE WHEN p_size > 25 THEN 'size=' || p_size END, CASE WHEN p_partkey % 3 <> 0 THEN 'dx=' || (p_partkey % 3) END, CASE WHEN p_partkey % 5 > 1 THEN 'track=' || (p_partkey % 5) END,
 CASE WHEN p_partkey % 4 <> 0 THEN 'align=' || ['left', 'right', 'center'][CAST(p_partkey % 4 AS INT)] END, CASE WHEN p_partkey % 6 = 0 THEN 'fill=1' END), '') AS layout FROM part""".replace("CASE WHEN p_partkey % 4 <> 0 THEN 'align='", "CASE WHEN p_partkey % 4 > 1 THEN 'align='"))
def layout_norm(spark, sf_dir):
    """A layout without what is the default anyhow; null if nothing is left."""
    k = C("p_partkey")
    size, dx, track = F.when(C("p_size") > 25, C("p_size")).otherwise(0), k % 3, k % 5
    align = F.when(k % 4 > 0, F.element_at(F.array(*map(F.lit, ["left", "right", "center"])), F.greatest(F.lit(1), (k % 4).cast("int"))))
    kept = lambda name, c, default: F.when(~c.isin(*default), F.concat(F.lit(f"{name}="), c.cast("string")))
    fields = [kept("size", size, [0]), kept("dx", dx, [0]), kept("track", track, [0, 1]), kept("align", align, ["left"]), F.when(k % 6 == 0, "fill=1")]
    return read(spark, sf_dir, "part").select("p_partkey", F.nullif(F.concat_ws(";", *fields), F.lit("")).alias("layout"))


_TAGS = ["text", "keep", "src", "font", "region", "clean", "add", "lock", "style", "page_crop", "ai", "revert", "layout", "rebuild", "unlock", "text", "paint", "set_default", "keep"]
_ONE = f"SELECT * FROM ({_ENTRY}) QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY p, s, q, tax, text, confidence) = 1"
_ACTIONS = f"""SELECT page, id * 10 + p % 10 AS ord, {pick_sql(_TAGS, 'p + s')} AS action, CASE WHEN s % 3 = 0 THEN 1 ELSE id END AS id, CASE WHEN p % 4 = 0 THEN ' ' ELSE 'T' || p END AS text, CASE WHEN p % 6 = 0 THEN '' ELSE 'S' || p END AS src,
 s % 2 = 0 AS has_font, CASE WHEN s % 4 = 0 THEN '' ELSE 'G' || (s % 3) END AS font, p % 40 AS w, s % 40 AS h, p % 3 = 0 AS clean FROM ({_ONE})"""


@query(f"""WITH e AS (SELECT page, id, text, NULL::VARCHAR AS src, kind, confidence, 'ocr' AS passes, CASE WHEN p % 5 = 0 THEN 'F' END AS font, NULL::VARCHAR AS region, p % 7 = 0 AS clean, hand, sfx FROM ({_ONE})), a AS ({_ACTIONS}),
g AS (SELECT page, arg_max(action, ord) FILTER (WHERE action IN ('lock', 'unlock')) AS lock, arg_max(CASE WHEN w >= 16 AND h >= 16 THEN w || 'x' || h ELSE '' END, ord) FILTER (WHERE action = 'page_crop') AS crop,
 coalesce(bool_or(action NOT IN ('lock', 'unlock', 'page_crop', 'set_default', 'revert')) AND count(*) FILTER (WHERE action = 'revert') % 2 = 1, false) AS back FROM a GROUP BY page),
s AS (SELECT DISTINCT e.page, CASE WHEN lock IS NOT NULL THEN lock = 'lock' ELSE e.page % 11 = 0 END AS locked, nullif(crop, '') AS crop, back FROM e LEFT JOIN g ON e.page = g.page),
i AS (SELECT page, id, max(ord) FILTER (WHERE action = 'text') AS text_at, min(ord) FILTER (WHERE action = 'keep') AS keep_first, max(ord) FILTER (WHERE action = 'keep') AS keep_at, arg_max(trim(text), ord) FILTER (WHERE action = 'text') AS new_text,
 arg_max(src, ord) FILTER (WHERE action IN ('text', 'src') AND src <> '') AS new_src, arg_max(CASE action WHEN 'text' THEN 'manual' WHEN 'src' THEN 'src-edit' WHEN 'keep' THEN 'keep' ELSE 'style' END, ord) FILTER (WHERE action IN ('text', 'keep', 'font', 'style', 'layout') OR (action = 'src' AND src <> '')) AS new_passes,
 arg_max(font, ord) FILTER (WHERE action IN ('text', 'src', 'font', 'style', 'layout', 'ai') AND has_font) AS new_font, arg_max(CASE WHEN w >= 8 AND h >= 8 THEN w || 'x' || h ELSE '' END, ord) FILTER (WHERE action = 'region') AS new_region, arg_max(clean, ord) FILTER (WHERE action = 'clean') AS new_clean FROM a GROUP BY page, id),
k AS (SELECT e.*, s.locked, s.crop, NOT s.locked AND NOT s.back AS o, i.* EXCLUDE (page, id) FROM e JOIN s ON e.page = s.page LEFT JOIN i ON e.page = i.page AND e.id = i.id),
t AS (SELECT page, max(id) AS top FROM e GROUP BY page)
SELECT page, id, CASE WHEN o AND new_text IS NOT NULL THEN nullif(new_text, '') ELSE text END AS text, CASE WHEN o THEN coalesce(new_src, src) ELSE src END AS src,
 CASE WHEN NOT o THEN kind WHEN keep_at > coalesce(text_at, -1) THEN 'preserved' WHEN text_at IS NULL THEN kind WHEN keep_first < text_at THEN 'dialogue' WHEN kind IN ('caption', 'shout') OR (kind = 'hand' AND hand) OR (kind = 'sfx' AND sfx) THEN kind ELSE 'dialogue' END AS kind,
 CASE WHEN o AND text_at IS NOT NULL THEN 'high' ELSE confidence END AS confidence, CASE WHEN o THEN coalesce(new_passes, passes) ELSE passes END AS passes, CASE WHEN o AND new_font IS NOT NULL THEN nullif(new_font, '') ELSE font END AS font,
 CASE WHEN o AND new_region IS NOT NULL THEN nullif(new_region, '') ELSE region END AS region, CASE WHEN o THEN coalesce(new_clean, clean) ELSE clean END AS clean, locked, crop FROM k
UNION ALL SELECT a.page, CAST(t.top + row_number() OVER (PARTITION BY a.page ORDER BY a.ord) AS INT), nullif(trim(a.text), ''), NULL, 'dialogue', 'high', CASE WHEN trim(a.text) = '' THEN 'add-ai' ELSE 'manual-add' END, CASE WHEN a.has_font THEN nullif(a.font, '') END, NULL, false, s.locked, s.crop
 FROM a JOIN s ON a.page = s.page JOIN t ON a.page = t.page WHERE a.action = 'add' AND a.w >= 8 AND a.h >= 8 AND NOT s.locked AND NOT s.back""")
def rework_actions(spark, sf_dir):
    """Actions of all tags on the entries of pages, some of which are locked."""
    first = F.row_number().over(W.partitionBy("page", "id").orderBy("p", "s", "q", "tax", "text", "confidence"))
    own = _entries(spark, sf_dir).withColumn("first", first).filter("first = 1")
    none = F.lit(None).cast("string")
    entries = own.select("page", "id", "text", none.alias("src"), "kind", "confidence", F.lit("ocr").alias("passes"), F.when(C("p") % 5 == 0, "F").alias("font"), none.alias("region"), (C("p") % 7 == 0).alias("clean"), "hand", "sfx")
    p, s = C("p"), C("s")
    actions = own.select(
        "page", (C("id") * 10 + p % 10).alias("ord"), pick(_TAGS, p + s).alias("action"), F.when(s % 3 == 0, 1).otherwise(C("id")).alias("id"), F.when(p % 4 == 0, " ").otherwise(F.concat(F.lit("T"), p.cast("string"))).alias("text"), F.when(p % 6 == 0, "").otherwise(F.concat(F.lit("S"), p.cast("string"))).alias("src"),
        (s % 2 == 0).alias("has_font"), F.when(s % 4 == 0, "").otherwise(F.concat(F.lit("G"), (s % 3).cast("string"))).alias("font"), (p % 40).alias("w"), (s % 40).alias("h"), (p % 3 == 0).alias("clean"))
    pages = own.select("page", (C("page") % 11 == 0).alias("locked")).distinct()
    return V.apply_actions(entries, pages, actions)


# --- names and lists --------------------------------------------------------------------------------------------

_FILE = "CASE WHEN page_id % 7 = 0 THEN '_' ELSE '' END || 'book' || (page_id % 40) || ['.html', '.data.json', '.txt'][CAST(page_id % 3 AS INT) + 1]"


@query(f"""WITH f AS (SELECT {_FILE} AS file FROM pages), n AS (SELECT DISTINCT CASE WHEN ends_with(file, '.html') THEN regexp_replace(file, '\\.html$', '') ELSE regexp_replace(file, '\\.data\\.json$', '') END AS name FROM f WHERE NOT starts_with(file, '_') AND (ends_with(file, '.html') OR ends_with(file, '.data.json'))),
e AS (SELECT 'book' || (user_id % 60) AS name, count(DISTINCT user_id) AS pending, max(value) AS pos, count(*) AS n FROM events GROUP BY ALL)
SELECT n.name, CAST(coalesce(e.pending, 0) AS BIGINT) AS pending, e.pos, CAST(CASE WHEN e.n > 0 THEN least(100, floor((floor(e.pos) + 1) / e.n * 100 + 0.5)) END AS INT) AS pct FROM n LEFT JOIN e ON n.name = e.name""")
def catalog_list(spark, sf_dir):
    """Books that have a page or data file, with their queued edits and how far they are read; system files are none."""
    k = C("page_id")
    file = F.concat(F.when(k % 7 == 0, "_").otherwise(""), F.lit("book"), (k % 40).cast("string"), pick([".html", ".data.json", ".txt"], k))
    names = read(spark, sf_dir, "pages").select(R.book_name(file).alias("name")).filter("name is not null").distinct()
    events = read(spark, sf_dir, "events").groupBy(F.concat(F.lit("book"), (C("user_id") % 60).cast("string")).alias("name")).agg(F.countDistinct("user_id").alias("pending"), F.max("value").alias("pos"), F.count(F.lit(1)).alias("n"))
    return names.join(events, "name", "left").select("name", F.coalesce("pending", F.lit(0)).alias("pending"), "pos", R.progress_percent(C("pos"), C("n")).alias("pct"))


@query("SELECT o_orderkey, CAST(CASE WHEN n > 0 THEN least(100, floor((floor(pos) + 1) / n * 100 + 0.5)) END AS INT) AS pct FROM (SELECT o_orderkey, o_totalprice / 1000 AS pos, o_orderkey % 400 AS n FROM orders)")
def progress_pct(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", R.progress_percent(C("o_totalprice") / 1000, C("o_orderkey") % 400).alias("pct"))


@query("SELECT p_size, coalesce(nullif(array_to_string(list_sort(list_distinct(list(p_name) FILTER (WHERE p_partkey % 9 = 0))), ','), ''), 'default') AS models, CAST(sum(p_partkey % 3 + p_partkey % 5) AS BIGINT) AS done FROM part GROUP BY p_size")
def model_lists(spark, sf_dir):
    """Distinct names in order, or the default; and a batch's requests that have ended one way or another."""
    names = F.array_join(F.array_sort(F.collect_set(F.when(C("p_partkey") % 9 == 0, C("p_name")))), ",")
    return read(spark, sf_dir, "part").groupBy("p_size").agg(F.coalesce(F.nullif(names, F.lit("")), F.lit("default")).alias("models"), F.sum(C("p_partkey") % 3 + C("p_partkey") % 5).alias("done"))


@query(r"""SELECT page_id, regexp_replace(t, '[\\/:*?"<>|]', '_', 'g') AS safe, trim(lower(regexp_replace(t, '[^\p{L}\p{N}_]+', '-', 'g')), '-') AS slug, CASE WHEN m = '' OR m = 'm-1' THEN 'm-2' ELSE m END AS model, coalesce(nullif(trim(c), ''), 'été') AS title FROM (
 SELECT page_id, url || ' "Été" ' || page_id || '?' AS t, trim(['', ' m-1', 'm-2 ', 'm-3'][CAST(page_id % 4 AS INT) + 1]) AS m, ['', '  ', ' Titel'][CAST(page_id % 3 AS INT) + 1] AS c FROM pages)""")
def names(spark, sf_dir):
    """Names that paths can hold, slugs in any script, a model's default, a title or the file's stem."""
    t = F.concat("url", F.lit(' "Été" '), C("page_id").cast("string"), F.lit("?"))
    model = R.model_or(pick(["", " m-1", "m-2 ", "m-3"], C("page_id")), "m-2", ["m-1"])
    title = R.title_or_stem(pick(["", "  ", " Titel"], C("page_id")), F.lit("a/b.c/été.pdf"))
    return read(spark, sf_dir, "pages").select("page_id", R.safe_name(t).alias("safe"), R.word_slug(t).alias("slug"), model.alias("model"), title.alias("title"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def stamps(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query()
def stable_ports(spark, sf_dir):
    """A port of its own for each name; crc32 is not in the other engine, so that a test holds it against zlib."""
    return read(spark, sf_dir, "pages").select("page_id", (F.crc32(C("url").cast("binary")) % 16000 + 49152).alias("port"))


# --- geometry and order -----------------------------------------------------------------------------------------

_BOX = "SELECT l_orderkey AS page, l_partkey AS p, l_linenumber AS id, 100 + l_partkey % 900 AS wd, 100 + l_suppkey % 700 AS ht, l_linenumber * 97 - 150 AS x, l_suppkey % 300 - 20 AS y, l_partkey % 400 AS w, CAST(l_quantity AS BIGINT) * 5 AS h FROM lineitem"


def _boxes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("page"), C("l_partkey").alias("p"), C("l_linenumber").alias("id"), (C("l_partkey") % 900 + 100).alias("wd"), (C("l_suppkey") % 700 + 100).alias("ht"), (C("l_linenumber") * 97 - 150).cast("long").alias("x"), (C("l_suppkey") % 300 - 20).alias("y"), (C("l_partkey") % 400).alias("w"), (C("l_quantity").cast("long") * 5).alias("h"))


@query(f"""WITH c AS (SELECT *, greatest(0, least(x, wd - 1)) AS l, greatest(0, least(y, ht - 1)) AS t FROM ({_BOX}) WHERE w >= 16 AND h >= 16), k AS (SELECT *, greatest(l + 1, least(l + w, wd)) AS r, greatest(t + 1, least(t + h, ht)) AS b FROM c)
SELECT page, p, id, l, t, r, b, CAST(CASE WHEN 300.0::DOUBLE / greatest(wd, ht) < 1 THEN greatest(1.0, round_even(wd * (300.0::DOUBLE / greatest(wd, ht)), 0)) ELSE wd END AS BIGINT) AS out_w, CAST(CASE WHEN 300.0::DOUBLE / greatest(wd, ht) < 1 THEN greatest(1.0, round_even(ht * (300.0::DOUBLE / greatest(wd, ht)), 0)) ELSE ht END AS BIGINT) AS out_h,
 CAST(list_sum(list_sort([l, t, r, b])[2:3]) // 2 AS BIGINT) AS background FROM k""")
def crop_boxes(spark, sf_dir):
    """Crops of 16 pixels or more within their page, the page's size at 300 pixels, and a background from four corners."""
    rows = _boxes(spark, sf_dir).filter("w >= 16 AND h >= 16").withColumn("box", R.clamped(C("x"), C("y"), C("w"), C("h"), C("wd"), C("ht"))).select("*", "box.*")
    longest = F.greatest("wd", "ht")
    return rows.select("page", "p", "id", "l", "t", "r", "b", R.fitted(C("wd"), longest, 300).alias("out_w"), R.fitted(C("ht"), longest, 300).alias("out_h"), R.corner_background(F.array("l", "t", "r", "b")).alias("background"))


@query(f"""SELECT page, p, id, a BETWEEN 12 AND 2500 AND w <= 70 AND h <= 70 AND d >= 0.15 AS letter, (greatest(w, h) >= 90 AND d < 0.18) OR greatest(w, h) >= 300 OR a > 12000 AS line, w / h BETWEEN 0.25 AND 5 AND d >= 0.45 AND 1 - d >= 0.1 AS shape FROM (
 SELECT *, CAST(a AS DOUBLE) / greatest(w * h, 1) AS d FROM (SELECT page, p, id, greatest(w, 1) AS w, greatest(h, 1) AS h, p * 7 % 15000 AS a FROM ({_BOX})))""")
def component_filters(spark, sf_dir):
    """Components that may be letters, those that are lines of the drawing, and outlines that may be bubbles."""
    rows = _boxes(spark, sf_dir).select("page", "p", "id", F.greatest("w", F.lit(1)).alias("w"), F.greatest("h", F.lit(1)).alias("h"), (C("p") * 7 % 15000).alias("a"))
    rows = rows.withColumn("d", C("a").cast("double") / F.greatest(C("w") * C("h"), F.lit(1)))
    longest = F.greatest("w", "h")
    letter = C("a").between(12, 2500) & (C("w") <= 70) & (C("h") <= 70) & (C("d") >= 0.15)
    line = ((longest >= 90) & (C("d") < 0.18)) | (longest >= 300) | (C("a") > 12000)
    shape = (C("w") / C("h")).between(0.25, 5) & (C("d") >= 0.45) & (1 - C("d") >= 0.1)
    return rows.select("page", "p", "id", letter.alias("letter"), line.alias("line"), shape.alias("shape"))


_STAR = """SELECT p_partkey AS k, i, 200 + p_partkey % 220 + [3, 2, 0, -2, -3, -2, 0, 2][CAST(i + 1 AS INT)] * r AS x, 210 + [0, 2, 3, 2, 0, -2, -3, -2][CAST(i + 1 AS INT)] * r AS y FROM (SELECT p_partkey, i, 11 + (p_partkey * (i + 3) * 7) % (3 + p_partkey % 40) AS r FROM part, range(8) t(i))"""


@query(f"""WITH s AS ({_STAR}), b AS (SELECT k, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM s GROUP BY k),
a AS (SELECT s.k, abs(sum(s.x * t.y - s.y * t.x)) AS a2 FROM s JOIN s t ON s.k = t.k AND t.i = (s.i + 1) % 8 GROUP BY s.k),
d AS (SELECT DISTINCT k, x, y FROM s), e AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS ux, b.y AS uy, bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0)) AS edge
 FROM d a JOIN d b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y) JOIN d c ON a.k = c.k GROUP BY ALL),
h AS (SELECT k, sum(ax * uy - ay * ux) AS hull2 FROM e WHERE edge GROUP BY k),
f AS (SELECT b.*, a2, hull2, a2 // 2 AS area, (a2 // 2) * (50 + b.k % 51) // 100 AS white, (a2 // 2) * (b.k % 43) // 100 AS ink, w * (b.k % 37) // 60 AS peak, 560 - b.k % 9 * 20 AS page_w FROM b JOIN a ON a.k = b.k JOIN h ON h.k = b.k)
SELECT k AS p_partkey, CAST(a2 AS BIGINT) AS a2, CAST(hull2 AS BIGINT) AS hull2, x > 3 AND y > 3 AND x + w < page_w - 3 AND y + h < 420 - 3 AND w / h::DOUBLE BETWEEN 0.25 AND 5 AND area >= 400 AND area / (w * h)::DOUBLE >= 0.45 AND white / area::DOUBLE >= 0.55 AND ink / area::DOUBLE BETWEEN 0.008 AND 0.35 AND peak / w::DOUBLE >= 0.12 AND a2 / hull2::DOUBLE >= 0.78 AS bubble FROM f""")
def bubble_score(spark, sf_dir):
    """Outlines of eight corners with their measured shares: which of them may be bubbles, by all conditions; the SQL finds the hull's edges among all pairs."""
    k = C("p_partkey")
    r = lambda i: 11 + (k * (i + 3) * 7) % (3 + k % 40)
    corner = lambda i, dx, dy: F.struct((200 + k % 220 + dx * r(i)).alias("x"), (210 + dy * r(i)).alias("y"))
    star = F.array(*[corner(i, dx, dy) for i, (dx, dy) in enumerate(zip((3, 2, 0, -2, -3, -2, 0, 2), (0, 2, 3, 2, 0, -2, -3, -2), strict=True))])
    of = lambda f, c: f(F.transform("star", lambda p: p[c]))
    box = {"x": of(F.array_min, "x"), "y": of(F.array_min, "y"), "w": of(F.array_max, "x") - of(F.array_min, "x") + 1, "h": of(F.array_max, "y") - of(F.array_min, "y") + 1, "a2": G.polygon_area2(C("star"))}
    rows = dealt(spark, read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", star.alias("star")).withColumns(box).withColumn("area", F.expr("a2 div 2"))
    rows = rows.withColumns({"white": F.expr("area * (50 + p_partkey % 51) div 100"), "ink": F.expr("area * (p_partkey % 43) div 100"), "peak": F.expr("w * (p_partkey % 37) div 60"), "page_w": 560 - k % 9 * 20})
    bubble = G.is_bubble(C("x"), C("y"), C("w"), C("h"), C("area"), C("white"), C("ink"), C("peak"), C("star"), C("page_w"), F.lit(420), 400)
    return rows.select("p_partkey", "a2", G.polygon_area2(G.hull(C("star"))).alias("hull2"), bubble.alias("bubble"))


@query(f"""SELECT page, p, id, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(y / 200.0), x DESC, p, id, y, h, ht) AS INT) AS reading, CAST(row_number() OVER (PARTITION BY page ORDER BY w * h DESC, p, id, y, h, ht) AS INT) AS by_area, CAST(row_number() OVER (PARTITION BY page ORDER BY y, x, p, id, h, ht) AS INT) AS by_place FROM ({_BOX})""")
def reading_order(spark, sf_dir):
    """Rows of 200 pixels from the right; by area; by place."""
    at = lambda *order: F.row_number().over(W.partitionBy("page").orderBy(*order, "p", "id", "y", "h", "ht"))
    return _boxes(spark, sf_dir).select("page", "p", "id", at(F.floor(C("y") / 200), F.desc("x")).alias("reading"), at((C("w") * C("h")).desc()).alias("by_area"), at("y", "x").alias("by_place"))


@query(f"""WITH b AS (SELECT page, p, id, x, y, h, lag(y) OVER o AS py, lag(h) OVER o AS ph FROM ({_BOX}) WINDOW o AS (PARTITION BY page ORDER BY y, x, p, id, h))
SELECT page, p, id, CAST(sum(CASE WHEN y > py + greatest(ph, h) * 0.6::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, x, p, id, h ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM b""")
def box_lines(spark, sf_dir):
    """Boxes whose tops are within 0.6 heights of the one before are a line."""
    rows = _boxes(spark, sf_dir)
    by = W.partitionBy("page").orderBy("y", "x", "p", "id", "h")
    starts = C("y") > F.lag("y").over(by) + F.greatest(F.lag("h").over(by), C("h")) * 0.6
    marked = rows.withColumn("s", F.coalesce(starts, F.lit(False)).cast("int"))
    return marked.select("page", "p", "id", F.sum("s").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("line"))


@query(f"""WITH b AS (SELECT page, p, id, x, y AS y0, y + h AS y1 FROM ({_BOX})), g AS (SELECT *, y0 - lag(y1) OVER o AS gap FROM b WINDOW o AS (PARTITION BY page ORDER BY y0, x, p, id, y1)),
m AS (SELECT page, coalesce(median(y1 - y0) FILTER (WHERE y1 > y0), 20.0) AS height, coalesce(median(greatest(0, gap)) FILTER (WHERE gap IS NOT NULL), 0.0) AS mid, list_sort(list(x))[count(*) // 10 + 1] AS base FROM g GROUP BY page)
SELECT g.page, p, id, CAST(sum(CASE WHEN gap IS NOT NULL AND (gap > greatest(mid * 1.8::DOUBLE, height * 0.55::DOUBLE) OR x - base > height * 1.2::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY g.page ORDER BY y0, x, p, id, y1 ROWS UNBOUNDED PRECEDING) AS INT) AS para FROM g JOIN m ON g.page = m.page""")
def line_paragraphs(spark, sf_dir):
    """Lines of a page to paragraphs: a wide gap or an indent begins one."""
    rows = _boxes(spark, sf_dir).select("page", "p", "id", "x", C("y").alias("y0"), (C("y") + C("h")).alias("y1"))
    return V.line_paragraphs(rows, "page", ["y0", "x", "p", "id", "y1"]).select("page", "p", "id", "para")


@query("""SELECT user_id, event_id, CASE WHEN dt > 0 THEN greatest(0.0, least(100.0, 100 * (1 - di / dt))) END AS busy FROM (SELECT user_id, event_id, CAST(event_id - lag(event_id) OVER o AS DOUBLE) AS dt, value - lag(value) OVER o AS di FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))""")
def cpu_delta(spark, sf_dir):
    by = W.partitionBy("user_id").orderBy("event_id")
    total, idle = (C("event_id") - F.lag("event_id").over(by)).cast("double"), C("value") - F.lag("value").over(by)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", total.alias("dt"), idle.alias("di"))
    return rows.select("user_id", "event_id", F.when(C("dt") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - C("di") / C("dt"))))).alias("busy"))


@query("""SELECT conv_id, min(turn) FILTER (WHERE turn // 2 > 2) AS first_after, arg_max(turn, struct_pack(n := length(text), t := -turn)) FILTER (WHERE turn BETWEEN 1 AND 6) AS brightest FROM conversations GROUP BY conv_id""")
def first_and_brightest(spark, sf_dir):
    """The first paragraph past a page; of the rows of a band the greatest, the first of equals."""
    rows = read(spark, sf_dir, "conversations")
    own = F.when(C("turn").between(1, 6), F.struct(F.length("text").alias("n"), (-C("turn")).alias("t")))
    return rows.groupBy("conv_id").agg(F.min(F.when(F.expr("turn div 2") > 2, C("turn"))).alias("first_after"), (-F.max(own)["t"]).alias("brightest"))


@query("SELECT p_partkey, k - 1 AS part, p_size * 10 + CAST(floor((k - 1) * (p_size / 3.0::DOUBLE)) AS BIGINT) AS y0, p_size * 10 + CAST(floor(k * (p_size / 3.0::DOUBLE)) AS BIGINT) AS y1 FROM part, range(1, 4) r(k)")
def even_split(spark, sf_dir):
    """A band in three equal parts."""
    step = C("p_size") / 3.0
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("part"))
    at = lambda k: C("p_size").cast("long") * 10 + F.floor(k * step)
    return rows.select("p_partkey", "part", at(C("part")).alias("y0"), at(C("part") + 1).alias("y1"))


# --- joins ------------------------------------------------------------------------------------------------------

_FONTS = [("a", 5, 1), ("b", 20, 3), ("c", 40, 5), ("d", 28, 2), ("e", 11, 6)]


@query(f"""SELECT p_partkey, b AS font, CAST(rn AS INT) AS rank FROM (SELECT p.p_partkey, f.b, row_number() OVER (PARTITION BY p.p_partkey ORDER BY 3 * abs(p.p_size - f.t) + abs(p.p_size % 7 - f.c), f.b) AS rn FROM part p, (VALUES {', '.join(map(str, _FONTS))}) f(b, t, c)) WHERE rn <= 3""")
def nearest_fonts(spark, sf_dir):
    """The three nearest of the fonts that are known, a list of a few rows that stands in each row."""
    size = C("p_size")
    ranked = F.slice(F.array_sort(F.array(*[F.struct((3 * F.abs(size - t) + F.abs(size % 7 - c)).alias("d"), F.lit(b).alias("b")) for b, t, c in _FONTS])), 1, 3)
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(ranked).alias("pos", "f")).select("p_partkey", C("f.b").alias("font"), (C("pos") + 1).alias("rank"))


@query("""SELECT a.conv_id, a.turn, md5(a.text) AS text, b.role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 0) b ON a.conv_id = b.conv_id AND a.n = b.n""")
def zip_truncated(spark, sf_dir):
    """Two lists side by side, as far as the shorter goes."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations")
    a, b = rows.withColumn("n", at).select("conv_id", "n", "turn", F.md5("text").alias("text")), rows.filter("turn % 3 <> 0").withColumn("n", at).select("conv_id", "n", "role")
    return a.join(b, ["conv_id", "n"]).select("conv_id", "turn", "text", "role")


@query("""SELECT user_id, list_sort(list_distinct(list(event_id // 100))) <> list_sort(list_distinct(list((event_id + CASE WHEN user_id % 2 = 0 THEN 0 ELSE value::BIGINT % 2 END) // 100))) AS changed FROM events GROUP BY user_id""")
def bookmarks_changed(spark, sf_dir):
    """Bookmarks are taken over only if the sorted sets differ."""
    other = F.when(C("user_id") % 2 == 0, C("event_id")).otherwise(C("event_id") + F.expr("cast(bround(value) as bigint) % 2"))
    rows = read(spark, sf_dir, "events").select("user_id", F.expr("event_id div 100").alias("a"), F.floor(other / 100).alias("b"))
    return rows.groupBy("user_id").agg((F.array_sort(F.collect_set("a")) != F.array_sort(F.collect_set("b"))).alias("changed"))


_SPANS = "SELECT conv_id AS book, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN turn % 7 <> 6 THEN turn // 2 END AS s, CASE WHEN turn % 7 <> 6 THEN (turn + turn % 3) // 2 END AS e FROM conversations"


@query(f"""WITH p AS ({_SPANS}), g AS (SELECT book, coalesce(max(e), 0) AS last, count(*) AS n FROM p GROUP BY book), li AS (SELECT book, n, unnest(generate_series(0, last)) AS li FROM g),
k AS (SELECT li.book, li.li, li.n, p.idx, coalesce(p.s, li.li) AS s, coalesce(p.e, li.li) AS e FROM li JOIN p ON li.book = p.book),
a AS (SELECT book, li, least(min(s), li) AS q, greatest(max(e), li) AS r, min(idx) AS first, max(idx) + 1 AS past FROM k WHERE s <= li AND li <= e GROUP BY book, li),
w AS (SELECT k.book, k.li, k.n, a.q, a.r, a.first, a.past, min(k.idx) FILTER (WHERE k.idx >= a.past AND k.s > a.r) AS stop, min(k.idx) FILTER (WHERE k.s > k.li) AS later FROM k LEFT JOIN a ON k.book = a.book AND k.li = a.li GROUP BY ALL)
SELECT book, CAST(li AS BIGINT) AS page, CAST(coalesce(q, li) AS BIGINT) AS q, CAST(coalesce(r, li) AS BIGINT) AS r, CAST(CASE WHEN first IS NULL THEN coalesce(later, n) ELSE first END AS BIGINT) AS s, CAST(CASE WHEN first IS NULL THEN coalesce(later, n) ELSE coalesce(stop, n) END AS BIGINT) AS e FROM w""")
def rescan_windows(spark, sf_dir):
    """For each page the paragraphs that touch it and those that begin within their pages; where there are none, the place to insert at."""
    by = W.partitionBy("conv_id").orderBy("turn")
    known = C("turn") % 7 != 6
    paras = read(spark, sf_dir, "conversations").select(C("conv_id").alias("book"), (F.row_number().over(by) - 1).cast("long").alias("idx"), F.when(known, F.expr("turn div 2")).alias("s"), F.when(known, F.expr("(turn + turn % 3) div 2")).alias("e"))
    return V.rescan_windows(paras)


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS k FROM n WHERE n BETWEEN 3 AND 12)
SELECT source, doc_id, k <= 4 AS within_limit, n = least(greatest(15, 1), total) AS sample FROM r WHERE k <= 4 UNION ALL SELECT source, doc_id, false, true FROM n WHERE n = least(greatest(15, 1), total) AND NOT n BETWEEN 3 AND 6""")
def limit_and_sample(spark, sf_dir):
    """A limit counts inside the page range; a sample page is held within the book."""
    return V.limited(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "3-12", 4, 15)


# --- pages and replies ------------------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def _is_heading(x: str) -> str:
    plain = f"{x} <> '' AND length({x}) <= 60 AND NOT contains('{T.SENTENCE_END}', right({x}, 1))"
    return f"(starts_with({x}, '## ') OR ({plain} AND (regexp_matches({x}, '{T.CHAPTER}') OR regexp_matches({x}, '{T.CHAPTER_JA}') OR (length({x}) <= 30 AND {x} = upper({x}) AND {x} <> lower({x})))))"


def _joined(a: str, b: str) -> str:
    return f"""CASE WHEN ends_with(rtrim({a}), '-') AND NOT ends_with(rtrim({a}), ' -') THEN left(rtrim({a}), length(rtrim({a})) - 1) || {b}
 WHEN regexp_matches(right(rtrim({a}), 1), '{T.CJK}') AND regexp_matches(left({b}, 1), '{T.CJK}') THEN rtrim({a}) || {b} ELSE rtrim({a}) || ' ' || {b} END"""


_LINES = f"list_filter(list_transform(string_split(p, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
_PIECES = f"""SELECT book, page, j, list_reduce({_LINES}, lambda a, b: {_joined('a', 'b')}) AS piece FROM (
 SELECT book, page, p, row_number() OVER (PARTITION BY book, page ORDER BY pos) - 1 AS j FROM (
  SELECT source AS book, doc_id AS page, unnest(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), 1) AS pos FROM documents) WHERE {_strip('p')} <> '')"""


@query(f"""WITH RECURSIVE piece AS ({_PIECES}), pages AS (SELECT source AS book, count(*) AS pages FROM documents GROUP BY source),
heads AS (SELECT book, lower(piece) AS head FROM piece JOIN pages USING (book) WHERE j = 0 AND length(piece) <= 60 GROUP BY book, lower(piece), pages HAVING count(*) >= greatest(3, pages // 10)),
kept AS (SELECT book, page, piece, row_number() OVER (PARTITION BY book ORDER BY page, j) AS n FROM piece WHERE piece <> '' AND NOT regexp_matches(piece, '{T.PAGE_NUMBER}') AND NOT (j = 0 AND EXISTS (SELECT 1 FROM heads h WHERE h.book = piece.book AND h.head = lower(piece.piece)))),
f AS (SELECT book, n, 0 AS idx, piece AS text, page, page AS page_end FROM kept WHERE n = 1 UNION ALL
 SELECT book, n, idx + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN {_joined('text', 'piece')} ELSE piece END, CASE WHEN joins THEN page ELSE now END, now FROM (
  SELECT k.book, k.n, f.idx, f.text, f.page, k.page AS now, k.piece, NOT {_is_heading('f.text')} AND NOT {_is_heading('k.piece')} AND NOT contains('{T.SENTENCE_END}', right(rtrim(f.text), 1)) AS joins FROM f JOIN kept k ON k.book = f.book AND k.n = f.n + 1))
SELECT book, CAST(idx AS INT) AS idx, md5(arg_max(text, n)) AS text, any_value(page) AS page, max(page_end) AS page_end FROM f GROUP BY book, idx""")
def merge_page_spans(spark, sf_dir):
    """Books of sources, pages of documents; a full stop at a line's end ends a paragraph."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    pages = dealt(spark, docs(spark, sf_dir, "source", "doc_id", "text")).select("source", "doc_id", text.alias("text"))
    return O.merge_page_spans(pages, "source", "doc_id", "text").select("book", "idx", F.md5("text").alias("text"), "page", "page_end")


@query(f"""WITH RECURSIVE kept AS (SELECT doc_id, p AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT doc_id, pos, {_strip('line')} AS p FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE p <> '' AND NOT regexp_matches(p, '{T.PAGE_NUMBER}')),
f AS (SELECT doc_id, n, 0 AS idx, piece AS text FROM kept WHERE n = 1 UNION ALL
 SELECT doc_id, n, idx + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN {_joined('text', 'piece')} ELSE piece END FROM (
  SELECT k.doc_id, k.n, f.idx, f.text, k.piece, NOT {_is_heading('f.text')} AND NOT {_is_heading('k.piece')} AND NOT contains('{T.SENTENCE_END}', right(rtrim(f.text), 1)) AS joins FROM f JOIN kept k ON k.doc_id = f.doc_id AND k.n = f.n + 1))
SELECT doc_id, CAST(idx AS INT) AS idx, md5(arg_max(text, n)) AS text FROM f GROUP BY doc_id, idx""")
def merge_paragraphs(spark, sf_dir):
    """The lines of each document as pieces."""
    rows = lines(spark, sf_dir).withColumn("line", T.strip(C("line"))).filter((C("line") != "") & ~T.is_page_number(C("line")))
    return O.merge_paragraphs(rows, "doc_id", "pos", "line").select("doc_id", "idx", F.md5("text").alias("text"))


@query()
def repair_json(spark, sf_dir):
    """Replies with quotes and line ends inside of their strings; a test holds them against the texts they were made of."""
    turn = C("turn").cast("string")
    raw = F.concat(F.lit('<think>so</think>```json\n[{"id": '), turn, F.lit(', "text": "er sagte "'), "role", F.lit('" und\n'), F.replace(F.replace("text", F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'")), F.lit('"},]\n```'))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(Y.parsed(raw), F.lit(0)).alias("r")).select("conv_id", "turn", C("r.id").alias("id"), F.md5("r.text").alias("text"))


@query()
def overlap_suppress(spark, sf_dir):
    """Boxes of a page by area, without those that lie in the kept ones; a test holds them against a plain loop."""
    rows = _boxes(spark, sf_dir).select("page", (C("p") * 10 + C("id")).alias("id"), "x", "y", "w", "h")
    return V.overlap_suppressed(rows, "page").select("page", "id", "kept")


@query()
def epub_bytes(spark, sf_dir):
    """A book of each conversation, a chapter for each role; a test opens them."""
    paras = read(spark, sf_dir, "conversations")
    return K.epubs(paras, "conv_id", "role", "turn", "text").select("book", F.length("epub").alias("size"), F.md5("epub").alias("epub"))


_DONE = "CASE doc_id % 4 WHEN 0 THEN '## T' || doc_id WHEN 1 THEN '' WHEN 2 THEN 'a  \"b\" ' || doc_id END"
_SHOWN = f"CASE WHEN starts_with({_strip('x')}, '## ') THEN ltrim(substr({_strip('x')}, 4)) ELSE {_strip('x')} END"


_BARE = "regexp_replace(t, '(?m)^[ \\t　]*(?:>>|＞＞)\\s+', '', 'g')"
for _mark in (r"\*\*", "~~", r"\+\+", r"\*"):
    _BARE = f"regexp_replace({_BARE}, '(?s){_mark}(.+?){_mark}', '\\1', 'g')"


@query(f"""WITH p AS (SELECT source, doc_id, n_chars % 11 = 0 AS head, {_SHOWN} AS t FROM (SELECT *, coalesce(nullif({_DONE}, ''), left(text, 50)) AS x FROM documents)),
r AS (SELECT *, row_number() OVER w AS n, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS INT) AS k FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT source, k, count(*) AS n, min(n) - 1 AS start, CASE WHEN k > 0 THEN arg_min(t, n) ELSE '' END AS label, md5(string_agg({_BARE}, chr(10) || chr(10) ORDER BY n)) AS plain FROM r GROUP BY source, k),
g AS (SELECT source, sum(n) AS total, max(k) AS heads, coalesce(max(n) FILTER (WHERE k = 0), 0) AS before FROM c GROUP BY source), u AS (SELECT *, before > 0 AND (heads = 0 OR before > 0.2 * total) AS untitled FROM g)
SELECT c.source, CAST(k + CASE WHEN untitled THEN 1 ELSE 0 END AS INT) AS chapter, label, start, n, plain FROM c JOIN u ON c.source = u.source WHERE k > 0 OR untitled""")
def export_chapters(spark, sf_dir):
    """A book's export by chapter: translations where there are some, else the source, without headings' marks; chapters begin at headed paragraphs."""
    k = C("doc_id") % 4
    done = F.when(k == 0, F.concat(F.lit("## T"), C("doc_id").cast("string"))).when(k == 1, "").when(k == 2, F.concat(F.lit('a  "b" '), C("doc_id").cast("string")))
    shown = T.without_mark(F.coalesce(F.nullif(done, F.lit("")), F.left("text", F.lit(50))))
    paras = docs(spark, sf_dir, "source", "doc_id", "n_chars", "text").select("source", "doc_id", (C("n_chars") % 11 == 0).alias("head"), shown.alias("t"))
    return A.sliced(paras, "source", "doc_id", "head", "t").select(C("book").alias("source"), C("k").alias("chapter"), "label", "start", "n", F.md5("plain").alias("plain"))


@query()
def epub_parts(spark, sf_dir):
    """A book of each conversation, a chapter for each role, as parts of its archive; a test puts them together and opens them."""
    conv = read(spark, sf_dir, "conversations")
    first = conv.groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("at"))  # a book's chapters, not its paragraphs
    chapters = A.chapter_html(conv, ["conv_id", "role"], "turn", "text").join(first.withColumn("k", k), ["conv_id", "role"]).select(C("conv_id").alias("book"), "k", C("role").alias("label"), "html")
    titles = conv.select(C("conv_id").alias("book"), F.concat(F.lit("Book "), C("conv_id").cast("string")).alias("title")).distinct()
    return A.archive_parts(A.book_members(chapters, titles)).select("book", C("ord").cast("int").alias("part"), F.length("bytes").alias("size"), F.md5("bytes").alias("digest"))


# --- books and requests -----------------------------------------------------------------------------------------


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS text FROM conversations GROUP BY conv_id")
def book_text(spark, sf_dir):
    """A book as one text: paragraphs parted by blank lines, and a line's end."""
    own = F.array_join(F.transform(O.in_order("turn", "text"), lambda r: r["text"]), "\n\n")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.concat(own, F.lit("\n"))).alias("text"))


_PATH = "'scan/' || page_id || ['.PNG', '.jpg', '.txt', '.webp', ''][CAST(page_id % 5 AS INT) + 1]"


@query(f"SELECT page_id, path, CAST(row_number() OVER (ORDER BY path) AS INT) AS n FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE list_contains(['.png', '.jpg', '.webp'], lower(regexp_extract(path, '\\.[^.]+$'))) QUALIFY n BETWEEN 3 AND 20")
def page_files(spark, sf_dir):
    """Files with a page's ending, in order of their names, of a range of pages. The range's end alone is sorted whole, as a top list."""
    first, last = V.page_range("3-20")
    path = F.concat(F.lit("scan/"), C("page_id").cast("string"), pick([".PNG", ".jpg", ".txt", ".webp", ""], C("page_id")))
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(F.lower(F.regexp_extract("path", r"\.[^.]+$", 0)).isin(".png", ".jpg", ".webp"))
    return rows.orderBy("path").limit(last).withColumn("n", F.row_number().over(W.orderBy("path"))).filter(C("n") >= first)


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'changed' END AS push FROM (SELECT page_id, md5(html) AS now, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN md5(html) ELSE md5(html || ' ') END AS pushed FROM pages) WHERE now IS DISTINCT FROM pushed")
def push_changes(spark, sf_dir):
    """What has to be pushed: pages whose digest is not the one that was pushed last."""
    now = read(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("now"), F.md5(F.concat("html", F.lit(" "))).alias("other"))
    pushed = now.filter("page_id % 4 <> 0").select("page_id", F.when(C("page_id") % 3 == 0, C("now")).otherwise(C("other")).alias("pushed"))
    both = now.join(pushed, "page_id", "left").filter(~C("now").eqNullSafe(C("pushed")))
    return both.select("page_id", F.when(C("pushed").isNull(), "new").otherwise("changed").alias("push"))


@query("""WITH l AS (SELECT conv_id, list(role || turn % 4 ORDER BY turn) AS old, list(role || (CASE WHEN turn = conv_id % 5 + 1 THEN 9 ELSE turn % 4 END) ORDER BY turn) AS new FROM conversations GROUP BY conv_id),
p AS (SELECT *, len(old) AS n, coalesce(list_min(list_filter(range(len(old)), lambda i: old[i + 1] <> new[i + 1])), len(old)) AS head, coalesce(list_min(list_filter(range(len(old)), lambda i: old[len(old) - i] <> new[len(old) - i])), len(old)) AS tail FROM l)
SELECT conv_id, CAST(head AS INT) AS head, CAST(least(tail, n - head) AS INT) AS tail FROM p""")
def window_edges(spark, sf_dir):
    """Of a window that is replaced, how many paragraphs stay as they are at its head, and at its tail."""
    rows = read(spark, sf_dir, "conversations")
    changed = F.when(C("turn") == C("conv_id") % 5 + 1, 9).otherwise(C("turn") % 4)
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", (C("turn") % 4).cast("string")).alias("old"), F.concat("role", changed.cast("string")).alias("new")))).alias("rows"))
    same = lambda side: F.coalesce(F.array_position(F.transform(side, lambda r: r["old"] != r["new"]), True), F.lit(0))
    n = F.size("rows")
    edge = lambda side: F.when(same(side) == 0, n).otherwise(same(side) - 1).cast("int")
    head = edge(C("rows"))
    return lists.select("conv_id", head.alias("head"), F.least(edge(F.reverse("rows")), n - head).alias("tail"))


_CHUNKED = """WITH RECURSIVE r AS (SELECT conv_id, turn, role, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), f AS (SELECT conv_id, turn, rn, 0 AS chunk, n AS total FROM r WHERE rn = 1 UNION ALL
 SELECT r.conv_id, r.turn, r.rn, CASE WHEN f.total >= 300 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total >= 300 THEN r.n ELSE f.total + r.n END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)"""


@query(f"""{_CHUNKED}, c AS (SELECT f.conv_id, f.chunk, arg_max(r.text, r.turn) FILTER (WHERE r.turn % 3 <> 2) AS src, arg_max('T ' || r.role, r.turn) FILTER (WHERE r.turn % 3 <> 2) AS tr FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn GROUP BY f.conv_id, f.chunk)
SELECT conv_id, CAST(chunk AS INT) AS chunk, md5(right(last_value(src IGNORE NULLS) OVER w, 300)) AS src, right(last_value(tr IGNORE NULLS) OVER w, 300) AS tr FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chunk_context(spark, sf_dir):
    """What a chunk is told of what stands before: the ends of the last source and translation of the last chunk that has one."""
    rows = read(spark, sf_dir, "conversations")
    chunks = O.greedy_chunks(rows.select("conv_id", "turn", F.length("text").alias("n")), "conv_id", "turn", "n", 300).select("conv_id", "turn", "chunk")
    done = F.when(C("turn") % 3 != 2, F.struct("turn", C("text").alias("src"), F.concat(F.lit("T "), "role").alias("tr")))
    last = rows.join(chunks, ["conv_id", "turn"]).groupBy("conv_id", "chunk").agg(F.max_by(done, done["turn"]).alias("d"))
    by = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = last.withColumn("b", F.last("d", ignorenulls=True).over(by))
    return before.select("conv_id", "chunk", F.md5(F.right("b.src", F.lit(300))).alias("src"), F.right("b.tr", F.lit(300)).alias("tr"))


@query("""SELECT conv_id, CAST(b AS INT) AS batch, printf('p%04d-a-%03d', conv_id, b) AS custom_id, md5(string_agg('[' || k || '] ' || text, chr(10) ORDER BY k)) AS body FROM (
 SELECT conv_id, text, (rn - 1) // 6 AS b, (rn - 1) % 6 + 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)) GROUP BY conv_id, b""")
def request_blocks(spark, sf_dir):
    """Requests of six numbered blocks each."""
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").withColumn("rn", rn).select("conv_id", "text", F.expr("(rn - 1) div 6").cast("int").alias("batch"), ((C("rn") - 1) % 6 + 1).alias("k"))
    block = F.struct("k", F.concat(F.lit("["), C("k").cast("string"), F.lit("] "), "text").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda r: r["t"]), "\n")
    return rows.groupBy("conv_id", "batch").agg(F.md5(body).alias("body")).select("conv_id", "batch", F.format_string("p%04d-a-%03d", "conv_id", "batch").alias("custom_id"), "body")


@query(f"""SELECT page, CAST(count(*) FILTER (WHERE text <> '' AND round(q / 1000, 3) > 0.03) AS BIGINT) AS warned, CAST(count(*) FILTER (WHERE text <> '') AS BIGINT) AS retyped FROM ({_ENTRY}) GROUP BY page""")
def overlap_warnings(spark, sf_dir):
    """Texts that were set again, and those of them over 0.03 of whose ink lies on dark ground."""
    set_ = C("text") != ""
    return _entries(spark, sf_dir).groupBy("page").agg(F.count_if(set_ & (F.round(C("q") / 1000, 3) > 0.03)).alias("warned"), F.count_if(set_).alias("retyped"))


@query("""SELECT page_id, CASE WHEN n >= 1 << 30 THEN format('{:.2f} GB', n / (1 << 30)::DOUBLE) ELSE format('{:.1f} MB', n / (1 << 20)::DOUBLE) END AS size, CASE WHEN page_id % 2 = 0 THEN 'Kapitel ' || page_id ELSE '#Kapitel' END AS title FROM (
 SELECT page_id, CASE WHEN page_id % 5 = 0 THEN (page_id % 900 + 4) * (1 << 28)::BIGINT ELSE (page_id * 3 % 900 + 1) * (1 << 19)::BIGINT END AS n FROM pages)""")
def size_labels(spark, sf_dir):
    """Sizes as they are shown, and titles without a heading's mark."""
    k = C("page_id")
    n = F.when(k % 5 == 0, (k % 900 + 4) * (1 << 28)).otherwise((k * 3 % 900 + 1) * (1 << 19))
    title = F.when(k % 2 == 0, F.concat(F.lit(" ## Kapitel "), k.cast("string"))).otherwise("#Kapitel")
    return read(spark, sf_dir, "pages").select("page_id", T.size_label(n).alias("size"), T.without_mark(title).alias("title"))


_ROUTES = ["remote-a", "remote-b:2", "ollama:z", "tesseract", "Windows", ""]


@query(f"""SELECT event_id, engine IN ('tesseract', 'easyocr', 'windows') AS local_ocr, starts_with(engine, 'ollama:') AS local_model, engine <> '' AND engine NOT IN ('tesseract', 'easyocr', 'windows') AND NOT starts_with(engine, 'ollama:') AS needs_key FROM (SELECT event_id, lower({pick_sql(_ROUTES, 'event_id')}) AS engine FROM events)""")
def engine_routes(spark, sf_dir):
    """Engines that read here, models that run here, and those that need a key."""
    engine = pick(_ROUTES, C("event_id"))
    return read(spark, sf_dir, "events").select("event_id", R.is_local_reader(engine).alias("local_ocr"), R.is_local_model(engine).alias("local_model"), R.needs_key(engine).alias("needs_key"))
