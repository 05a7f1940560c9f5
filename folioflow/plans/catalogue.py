"""The registered queries over the driver's tables, each beside the SQL that gives the same rows.

Books are sources, pages are documents in order of doc_id, paragraphs are lines. Tables of fewer splits than cores are dealt out right after the scan, others are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import ordered as O
from folioflow.operators import review as R
from folioflow.operators import runs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return read(spark, sf_dir, "documents").select(*columns)


def dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as it is scanned; a scan of fewer splits than cores, as of one small file, is dealt over all of them."""
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def listing(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- text -----------------------------------------------------------------------------------------------------


_LANG = f"""
SELECT doc_id, lang, CASE WHEN ja >= 5 AND ja >= greatest(de, en) // 3 THEN 'ja' WHEN de >= en THEN 'de' ELSE 'en' END AS detected, CAST(ja AS INT) AS ja, CAST(de AS INT) AS de, CAST(en AS INT) AS en FROM (
 SELECT doc_id, lang, len(regexp_extract_all(low, '{T.KANA}')) AS ja,
  len(list_filter(w, lambda x: x IN ({listing(T.DE_WORDS)}))) + 3 * least(30, len(regexp_extract_all(low, '{T.UMLAUTS}'))) AS de,
  len(list_filter(w, lambda x: x IN ({listing(T.EN_WORDS)}))) AS en
 FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-zäöüß]+')[1:1000] AS w FROM documents))
"""


@query(_LANG)
def detect_lang(spark, sf_dir):
    rows = dealt(spark, docs(spark, sf_dir, "doc_id", "lang", "text"))
    ja, de, en = T.language_scores(F.col("text"))
    rows = rows.select("doc_id", "lang", ja.alias("ja"), de.alias("de"), en.alias("en"))
    return rows.withColumn("detected", T.language(F.col("ja"), F.col("de"), F.col("en")))


@query(f"SELECT doc_id, md5(translate(text, '{T.TO_SPACE}{T.TO_NOTHING}', '{' ' * len(T.TO_SPACE)}')) AS cleaned FROM documents")
def clean_ws(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.md5(T.clean_spaces(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), chr(10))) AS normal FROM documents")
def norm_text(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.md5(T.strip_lines(F.col("text"))).alias("normal"))


_LINES = "SELECT doc_id, source, pos - 1 AS pos, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


def lines(spark, sf_dir):
    rows = dealt(spark, docs(spark, sf_dir, "doc_id", "source", "text"))
    return rows.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@query(rf"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT regexp_matches(line, '{T.PAGE_NUMBER}')) AS BIGINT) AS n_kept FROM ({_LINES}) GROUP BY doc_id")
def pagenum_drop(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~T.is_page_number(F.col("line"))).alias("n_kept"))


_END = T.SENTENCE_END
_HEADING = rf"""(starts_with(s, '## ') OR (s <> '' AND length(s) <= 60 AND NOT contains('{_END}', right(s, 1))
 AND (regexp_matches(s, '{T.CHAPTER}') OR regexp_matches(s, '{T.CHAPTER_JA}') OR (length(s) <= 30 AND s = upper(s) AND s <> lower(s)))))"""
_STRIP = "trim(line, ' ' || chr(9) || chr(13) || chr(160))"


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, s AS heading FROM (SELECT doc_id, pos, {_STRIP} AS s FROM ({_LINES})) WHERE {_HEADING}")
def heading_flag(spark, sf_dir):
    return lines(spark, sf_dir).filter(T.is_heading(F.col("line"))).select("doc_id", "pos", T.strip(F.col("line")).alias("heading"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t　]*(?:>>|＞＞)\s+', '', 'g'),
 '(?s)\*\*(.+?)\*\*', '\1', 'g'), '(?s)~~(.+?)~~', '\1', 'g'), '(?s)\+\+(.+?)\+\+', '\1', 'g'), '(?s)\*(.+?)\*', '\1', 'g')) AS plain FROM documents""")
def strip_inline(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.md5(T.strip_inline(F.col("text"))).alias("plain"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
 '(?s)\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '(?s)~~(.+?)~~', '<s>\1</s>', 'g'), '(?s)\+\+(.+?)\+\+', '<u>\1</u>', 'g'), '(?s)\*(.+?)\*', '<em>\1</em>', 'g')) AS tagged FROM documents""")
def inline_tags(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.md5(T.inline_tags(F.col("text"))).alias("tagged"))


def _html_sql(x: str) -> str:
    """Exported lines: what stands before a line of text is a break if the line before it is one of text too."""
    tagged = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        tagged = f"replace({tagged}, '{a}', '{b}')"
    for mark, tag in ((r"\*\*", "strong"), ("~~", "s"), (r"\+\+", "u"), (r"\*", "em")):
        tagged = f"regexp_replace({tagged}, '(?s){mark}(.+?){mark}', '<{tag}>\\1</{tag}>', 'g')"
    right = "^[ \\t　]*(?:&gt;&gt;|＞＞)[\\s　]+"
    kinds = f"list_transform(l, lambda x: CASE WHEN regexp_matches(x, '{right}') THEN 'r' WHEN {_STRIP.replace('line', 'x')} = '' THEN 'b' ELSE 't' END)"
    span = '<span style="display:block;text-align:right;text-indent:0">'
    shown = f"CASE k[i] WHEN 'r' THEN '{span}' || ltrim(regexp_replace(l[i], '{right}', '')) || '</span>' WHEN 'b' THEN '<br/><br/>' ELSE CASE WHEN i > 1 AND k[i - 1] = 't' THEN '<br/>' ELSE '' END || l[i] END"
    # There is no look-ahead here: a space before another one is marked until none is left; three times do for the runs in these texts.
    spaced = tagged
    for _ in range(3):
        spaced = f"replace({spaced}, '  ', '&#160; ')"
    return f"SELECT doc_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: {shown}), '')) AS html FROM (SELECT *, {kinds} AS k FROM (SELECT doc_id, string_split({spaced}, chr(10)) AS l FROM (SELECT doc_id, {_RAW} AS t FROM documents)))"


_RAW = "replace(replace(text, '. ', '.   '), chr(10), chr(10) || '>> \"a\" & ' || chr(39) || 'b' || chr(39) || chr(10) || ' ' || chr(10))"


@query(_html_sql("t"))
def inline_html(spark, sf_dir):
    """Paragraphs as they are exported; runs of spaces, marked and blank lines and quotes are put into the texts."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".   ")), F.lit("\n"), F.lit("\n>> \"a\" & 'b'\n \n"))
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.md5(T.inline_html(text)).alias("html"))


@query(rf"""SELECT page_id, md5(translate(trim(regexp_replace(regexp_replace(html, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '{T.TO_SPACE}{T.TO_NOTHING}', '{' ' * len(T.TO_SPACE)}')) AS text,
 md5(translate(trim(regexp_replace(html, '[ \t]*\n[ \t]*\n+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '{T.TO_SPACE}{T.TO_NOTHING}', '{' ' * len(T.TO_SPACE)}')) AS source FROM pages""")
def clean_text(spark, sf_dir):
    rows = dealt(spark, read(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.md5(T.clean_text(F.col("html"))).alias("text"), F.md5(T.clean_source(F.col("html"))).alias("source"))


@query(r"""SELECT event_id, CAST(json_extract(regexp_replace('[{"id":' || event_id || ',"props":' || props || ',},]', ',\s*([\]}])', '\1', 'g'), '$[0].props.k') AS BIGINT) AS k FROM events""")
def json_repair_light(spark, sf_dir):
    raw = F.concat(F.lit('[{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit(",},]"))
    parsed = F.from_json(T.without_commas_at_ends(raw), "array<struct<id:long,props:struct<k:long>>>")
    return read(spark, sf_dir, "events").select("event_id", F.get(parsed, F.lit(0))["props"]["k"].alias("k"))


@query(r"SELECT conv_id, turn, regexp_replace('<think>' || role || '</think>[' || text || ']<think>rest', '(?s)<think>.*?(</think>|$)', '', 'g') AS answer, length(regexp_extract('x [' || text || '] y', '(?s)\[.*\]')) AS widest FROM conversations")
def think_strip(spark, sf_dir):
    raw = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>["), F.col("text"), F.lit("]<think>rest"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_thoughts(raw).alias("answer"), F.length(T.widest_list(F.concat(F.lit("x ["), F.col("text"), F.lit("] y")))).cast("long").alias("widest"))


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN len(regexp_extract_all(text, '[가-힣]')) / length(regexp_replace(text, '\s', '', 'g')) ELSE 0.0 END AS ratio FROM documents")
def hangul_ratio(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", T.hangul_ratio(F.col("text")).alias("ratio"))


@query("""SELECT p_partkey, printf('p%04d', p_partkey + 1) AS label, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '-', 'g'), '-') AS slug,
 CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1200 THEN 'medium' ELSE 'low' END AS confidence FROM part""")
def labels_and_slugs(spark, sf_dir):
    price = F.col("p_retailprice")
    slug = F.btrim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9_]+", "-"), F.lit("-"))
    return read(spark, sf_dir, "part").select("p_partkey", T.page_label(F.col("p_partkey")).alias("label"), slug.alias("slug"), F.when(price >= 1500, "high").when(price >= 1200, "medium").otherwise("low").alias("confidence"))


# --- aggregates -------------------------------------------------------------------------------------------------

_HEADS = f"""SELECT source, lower(h) AS head, count(*) AS n FROM (SELECT source, doc_id, arg_min({_STRIP}, pos) AS h FROM ({_LINES}) WHERE {_STRIP} <> '' GROUP BY ALL) WHERE length(h) <= 60 GROUP BY ALL"""
_REPEATED = f"SELECT h.source, h.head, CAST(h.n AS BIGINT) AS n FROM ({_HEADS}) h JOIN (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source) p ON h.source = p.source WHERE h.n >= greatest(3, p.pages // 10)"


def _heads(spark, sf_dir):
    """First non-blank line of each page; the aggregate over (pos, line) is partial before its shuffle."""
    rows = lines(spark, sf_dir).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    return rows.groupBy("source", "doc_id").agg(F.min_by("line", "pos").alias("h"))


def _repeated(spark, sf_dir):
    heads = _heads(spark, sf_dir).filter(F.length("h") <= 60).groupBy("source", F.lower("h").alias("head")).agg(F.count(F.lit(1)).alias("n"))
    pages = docs(spark, sf_dir, "source", "doc_id").groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    return heads.join(pages, "source").filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 10))).select("source", "head", "n")


@query(_REPEATED)
def repeated_heads(spark, sf_dir):
    return _repeated(spark, sf_dir)


@query(f"""WITH r AS ({_REPEATED}), h AS (SELECT source, doc_id, min(pos) AS first FROM ({_LINES}) WHERE {_STRIP} <> '' GROUP BY ALL)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_kept FROM ({_LINES}) l JOIN h ON l.doc_id = h.doc_id
WHERE trim(l.line, ' ' || chr(9) || chr(13) || chr(160)) <> '' AND NOT (l.pos = h.first AND EXISTS (SELECT 1 FROM r WHERE r.source = l.source AND r.head = lower(trim(l.line, ' ' || chr(9) || chr(13) || chr(160))))) GROUP BY l.doc_id""")
def drop_repeated_heads(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    pages = rows.groupBy("source", "doc_id").agg(F.min_by("line", "pos").alias("h"), F.count(F.lit(1)).alias("n"))
    hit = _repeated(spark, sf_dir).select("source", "head", F.lit(1).alias("gone"))
    kept = pages.join(hit, (pages.source == hit.source) & (F.lower(F.col("h")) == F.col("head")), "left")
    return kept.select("doc_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n_kept")).filter("n_kept > 0")


_MONEY = "CAST(floor(value * 10) AS BIGINT)"
_CALLS = f"SELECT event_type AS part, ['swift-lite', 'swift', 'local:x', 'unknown', ''][CAST(user_id % 5 AS INT) + 1] AS model, abs({_MONEY}) % 5000 AS in_tok, abs({_MONEY}) % 700 AS out_tok, event_id % 3 = 0 AS batch FROM events"
_PRICE = "CASE WHEN starts_with(model, 'swift-lite') THEN 0.25::DOUBLE WHEN starts_with(model, 'swift') THEN 1.5::DOUBLE WHEN starts_with(model, 'local:') THEN 0.0::DOUBLE END"
_PRICE_OUT = "CASE WHEN starts_with(model, 'swift-lite') THEN 1.5::DOUBLE WHEN starts_with(model, 'swift') THEN 9.0::DOUBLE WHEN starts_with(model, 'local:') THEN 0.0::DOUBLE END"
_USAGE = f"""SELECT part, CASE WHEN model = '' THEN '?' ELSE model END AS model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok,
 round(sum(CAST(round((in_tok * ({_PRICE}) + out_tok * ({_PRICE_OUT})) * (CASE WHEN batch THEN 500 ELSE 1000 END)) AS BIGINT)) / 1e9, 6) AS cost FROM ({_CALLS}) GROUP BY ALL"""


def _calls(spark, sf_dir):
    tokens = F.abs(F.floor(F.col("value") * 10))
    model = F.element_at(F.array(*map(F.lit, ["swift-lite", "swift", "local:x", "unknown", ""])), (F.col("user_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("part"), model.alias("model"), (tokens % 5000).alias("in_tok"), (tokens % 700).alias("out_tok"), (F.col("event_id") % 3 == 0).alias("batch"))


def _prices(spark):
    return spark.createDataFrame([(1, "swift-lite", 0.25, 1.5), (2, "swift", 1.5, 9.0), (3, "local:", 0.0, 0.0)], "ord int, prefix string, usd_in double, usd_out double")


def _usage(spark, sf_dir):
    rows = R.by_prefix(_calls(spark, sf_dir), _prices(spark), "model")
    nano = F.round((F.col("in_tok") * F.col("usd_in") + F.col("out_tok") * F.col("usd_out")) * F.when(F.col("batch"), 500).otherwise(1000)).cast("long")
    return rows.groupBy("part", F.when(F.col("model") == "", "?").otherwise(F.col("model")).alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"), F.round(F.sum(nano) / 1e9, 6).alias("cost"))


@query(_USAGE)
def usage_by_part(spark, sf_dir):
    return _usage(spark, sf_dir)


@query(f"""SELECT part, array_to_string(list_sort(list(model || ':' || CASE WHEN cost IS NULL THEN 'unregistered' WHEN cost = 0 THEN 'free' ELSE printf('$%.4f', cost) END)), ',') AS labels, round(coalesce(sum(cost), 0), 6) AS total, bool_or(cost IS NULL) AS unknown,
 printf('$%.4f', round(coalesce(sum(cost), 0), 6)) || CASE WHEN bool_or(cost IS NULL) THEN ' + unregistered' ELSE '' END AS total_label FROM ({_USAGE}) GROUP BY part""")
def usage_summary(spark, sf_dir):
    """What each part of a run cost, by model and in all."""
    out = R.usage_labels(_usage(spark, sf_dir), "part", "model", "cost")
    return out.select("part", F.array_join("labels", ",").alias("labels"), F.round("total", 6).alias("total"), "unknown", "total_label")


_MANY = "SELECT row_number() OVER (ORDER BY p_partkey DESC) AS ord, lower(left(p_name, CAST(3 + p_partkey % 9 AS INT))) AS prefix, p_partkey / 8.0::DOUBLE AS usd_in, p_size / 4.0::DOUBLE AS usd_out FROM part"


@query(f"""WITH r AS ({_MANY}), n AS (SELECT DISTINCT upper(p_name) AS model FROM part UNION SELECT DISTINCT c_mktsegment FROM customer),
m AS (SELECT n.model, arg_min({{'a': usd_in, 'b': usd_out}}, ord) AS p FROM n JOIN r ON starts_with(lower(n.model), r.prefix) GROUP BY n.model)
SELECT n.model, m.p.a AS usd_in, m.p.b AS usd_out FROM n LEFT JOIN m ON n.model = m.model""")
def price_table(spark, sf_dir):
    """A price list of as many rules as there are parts: the first rule whose prefix begins a name."""
    part = read(spark, sf_dir, "part")
    numbered = runs.ordinals(part.select(F.lit(0).alias("all"), (-F.col("p_partkey")).alias("down"), "p_partkey", "p_name", "p_size"), ["all"], ["down"], "ord")
    prices = numbered.select("ord", F.lower(F.left("p_name", (F.col("p_partkey") % 9 + 3).cast("int"))).alias("prefix"), (F.col("p_partkey") / 8).alias("usd_in"), (F.col("p_size") / 4).alias("usd_out"))
    names = part.select(F.upper("p_name").alias("model")).unionByName(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"))).distinct()
    return R.by_prefix(names, prices, "model").select("model", "usd_in", "usd_out")


@query(f"SELECT model, any_value({_PRICE}) AS usd_in, any_value({_PRICE_OUT}) AS usd_out, CAST(count(*) AS BIGINT) AS calls FROM ({_CALLS}) GROUP BY model")
def price_lookup(spark, sf_dir):
    rows = R.by_prefix(_calls(spark, sf_dir), _prices(spark), "model")
    return rows.groupBy("model").agg(F.first("usd_in").alias("usd_in"), F.first("usd_out").alias("usd_out"), F.count(F.lit(1)).alias("calls"))


@query("""SELECT conv_id, string_agg(line, chr(10) ORDER BY l) AS text, CAST(sum(n) AS BIGINT) AS n FROM (
 SELECT conv_id, turn // 2 AS l, string_agg(role || turn, ' ' ORDER BY turn) AS line, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def ocr_words_to_lines(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("l"), "turn", F.concat("role", F.col("turn").cast("string")).alias("w"))
    joined = lambda rows, sep: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["v"]), sep)
    row = words.groupBy("conv_id", "l").agg(joined(F.struct("turn", F.col("w").alias("v")), " ").alias("line"), F.count(F.lit(1)).alias("n"))
    return row.groupBy("conv_id").agg(joined(F.struct("l", F.col("line").alias("v")), "\n").alias("text"), F.sum("n").alias("n"))


@query("""SELECT user_id, list_sort(list(event_id))[len(list(event_id)) // 2 + 1] AS upper, median(event_id) AS middle, list_sort(list(event_id))[len(list(event_id)) // 10 + 1] AS low FROM events GROUP BY user_id""")
def medians(spark, sf_dir):
    return O.middles(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""SELECT category, CAST(count(*) AS BIGINT) AS files, CAST(sum(length(html)) AS BIGINT) AS bytes, CAST(row_number() OVER (ORDER BY sum(length(html)) DESC, category) AS INT) AS place FROM (SELECT coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), 'other') AS category, html FROM pages) GROUP BY category HAVING sum(length(html)) > 0""")
def cleanup_scan(spark, sf_dir):
    category = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")), F.lit("other"))
    """What could be cleaned up, by category, the largest first."""
    rows = read(spark, sf_dir, "pages").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("html")).alias("bytes")).filter("bytes > 0").withColumns({"all": F.lit(0), "down": -F.col("bytes")})
    return runs.ordinals(rows, ["all"], ["down", "category"], "place").select("category", "files", "bytes", F.col("place").cast("int"))


@query("""SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS warned, least(100, floor(count(*) * 100 / (SELECT count(*) FROM orders) + 0.5))::INT AS pct FROM orders GROUP BY o_orderstatus""")
def run_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("o_totalprice") > 200000).alias("warned"))
    return rows.withColumn("pct", F.least(F.lit(100), F.floor(F.col("pages") * 100 / F.sum("pages").over(W.partitionBy()) + 0.5)).cast("int"))


# --- ordered ----------------------------------------------------------------------------------------------------


_RUN = "SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations"


@query(f"""WITH RECURSIVE r AS ({_RUN}), f AS (SELECT conv_id, turn, rn, 0 AS chunk, n AS total FROM r WHERE rn = 1 UNION ALL
 SELECT r.conv_id, r.turn, r.rn, CASE WHEN f.total >= 300 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total >= 300 THEN r.n ELSE f.total + r.n END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, CAST(chunk AS INT) AS chunk FROM f""")
def greedy_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return O.greedy_chunks(rows, "conv_id", "turn", "n", 300).select("conv_id", "turn", "chunk")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE (conv_id + turn) % 4 > 0), f AS (SELECT conv_id, turn, rn, 0 AS chunk, n AS total FROM r WHERE rn = 1 UNION ALL
 SELECT r.conv_id, r.turn, r.rn, CASE WHEN f.total >= 300 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total >= 300 THEN r.n ELSE f.total + r.n END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, CAST(chunk AS INT) AS chunk FROM f""")
def resumed_chunks(spark, sf_dir):
    """Chunks of what is left to do: paragraphs with a translation are passed over and do not count; failed ones, whose translation is null, are asked for again."""
    done = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "done")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), done.alias("tr"))
    return O.greedy_chunks(rows.filter("tr is null"), "conv_id", "turn", "n", 300).select("conv_id", "turn", "chunk")


@query(f"""WITH RECURSIVE r AS ({_RUN}), f AS (SELECT conv_id, turn, rn, 0 AS chunk, n AS total FROM r WHERE rn = 1 UNION ALL
 SELECT r.conv_id, r.turn, r.rn, CASE WHEN f.total + r.n > 500 AND f.total > 0 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total + r.n > 500 AND f.total > 0 THEN r.n ELSE f.total + r.n END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, CAST(chunk AS INT) AS chunk FROM f""")
def size_pack(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return O.greedy_chunks(rows, "conv_id", "turn", "n", 500, before=True).select("conv_id", "turn", "chunk")


@query("SELECT conv_id, turn, right(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 300) AS context FROM conversations")
def prev_context(spark, sf_dir):
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(by)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.right(said, F.lit(300)).alias("context"))


@query("SELECT conv_id, turn FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 600")
def sample_until(spark, sf_dir):
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return read(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.sum(F.length("text")).over(by), F.lit(0))).filter("before < 600").select("conv_id", "turn")


_PAGES = """SELECT source, doc_id, ascii(right(source, 1)) % 2 = 0 AS layer, CASE WHEN doc_id % 3 = 0 THEN left(text, CAST(doc_id % 190 AS INT)) WHEN ascii(right(source, 1)) % 4 = 0 THEN text END AS text, CASE WHEN doc_id % 5 > 0 THEN left(text, 120) END AS reading FROM documents"""


def _read_sql(n: int) -> str:
    """The sample after n more pages were read: each is added unless one before it brought the whole to 300 characters."""
    ended = " OR ".join(f"(length(r[{i}]) IS NOT NULL AND length({_STRIP_ALL.format(f's{i}')}) >= 300)" for i in range(1, n)) or "false"
    return f"CASE WHEN r[{n}] IS NULL OR {ended} THEN s{n - 1} ELSE s{n - 1} || chr(10) || r[{n}] END"


_STRIP_ALL = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


@query(f"""WITH p AS ({_PAGES}), n AS (SELECT *, row_number() OVER w AS n, sum(coalesce(length(text), 0)) OVER w AS upto FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT source, any_value(layer) AS layer, coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE text IS NOT NULL AND upto - length(text) < 600 AND (NOT layer OR n <= 5)), '') AS s0, list(reading ORDER BY n) FILTER (WHERE n <= 4) AS r FROM n GROUP BY source),
a1 AS (SELECT *, {_read_sql(1)} AS s1 FROM f), a2 AS (SELECT *, {_read_sql(2)} AS s2 FROM a1), a3 AS (SELECT *, {_read_sql(3)} AS s3 FROM a2), a4 AS (SELECT *, {_read_sql(4)} AS s4 FROM a3)
SELECT source, md5(CASE WHEN NOT layer AND length(s0) < 200 THEN s4 ELSE s0 END) AS sample, CAST(length(CASE WHEN NOT layer AND length(s0) < 200 THEN s4 ELSE s0 END) AS INT) AS n FROM a4""")
def language_sample(spark, sf_dir):
    """What a book's language is told from: its text layer or stored pages, and pages that are read if those are scarce."""
    even, k = F.ascii(F.right("source", F.lit(1))), F.col("doc_id")
    text = F.when(k % 3 == 0, F.left("text", (k % 190).cast("int"))).when(even % 4 == 0, F.col("text"))
    pages = docs(spark, sf_dir, "source", "doc_id", "text").select("source", "doc_id", (even % 2 == 0).alias("layer"), text.alias("text"), F.when(k % 5 > 0, F.left("text", F.lit(120))).alias("reading"))
    return R.language_samples(pages, "source", "doc_id").select("source", F.md5("sample").alias("sample"), F.length("sample").alias("n"))


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS t, greatest(0, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS mid FROM g GROUP BY user_id)
SELECT user_id, event_id, CAST(sum(CASE WHEN gap > 1.8 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS para FROM g JOIN m USING (user_id)""")
def gap_paragraphs(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t"))
    by = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = rows.withColumn("gap", F.greatest(F.lit(0), F.col("t") - F.lag("t").over(by)))
    mid = rows.groupBy("user_id").agg(F.median("gap").alias("mid"))
    return O.islands(rows.join(mid, "user_id"), ["user_id"], ["t", "event_id"], F.col("gap") > 1.8 * F.col("mid"), "para").select("user_id", "event_id", "para")


@query("""SELECT user_id, CAST(min(r) AS BIGINT) AS y0, CAST(max(r) AS BIGINT) AS y1 FROM (SELECT user_id, r, sum(s) OVER (PARTITION BY user_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS b FROM (
 SELECT user_id, r, CASE WHEN r - lag(r) OVER (PARTITION BY user_id ORDER BY r) > 4 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT user_id, event_id // 40 AS r FROM events))) GROUP BY user_id, b HAVING max(r) - min(r) + 1 >= 5""")
def bands(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.expr("event_id div 40").alias("r")).distinct()
    by = W.partitionBy("user_id").orderBy("r")
    marked = O.islands(rows, ["user_id"], ["r"], F.col("r") - F.lag("r").over(by) > 4, "b")
    return marked.groupBy("user_id", "b").agg(F.min("r").alias("y0"), F.max("r").alias("y1")).filter("y1 - y0 + 1 >= 5").select("user_id", "y0", "y1")


@query("SELECT source, doc_id, CAST((rn - 1) // 6 AS INT) AS batch, printf('p%04d-a-%03d', doc_id, (rn - 1) // 6) AS custom_id, CAST((rn - 1) % 6 + 1 AS INT) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)")
def fixed_batches(spark, sf_dir):
    rows = runs.ordinals(docs(spark, sf_dir, "source", "doc_id"), ["source"], ["doc_id"], "rn")
    batch = F.expr("(rn - 1) div 6").cast("int")
    return rows.select("source", "doc_id", batch.alias("batch"), F.format_string("p%04d-a-%03d", "doc_id", batch).alias("custom_id"), ((F.col("rn") - 1) % 6 + 1).alias("n"))


@query("""WITH p AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total FROM documents),
h AS (SELECT * FROM p WHERE n % 11 = 0), f AS (SELECT source, min(idx) AS first, any_value(total) AS total FROM h GROUP BY source),
s AS (SELECT source, idx, total FROM h UNION ALL SELECT source, 0, total FROM f WHERE first > 0.2 * total
 UNION ALL SELECT source, 0, any_value(total) FROM p WHERE source NOT IN (SELECT source FROM h) GROUP BY source)
SELECT source, CAST(idx AS INT) AS start, CAST(coalesce(lead(idx) OVER (PARTITION BY source ORDER BY idx), total) AS BIGINT) AS "end" FROM s""")
def chapters(spark, sf_dir):
    """Headed pages begin chapters; so does the first page if no head comes early. What has a head is numbered too, so that a chapter ends where the next number begins."""
    pages = docs(spark, sf_dir, "source", "doc_id", (F.col("n_chars") % 11 == 0).alias("head"))
    return O.chapter_ranges(pages, "source", "doc_id", "head").select(F.col("group").alias("source"), F.col("start").cast("int"), "end")


# --- joins and state --------------------------------------------------------------------------------------------

_PASS = "SELECT l_orderkey AS page, l_linenumber AS id, {text} AS text, CASE WHEN l_quantity > 40 THEN 'shout' ELSE 'dialogue' END AS kind, CASE WHEN l_discount > {d} THEN 'high' ELSE 'medium' END AS confidence, l_tax > 0.06 AS uncertain FROM lineitem WHERE {keep} QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1"
_A = _PASS.format(text="l_returnflag", d="0.02", keep="l_partkey % 13 <> 0")
_B = _PASS.format(text="CASE WHEN l_suppkey % 7 = 0 THEN l_linestatus ELSE l_returnflag || ' ' END", d="0.01", keep="l_partkey % 17 <> 0")
_V = _PASS.format(text="'v' || l_returnflag", d="0.00", keep="l_suppkey % 2 = 0")


@query(f"""WITH a AS ({_A}), b AS ({_B}), v AS ({_V}),
q AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS id FROM lineitem),
j AS (SELECT q.page, q.id, a.text AS ta, b.text AS tb, a.kind AS ka, b.kind AS kb, a.confidence AS ca, b.confidence AS cb, a.uncertain AS ua, b.uncertain AS ub, a.page IS NOT NULL AS ina, b.page IS NOT NULL AS inb FROM q LEFT JOIN a ON a.page = q.page AND a.id = q.id LEFT JOIN b ON b.page = q.page AND b.id = q.id),
p AS (SELECT j.*, v.text AS tv, v.kind AS kv, v.confidence AS cv, v.uncertain AS uv, CASE WHEN NOT ina AND NOT inb THEN 'failed' WHEN NOT ina OR NOT inb THEN 'single' WHEN trim(ta) = trim(tb) AND ka = kb AND ca = 'high' AND cb = 'high' AND NOT ua AND NOT ub THEN 'agree' WHEN v.page IS NOT NULL THEN 'adjudicated' ELSE 'unverified' END AS passes FROM j LEFT JOIN v ON j.page = v.page AND j.id = v.id),
k AS (SELECT page, id, passes, CASE WHEN passes = 'adjudicated' THEN tv WHEN ina THEN ta ELSE tb END AS text, CASE WHEN passes = 'adjudicated' THEN kv WHEN ina THEN ka ELSE kb END AS kind, CASE WHEN passes = 'adjudicated' THEN cv WHEN ina THEN ca ELSE cb END AS c, CASE WHEN passes = 'adjudicated' THEN uv WHEN ina THEN ua ELSE ub END AS u, CASE WHEN passes IN ('adjudicated', 'unverified') THEN ta END AS alt_pass1, CASE WHEN passes IN ('adjudicated', 'unverified') THEN tb END AS alt_pass2 FROM p)
SELECT page, id, text, CASE WHEN passes = 'failed' THEN 'none' ELSE kind END AS kind, CASE WHEN passes = 'failed' THEN 'low' WHEN (passes = 'unverified' OR (passes = 'single' AND u)) AND c = 'high' THEN 'medium' ELSE c END AS confidence, passes, alt_pass1, alt_pass2 FROM k""")
def consensus(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "page", "l_linenumber": "id"})
    kind = F.when(F.col("l_quantity") > 40, "shout").otherwise("dialogue")

    def one_pass(text, least, keep):
        own = rows.filter(keep).select("page", "id", text.alias("text"), kind.alias("kind"), F.when(F.col("l_discount") > least, "high").otherwise("medium").alias("confidence"), (F.col("l_tax") > 0.06).alias("uncertain"), "l_partkey", "l_suppkey", "l_extendedprice")
        first = F.row_number().over(W.partitionBy("page", "id").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
        return own.withColumn("n", first).filter("n = 1").drop("n", "l_partkey", "l_suppkey", "l_extendedprice")

    flag = F.col("l_returnflag")
    a = one_pass(flag, 0.02, "l_partkey % 13 <> 0")
    b = one_pass(F.when(F.col("l_suppkey") % 7 == 0, F.col("l_linestatus")).otherwise(F.concat(flag, F.lit(" "))), 0.01, "l_partkey % 17 <> 0")
    v = one_pass(F.concat(F.lit("v"), flag), 0.0, "l_suppkey % 2 = 0")
    return R.consensus(a, b, v, ["page", "id"], asked=rows.select("page", "id").distinct())


@query("""WITH asked AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM conversations),
got AS (SELECT conv_id, ord, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE ord END AS id, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, text, turn FROM conversations) WHERE conv_id % 3 = 0 OR turn % 4 <> 3),
how AS (SELECT a.conv_id, g.ids < a.n AND g.got = a.n AS place FROM (SELECT conv_id, count(*) AS n FROM asked GROUP BY ALL) a LEFT JOIN (SELECT conv_id, count(DISTINCT id) AS ids, count(*) AS got FROM got GROUP BY ALL) g USING (conv_id)),
keyed AS (SELECT conv_id, CASE WHEN place THEN ord ELSE id END AS ord, arg_max(text, ord) AS text FROM got JOIN how USING (conv_id) GROUP BY conv_id, CASE WHEN place THEN ord ELSE id END)
SELECT asked.conv_id, CAST(asked.ord AS INT) AS ord, keyed.text FROM asked LEFT JOIN keyed ON asked.conv_id = keyed.conv_id AND asked.ord = keyed.ord""")
def reply_align(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("ord", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    id_ = F.when(F.col("conv_id") % 3 == 0, F.lit(1)).otherwise(F.col("ord"))
    got = rows.filter("conv_id % 3 = 0 OR turn % 4 <> 3").select("conv_id", "ord", id_.alias("id"), "text")
    return R.align_replies(rows.select("conv_id", "ord"), got, "conv_id").select("conv_id", "ord", "text")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey AS ord, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, -o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'ok' END AS s FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(o.k, n.k) AS page, CASE WHEN n.s IS NULL OR (n.s = 'skipped' AND o.s IS NOT NULL) THEN o.s ELSE n.s END AS status, CASE WHEN n.s IS NULL THEN 1 ELSE 0 END AS part, coalesce(n.ord, o.ord) AS ord FROM o FULL JOIN n ON o.k = n.k""")
def merge_review(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("status"))
    old = orders.filter("page % 3 <> 0").withColumn("ord", F.col("page"))
    new = orders.filter("page % 4 <> 0").select("page", F.when(F.col("page") % 7 == 0, "skipped").otherwise("ok").alias("status"), (-F.col("page")).alias("ord"))
    return R.merge_reports(old, new, "page", "ord", "status")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT page_id * 4 FROM pages)")
def resume_todo(spark, sf_dir):
    done = read(spark, sf_dir, "labels").select("doc_id")
    locked = read(spark, sf_dir, "pages").select((F.col("page_id") * 4).alias("doc_id"))
    return docs(spark, sf_dir, "doc_id").join(done, "doc_id", "left_anti").join(locked, "doc_id", "left_anti")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flag' ELSE md5(d.text) END AS shown FROM documents d LEFT JOIN labels l USING (doc_id)")
def xlat_fallback(spark, sf_dir):
    own = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flag").otherwise(F.lit("")).alias("x"))
    rows = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5("text").alias("src"))
    return rows.join(own, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("x", F.lit("")), "src").alias("shown"))


@query("SELECT d.doc_id, p.page_id, p.page_id * 4 AS s, p.page_id * 4 + 2 AS e FROM documents d JOIN pages p ON d.doc_id BETWEEN p.page_id * 4 AND p.page_id * 4 + 2")
def overlap_window(spark, sf_dir):
    """Paragraph spans touching a page: a span covers few pages, so it is dealt to them and the join is on equal keys."""
    spans = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * 4).alias("s"), (F.col("page_id") * 4 + 2).alias("e"))
    return docs(spark, sf_dir, "doc_id").join(spans.withColumn("doc_id", F.explode(F.sequence("s", "e"))), "doc_id")


@query("""SELECT p_partkey, arg_min(b, struct_pack(d := d, b := b)) AS brand FROM (SELECT p.p_partkey, f.b, 3 * abs(p.p_size - f.t) + abs(p.p_size % 7 - f.c) AS d FROM part p, (VALUES ('a', 5, 1), ('b', 20, 3), ('c', 40, 5)) f(b, t, c)) GROUP BY p_partkey""")
def nearest_font(spark, sf_dir):
    fonts = spark.createDataFrame([("a", 5, 1), ("b", 20, 3), ("c", 40, 5)], "b string, t int, c int")
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").join(F.broadcast(fonts)).withColumn("d", 3 * F.abs(size - F.col("t")) + F.abs(size % 7 - F.col("c")))
    return rows.groupBy("p_partkey").agg(F.min_by("b", F.struct("d", "b")).alias("brand"))


_EDITS = "SELECT user_id % 20 AS book, event_id AS seq, event_id // 2500 AS fp, user_id AS idx, event_type AS text FROM events"


@query(f"""WITH e AS ({_EDITS}), l AS (SELECT *, sum(CASE WHEN fp <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, lag(fp) OVER (PARTITION BY book ORDER BY seq) AS prev FROM e)),
m AS (SELECT book, max(life) AS life FROM l GROUP BY book)
SELECT book, idx, arg_max(text, seq) AS text, arg_max(fp, seq) AS fp, max(seq) AS seq FROM l JOIN m USING (book, life) GROUP BY book, idx""")
def latest_edits(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("book"), F.col("event_id").alias("seq"), F.expr("event_id div 2500").alias("fp"), F.col("user_id").alias("idx"), F.col("event_type").alias("text"))
    return R.fenced_latest(e)


_USED = "SELECT o_custkey AS owner, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END || CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'book' || (o_orderkey % 23) END AS src, 'T' || o_orderkey AS title, o_orderkey % 2 = 0 AS pin, o_orderkey AS ts, CASE WHEN o_orderkey % 5 = 0 THEN 'pin' ELSE 'use' END AS kind FROM orders"


@query(f"""WITH o AS (SELECT owner, trim(src) AS src, arg_max(title, ts) FILTER (WHERE kind = 'use') AS title, max(ts) FILTER (WHERE kind = 'use') AS ts, coalesce(arg_max(pin, ts) FILTER (WHERE kind = 'pin'), false) AS pin FROM ({_USED}) WHERE trim(src) <> '' GROUP BY owner, trim(src)),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, pin ORDER BY ts DESC, src) AS n FROM o WHERE ts IS NOT NULL)
SELECT owner, src, title, pin, ts, CAST(CASE WHEN pin THEN n ELSE n + count(*) FILTER (WHERE pin) OVER (PARTITION BY owner) END AS INT) AS place FROM k WHERE pin OR n <= 5""")
def recents_topk(spark, sf_dir):
    """Recent books of each customer: one entry a source, pinned ones first and all of them, the newest five of the others."""
    key = F.col("o_orderkey")
    src = F.concat(F.when(key % 3 == 0, " ").otherwise(""), F.when(key % 41 == 0, "").otherwise(F.concat(F.lit("book"), (key % 23).cast("string"))))
    used = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), src.alias("src"), F.concat(F.lit("T"), key.cast("string")).alias("title"), (key % 2 == 0).alias("pin"), key.alias("ts"), F.when(key % 5 == 0, "pin").otherwise("use").alias("kind"))
    return R.recents(used, "owner", 5)


@query("SELECT l_orderkey, l_linenumber AS idx, CASE WHEN l_linenumber < 2 THEN l_linenumber ELSE l_linenumber + 1 END AS new_idx FROM lineitem WHERE l_linenumber < 2 OR l_linenumber >= 4")
def index_shift(spark, sf_dir):
    return R.shifted(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx")), "idx", 2, 4, 3)


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_id // 100))), ',') AS marks FROM events GROUP BY user_id")
def bookmarks(spark, sf_dir):
    marks = F.array_sort(F.collect_set(F.expr("event_id div 100")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(marks.cast("array<string>"), ",").alias("marks"))


@query("""SELECT a.o_custkey, CASE WHEN b.ts IS NULL OR a.ts IS NULL OR b.ts > a.ts THEN coalesce(b.pos, a.pos) ELSE a.pos END AS pos FROM
 (SELECT o_custkey, max(o_orderdate) AS ts, max(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) a LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS ts, max(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) b USING (o_custkey)""")
def position_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    side = lambda s, p: orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_orderdate").alias(p + "ts"), F.max("o_orderkey").alias(p + "pos"))
    both = side("F", "a_").join(side("O", "b_"), "o_custkey", "left")
    fresh = F.col("b_ts").isNull() | F.col("a_ts").isNull() | (F.col("b_ts") > F.col("a_ts"))
    return both.select("o_custkey", F.when(fresh, F.coalesce("b_pos", "a_pos")).otherwise(F.col("a_pos")).alias("pos"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n BETWEEN 3 AND 12")
def page_range(spark, sf_dir):
    first, last = R.page_range("3~12")
    return runs.ordinals(docs(spark, sf_dir, "source", "doc_id"), ["source"], ["doc_id"]).filter(F.col("n").between(first, last)).drop("n")


@query("SELECT source, md5(string_agg(md5(text), chr(10) ORDER BY doc_id)) AS fingerprint, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY source")
def book_fingerprint(spark, sf_dir):
    """The order matters, so that pages are hashed before they are gathered: a book's rows stay small."""
    pages = docs(spark, sf_dir, "source", "doc_id", "text").select("source", "doc_id", F.md5("text").alias("h"))
    own = F.array_join(F.transform(O.in_order("doc_id", "h"), lambda r: r["h"]), "\n")
    return pages.groupBy("source").agg(F.md5(own).alias("fingerprint"), F.count(F.lit(1)).alias("count"))


@query()
def book_crc(spark, sf_dir):
    """The checksum of a book's joined texts, from those of its pages; a test holds it against zlib."""
    out = runs.checksums(docs(spark, sf_dir, "source", "doc_id", "text"), "source", ["doc_id"], "text")
    return out.select("source", F.lower(F.lpad(F.hex("crc"), 8, "0")).alias("fingerprint"), F.col("n").alias("count"))


@query("SELECT v, round(t * t * (3 - 2 * t) * 255, 6) AS tone FROM (SELECT p_partkey AS v, greatest(0.0, least(1.0, (p_size - 10) / 30.0::DOUBLE)) AS t FROM part)")
def tone_curve(spark, sf_dir):
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p_size") - 10) / 30.0))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.round(t * t * (3 - 2 * t) * 255, 6).alias("tone"))
