"""Registered queries of the sources and sinks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.plans.catalogue import dealt, docs, query, read
from folioflow.sinks import books as K
from folioflow.sources import books as S

_BLANKS = "'" + T.SPACE.replace("'", "''") + "'"
_STRIP = f"trim(coalesce(text, ''), {_BLANKS})"


@query(f"""WITH n AS (SELECT source AS book, count(*) AS n_pages FROM documents GROUP BY source),
f AS (SELECT source AS book, count(*) FILTER (length({_STRIP}) >= 200) AS n_text, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) WHERE pos <= 8 GROUP BY source)
SELECT n.book, n_pages, n_text, CASE WHEN n_text >= greatest(1, k // 2) THEN 'pdf-text' ELSE 'pdf-scan' END AS kind FROM n JOIN f ON n.book IS NOT DISTINCT FROM f.book""")
def probe_source(spark, sf_dir):
    return S.probe(docs(spark, sf_dir, "doc_id", "source", "text"), "source", "doc_id", "text")


@query(f"SELECT doc_id, CASE WHEN length({_STRIP}) > 0 THEN 1 ELSE 0 END AS done FROM documents")
def cached_page_state(spark, sf_dir):
    return dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", S.not_blank(F.col("text")).cast("int").alias("done"))


@query(f"""SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS idx, md5(unnest(p)) AS src, '' AS page, 'de' AS source_lang
FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS p FROM documents) WHERE len(p) > 0""")
def load_book_fallback(spark, sf_dir):
    return S.book_of_text(dealt(spark, docs(spark, sf_dir, "doc_id", "text")), "doc_id", "text").withColumn("src", F.md5("src"))


@query("""WITH e AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'p1' ELSE ' ' || turn END AS key FROM conversations)
SELECT conv_id, CAST(trim(key) AS BIGINT) AS key FROM e WHERE conv_id NOT IN (SELECT conv_id FROM e WHERE key = 'p1')""")
def xlat_keys(spark, sf_dir):
    key = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "p1").otherwise(F.concat(F.lit(" "), F.col("turn").cast("string")))
    return S.int_keys(read(spark, sf_dir, "conversations").select("conv_id", key.alias("key")), "conv_id", "key")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def locked_pages(spark, sf_dir):
    return S.locked(read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("locked")), "o_custkey", "locked")


@query("SELECT conv_id, md5(string_agg(turn || ':' || coalesce(role, ''), ',' ORDER BY turn, role)) AS entries FROM conversations GROUP BY conv_id")
def transcript_pages(spark, sf_dir):
    rows = S.by_page(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role")), "conv_id", "turn", "role")
    return rows.select("conv_id", F.md5(F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["turn"].cast("string"), e["role"])), ",")).alias("entries"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND length({_STRIP}) > 0 THEN md5({_STRIP}) ELSE md5(coalesce(source, '')) END AS glossary FROM documents")
def first_glossary(spark, sf_dir):
    rows = dealt(spark, docs(spark, sf_dir, "doc_id", "text", "source"))
    return rows.select("doc_id", F.md5(S.first_not_blank(F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("\t "), F.col("source"))).alias("glossary"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE coalesce(s_name, '') END AS name, c_mktsegment AS segment
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def overlay_defaults(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.col("c_mktsegment").alias("segment"))
    return S.overlay(own, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", {"name": "s_name"})


@query("""SELECT p_brand, folder, pattern, name FROM (SELECT p_brand, p_size AS folder, p_type AS pattern, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_name) AS r FROM part) WHERE r = 1""")
def resolve_presets(spark, sf_dir):
    hits = read(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("folder"), F.col("p_type").alias("pattern"), F.col("p_name").alias("name"))
    return S.resolve_presets(hits, "p_brand", "folder", "pattern", "name")


@query("SELECT page_id, md5(coalesce(html, '')) AS mask FROM pages")
def mask_decode(spark, sf_dir):
    rows = dealt(spark, read(spark, sf_dir, "pages").select("page_id", "html"))
    url = F.concat(F.when(F.col("page_id") % 2 == 0, "data:image/png;base64,").otherwise(""), F.base64(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    return rows.select("page_id", F.md5(S.data_url(url)).alias("mask"))


@query("""SELECT source AS book, arg_min(doc_id, (CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END, doc_id)) AS cover FROM documents GROUP BY source""")
def cover_page(spark, sf_dir):
    return S.cover(docs(spark, sf_dir, "doc_id", "source", "n_chars"), "source", "doc_id", "doc_id", F.col("n_chars") > 1000)


@query("""SELECT doc_id, pos, md5(CASE WHEN pos = 0 AND length(line) <= 60 THEN '<h2>' || body || '</h2>' ELSE '<p>' || body || '</p>' END) AS element FROM (
SELECT doc_id, pos - 1 AS pos, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'gs'), '~~(.+?)~~', '<s>\\1</s>', 'gs'), '\\+\\+(.+?)\\+\\+', '<u>\\1</u>', 'gs'), '\\*(.+?)\\*', '<em>\\1</em>', 'gs') AS body
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE line <> ''""")
def paragraph_html(spark, sf_dir):
    rows = dealt(spark, docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.md5(K.paragraph_html(F.col("line"), F.col("pos") == 0)).alias("element")).filter("element is not null")


@query("""SELECT l_orderkey, l_linenumber, 0 AS part FROM lineitem WHERE l_linenumber < 4 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)
UNION ALL SELECT l_orderkey, l_linenumber, 1 FROM lineitem WHERE l_linenumber = 5""")
def crop_manifest(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return K.replace_pages(rows.filter("l_linenumber < 4").withColumn("part", F.lit(0)), rows.filter("l_linenumber = 5").withColumn("part", F.lit(1)), "l_orderkey")


@query("SELECT page_id, md5(replace(html, '</', '<\\/')) AS data FROM pages")
def embedded_json(spark, sf_dir):
    return dealt(spark, read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.md5(K.embedded(F.col("html"))).alias("data"))


@query("SELECT event_id || chr(9) || coalesce(event_type, '') || chr(9) || coalesce(props, '') AS line FROM events WHERE coalesce(event_type, '') <> 'ok'")
def run_log(spark, sf_dir):
    return K.log_lines(read(spark, sf_dir, "events").select("event_id", "event_type", "props"), "event_id", "event_type", "props")


@query("SELECT c_custkey AS page, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END AS locked FROM customer")
def final_manifest(spark, sf_dir):
    locks = S.locked(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderstatus") == "F").alias("locked")), "page", "locked")
    return K.archive_manifest(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page")), locks, "page")


@query("""SELECT p_partkey AS page, p_size AS height, p_partkey % 7 AS mtime, (p_partkey % 7) || '-' || p_size AS key, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS hit FROM part""")
def restore_cache(spark, sf_dir):
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("height"), (F.col("p_partkey") % 7).alias("mtime"))
    key = F.concat_ws("-", (F.col("mtime") + (F.col("page") % 3 == 0).cast("int")).cast("string"), F.col("height").cast("string"))
    cache = pages.select("page", key.alias("key"), F.when(F.col("page") % 5 == 0, -1).otherwise(F.col("height")).alias("height"))
    return K.cached(pages, cache, "page", ["mtime", "height"], ["height"])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'xlat' WHEN 1 THEN 'book' WHEN 2 THEN 'pages' ELSE 'glossary' END AS kind, CASE WHEN event_id % 4 < 3 THEN 1 ELSE 0 END AS moved FROM events")
def redo_reset(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("xlat", "book", "pages", "glossary"))), (F.col("event_id") % 4 + 1).cast("int"))
    return K.reset(read(spark, sf_dir, "events").select("event_id", kind.alias("kind")), "kind", "all")
