"""Registered queries of kept state: flushed reports, versions, the edit queue as a stream, retries; each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.operators import runs
from folioflow.operators.kept import shared_dir
from folioflow.plans.catalogue import _EDITS, docs, query, read
from folioflow.sinks.versions import Versions, report_merge
from folioflow.streaming import queue

C = F.col


def _store(spark, name: str, buckets: int = 16) -> Versions:
    return Versions(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", buckets)


_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'locked' ELSE 'failed' END"


@query(f"""WITH o AS (SELECT doc_id, 'old' AS status, md5(text) AS text, 1 AS part, doc_id AS ord FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, {_STATUS} AS status, md5(text || source) AS text, 0 AS part, doc_id * 7 % 1000 AS ord FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND n.status IN ('skipped', 'locked')) THEN o.status ELSE n.status END AS status,
 CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND n.status IN ('skipped', 'locked')) THEN o.text ELSE n.text END AS text, coalesce(n.part, o.part) AS part, coalesce(n.ord, o.ord) AS ord
 FROM n FULL OUTER JOIN o ON n.doc_id = o.doc_id""")
def page_flush(spark, sf_dir):
    """A report that stands, onto which pages are flushed in three goes; the SQL merges it at once."""
    rows = docs(spark, sf_dir, "doc_id", "source", "text")
    old = rows.filter("doc_id % 3 <> 0").select("doc_id", F.lit("old").alias("status"), F.md5("text").alias("text"), F.lit(1).alias("part"), C("doc_id").alias("ord"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "skipped", "locked", "failed"))), (C("doc_id") % 4 + 1).cast("int"))
    new = rows.filter("doc_id % 5 <> 0").select("doc_id", status.alias("status"), F.md5(F.concat("text", "source")).alias("text"), F.lit(0).alias("part"), (C("doc_id") * 7 % 1000).alias("ord"))
    store = _store(spark, "report")
    store.upsert("report", old, "doc_id")
    for part in range(3):
        store.upsert("report", new.filter(F.pmod("doc_id", F.lit(3)) == part), "doc_id", report_merge("doc_id", "status"))
    return store.read("report")


@query("""SELECT doc_id, 'xlat' AS kind, md5(text) AS text, 1 AS version FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'pages', md5(source), 1 FROM documents UNION ALL SELECT doc_id, 'xlat', 'again', 2 FROM documents WHERE doc_id % 10 = 0""")
def reset_restore(spark, sf_dir):
    """Translations are put aside and made anew (version 2 here); then the run from before is brought back (version 1)."""
    rows, store = docs(spark, sf_dir, "doc_id", "source", "text"), _store(spark, "run")
    store.upsert("xlat", rows.filter("doc_id % 2 = 0").select("doc_id", F.md5("text").alias("text")), "doc_id")
    whole = store.upsert("pages", rows.select("doc_id", F.md5("source").alias("text")), "doc_id")
    store.reset("xlat")
    again = store.upsert("xlat", rows.filter("doc_id % 10 = 0").select("doc_id", F.lit("again").alias("text")), "doc_id")
    store.restore(whole)
    own = lambda kind, n, v: store.read(kind, n).select("doc_id", F.lit(kind).alias("kind"), "text", F.lit(v).alias("version"))
    return own("xlat", None, 1).unionByName(own("pages", None, 1)).unionByName(own("xlat", again, 2))


@query(f"""WITH e AS ({_EDITS}), l AS (SELECT *, sum(CASE WHEN fp <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, lag(fp) OVER (PARTITION BY book ORDER BY seq) AS prev FROM e)),
m AS (SELECT book, max(life) AS life FROM l GROUP BY book)
SELECT book, idx, arg_max(text, seq) AS text, arg_max(fp, seq) AS fp, max(seq) AS seq FROM l JOIN m USING (book, life) GROUP BY book, idx""")
def queue_stream(spark, sf_dir):
    """The edit queue, fed as a stream through its state; what waits is what the batch twin latest_edits gives."""
    queue.use_state_store(spark)
    rows = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    edits = rows.select((C("user_id") % 20).alias("book"), C("event_id").alias("seq"), F.lit("edit").alias("kind"), F.expr("event_id div 2500").alias("fp"), C("user_id").alias("idx"), C("event_type").alias("text"), F.lit(None).cast("long").alias("upto"))
    root = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    told = queue.changes(edits).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/told/batch={n}"))
    told.option("checkpointLocation", f"{root}/checkpoint").trigger(once=True).start().awaitTermination()
    return queue.waiting(spark.read.schema(queue.CHANGES).parquet(f"{root}/told"))


_ANSWERS = "SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts) // 1000 AS at_ms, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 404 WHEN 4 THEN 403 WHEN 5 THEN 500 END AS status FROM events"


@query(f"""WITH a AS ({_ANSWERS}), b AS (SELECT *, status IS NULL OR status IN (404, 429) OR status >= 500 AS better FROM a),
e AS (SELECT request, least(3, coalesce(min(n) FILTER (WHERE NOT better), 3)) AS stop FROM b GROUP BY request)
SELECT b.request, CAST(CASE WHEN n = stop AND (n = 3 OR NOT better) THEN n ELSE n + 1 END AS INT) AS attempt, CASE WHEN n = stop AND (n = 3 OR NOT better) THEN at_ms ELSE at_ms + 1300 * n END AS at_ms,
 CASE WHEN NOT (n = stop AND (n = 3 OR NOT better)) THEN 'due' WHEN better OR status >= 400 THEN 'failed' ELSE 'done' END AS state FROM b JOIN e ON b.request = e.request WHERE n <= stop""")
def retry_plan(spark, sf_dir):
    """Attempts at requests by what was answered: 404, 429, 5xx and no answer are tried again, three times in all, later each time."""
    rows = read(spark, sf_dir, "events").select(C("user_id").alias("request"), "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("at_ms"))
    status = F.get(F.array(*[F.lit(s).cast("int") for s in (200, 503, 429, 404, 403, 500, None)]), (C("event_id") % 7).cast("int"))
    answers = runs.ordinals(rows, ["request"], ["event_id"]).select("request", "n", "at_ms", status.alias("status"))
    return queue.planned(answers)
