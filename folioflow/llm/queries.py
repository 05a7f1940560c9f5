"""The operators' queries over whole tables, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, interpolated_lm, license_scan, line_runs, mixing, personal_data, piece_transducer, resampling, secret_forest, simhash, toxicity, vector_codes, weighted_sampling
from .common import fold

#: A model file of merges; a parameter of the deployment, read by the driver.
PIECE_MODEL = os.environ.get("FOLIOFLOW_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return interpolated_lm.score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cross_polytope.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_transducer.encode(docs, piece_model(), keep_text=False).select("doc_id", "n_pieces", "ids", "round_trip")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_runs.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_forest.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.transform("findings", lambda f: F.struct(f["word"].alias("word"), F.sha2(f["value"], 256).alias("value_sha256"), f["probability"].alias("probability")))
    return out.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"), found.alias("findings"), "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.array_join("terms", ",").alias("terms"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.buckets(table(spark, sf_dir, "clicks").select("client_id", "ts", "value", "click_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_simhash, op3_interpolated_lm, op4_weighted_sampling, op5_license_scan, op6_nearest, op7_pieces, op8_line_dedup, op9_secrets, op10_toxicity, op11_personal_data, op12_vector_codes, op13_resample)}


_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
  / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM r),
t AS (SELECT *, least(CAST(most AS DOUBLE), weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (
  SELECT q.source, k.seed, CAST(sum(CASE WHEN CAST('0x' || substr(md5(k.seed || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < q.rate - floor(q.rate) THEN d.size ELSE 0 END) AS BIGINT) AS extra
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, range(16) k(seed) GROUP BY ALL),
b AS (
  SELECT q.*, c.seed FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source
  QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY abs(floor(q.rate) * q.source_size + c.extra - q.target), c.seed) = 1)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (floor(b.rate) + CASE WHEN CAST('0x' || substr(md5(b.seed || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < b.rate - floor(b.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

_OP8 = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND c.top IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


_OP12_KEPT = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_OP12_PARTS = """SELECT vec_id, label, p, list_slice(v, CAST(p * len(v) / 4 AS INT) + 1, CAST((p + 1) * len(v) / 4 AS INT)) AS x FROM k, range(4) t(p)"""


def _op12() -> str:
    """Rounds of nearest entries and of their means, unrolled; all numbers are whole and below 2^53, so doubles hold them exactly."""
    near = "SELECT x.vec_id, x.label, x.p, x.x, min_by(b.e, (list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, b.c) + list_inner_product(b.c, b.c)) * 256 + b.e) AS e, min(list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, b.c) + list_inner_product(b.c, b.c)) AS d FROM x JOIN b{0} b ON x.p = b.p GROUP BY ALL"
    steps = [f"k AS MATERIALIZED ({_OP12_KEPT})", f"x AS MATERIALIZED ({_OP12_PARTS})", "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 256)"]
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        if r < 4:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(CAST(sum(CAST(t AS BIGINT)) AS DOUBLE) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    steps.append("s AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)")
    steps.append("h AS (SELECT sha256(string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM b4))")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s, h"


_OP13 = r"""
WITH p AS (
  SELECT client_id AS c, epoch_us(ts) // 1000000 AS s, arg_max(CAST(floor(100 * value + 0.5) AS BIGINT), click_id) AS v
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lead(s) OVER w AS ns, lead(v) OVER w AS nv, timezone('Europe/Berlin', to_timestamp(s)) AS here FROM p WINDOW w AS (PARTITION BY c ORDER BY s)),
g AS (
  SELECT c, s, v, CASE WHEN ns - s <= 900 THEN ns - s ELSE 0 END AS d, nv - v AS dv,
    CAST(epoch(timezone('Europe/Berlin', date_trunc('day', here))) AS BIGINT) AS b0, CAST(epoch(timezone('Europe/Berlin', date_trunc('day', here) + INTERVAL 1 DAY)) AS BIGINT) AS b1 FROM n),
e AS (
  SELECT c, b0 AS b, 1 AS n, v, dv, d, 0 AS u0, least(d, b1 - s) AS u1 FROM g
  UNION ALL SELECT c, b1, 0, v, dv, d, b1 - s, d FROM g WHERE s + d > b1),
i AS (
  SELECT c, b, n, u1 - u0 AS k,
    CASE WHEN d = 0 THEN 0 ELSE 2 * v * (u1 - u0) + (dv * u1 * u1 - ((dv * u1 * u1) % d + d) % d) // d - (dv * u0 * u0 - ((dv * u0 * u0) % d + d) % d) // d END AS a FROM e),
t AS (SELECT c, b, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, CAST(sum(a) AS BIGINT) AS a FROM i GROUP BY c, b)
SELECT c AS client_id, b AS bucket_start, n AS n_points, k AS covered_seconds, a AS area2,
  CASE WHEN k > 0 THEN (a - (a % (2 * k) + 2 * k) % (2 * k)) // (2 * k) END AS avg_cents FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op8_line_dedup": _OP8, "op12_vector_codes": _op12(), "op13_resample": _OP13}
