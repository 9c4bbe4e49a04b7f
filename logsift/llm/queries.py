"""The queries of the corpus operators, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, licenses, near_dedup, neighbours, pieces, pii, quality, secrets, spelling, tokens,
               vector_codes, warc)
from .common import read_table


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_licenses(spark, sf_dir):
    return licenses.digest(licenses.license_notices(_documents(spark, sf_dir)))


def op3_token_counts(spark, sf_dir):
    counts = tokens.token_counts(_documents(spark, sf_dir))
    return counts.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op4_pieces(spark, sf_dir):
    return pieces.round_trip(_documents(spark, sf_dir))


def op5_secrets(spark, sf_dir):
    return secrets.digest(secrets.secrets(_documents(spark, sf_dir)))


def op6_neighbours(spark, sf_dir):
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


def op7_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    weights = quality.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"), ~quality.held_out())
    scored = quality.scores(docs, weights)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contamination(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_warc(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_pii(spark, sf_dir):
    return pii.digest(pii.personal_data(_documents(spark, sf_dir)))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op12_vector_codes(spark, sf_dir):
    return vector_codes.digest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_licenses, op3_token_counts, op4_pieces, op5_secrets, op6_neighbours, op7_quality,
    op8_decontaminate, op9_warc, op10_pii, op11_exact_dedup, op12_vector_codes, op13_spelling)}

ORACLE_SQL = {
    "op1_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(array_to_string(list_sort(list(g)), '|')) AS h FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN sym l ON r.other = l.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM n)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM documents JOIN comp USING (doc_id) LEFT JOIN class USING (doc_id)""",
    "op6_neighbours": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id,
    sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(generate_series(1, len(e.v)),
         lambda i: (e.v[i] - q.v[i]) * (e.v[i] - q.v[i]))), lambda a, x: a + x)) AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "op9_warc": """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p),
k AS (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last END AS refers_to, true AS valid FROM k""",
    "op11_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t WINDOW g AS (PARTITION BY t)""",
    "op12_vector_codes": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, i, v[i * 4 + 1:i * 4 + 4] AS p FROM v, range(16) r(i)),
b0 AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS j, p FROM parts
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a0 AS (SELECT p.vec_id, p.i, p.p, arg_min(b.j, list_sum(list_transform(generate_series(1, 4), lambda t: (p.p[t] - b.p[t]) * (p.p[t] - b.p[t])))::BIGINT * 64 + b.j) AS j FROM parts p JOIN b0 b USING (i) GROUP BY ALL),
m0 AS (SELECT i, j, list_transform(generate_series(1, 4), lambda t: (s[t] - ((s[t] % n) + n) % n) // n) AS p FROM (
  SELECT i, j, count(*) AS n, [sum(p[1])::BIGINT, sum(p[2])::BIGINT, sum(p[3])::BIGINT, sum(p[4])::BIGINT] AS s FROM a0 GROUP BY ALL)),
b1 AS (SELECT i, j, coalesce(m.p, b.p) AS p FROM b0 b LEFT JOIN m0 m USING (i, j)),
a1 AS (SELECT p.vec_id, p.i, p.p, arg_min(b.j, list_sum(list_transform(generate_series(1, 4), lambda t: (p.p[t] - b.p[t]) * (p.p[t] - b.p[t])))::BIGINT * 64 + b.j) AS j FROM parts p JOIN b1 b USING (i) GROUP BY ALL),
m1 AS (SELECT i, j, list_transform(generate_series(1, 4), lambda t: (s[t] - ((s[t] % n) + n) % n) // n) AS p FROM (
  SELECT i, j, count(*) AS n, [sum(p[1])::BIGINT, sum(p[2])::BIGINT, sum(p[3])::BIGINT, sum(p[4])::BIGINT] AS s FROM a1 GROUP BY ALL)),
b2 AS (SELECT i, j, coalesce(m.p, b.p) AS p FROM b1 b LEFT JOIN m1 m USING (i, j)),
c AS (SELECT p.vec_id, p.i, arg_min(b.j, d * 64 + b.j) AS j, min(d) AS d FROM (
  SELECT p.vec_id, p.i, b.j, list_sum(list_transform(generate_series(1, 4), lambda t: (p.p[t] - b.p[t]) * (p.p[t] - b.p[t])))::BIGINT AS d FROM parts p JOIN b2 b USING (i)) p JOIN b2 b USING (i, j) GROUP BY ALL),
e AS (SELECT vec_id, string_agg(format('{:02x}', j), '' ORDER BY i) AS code, sum(d)::BIGINT AS error FROM c GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY i, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h""",
}
