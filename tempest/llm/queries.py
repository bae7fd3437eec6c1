"""Registered queries of the training-data operators and their DuckDB SQL.

Each ``opN_<name>`` applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tempest.llm import bytebpe, exactdedup, fertility, htmltext, linededup, mixing, ngramjoin, ranked, roles, simhash, toxicity, vectorcode, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_bundles(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


SQL["op1_warc_bundles"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


@query
def op2_exact_dedup(spark, sf_dir):
    return exactdedup.dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_role_repair(spark, sf_dir):
    return roles.repair(table(spark, sf_dir, "conversations"))


@query
def op4_line_blocks(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query
def op5_tokeniser_fertility(spark, sf_dir):
    return fertility.judged(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_byte_bpe(spark, sf_dir):
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                              public_tokenizers.PATTERN)


@query
def op8_ngram_join(spark, sf_dir):
    return ngramjoin.linked(table(spark, sf_dir, "documents"))


# Exact: every pair that shares a 5-gram.  The query's bands miss a pair at the threshold once in ten thousand.
SQL["op8_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * i >= 4 * (na.n + nb.n - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
degree AS (SELECT a, count(*) AS n_links FROM sides GROUP BY a)
SELECT reach.a AS doc_id, min(reach.b) AS class_id, count(*) AS class_size, coalesce(any_value(n_links), 0) AS n_links
FROM reach LEFT JOIN degree ON degree.a = reach.a GROUP BY reach.a
"""


@query
def op9_line_dedup(spark, sf_dir):
    return linededup.line_report(table(spark, sf_dir, "documents"))


SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hits AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, (h.key IS NOT NULL AND h.keep_id <> k.doc_id) AS dropped
  FROM keyed k LEFT JOIN hits h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op10_pareto_mix(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


SQL["op10_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT)
          + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap
  FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER rising, 0) AS cap_before, coalesce(sum(w) OVER rising, 0) AS w_before
  FROM w WINDOW rising AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (all_w - w_before) AS level FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * w THEN CAST(cap AS DOUBLE)
              ELSE (SELECT arg_min(level, cap / w) FROM l WHERE NOT cap <= level * w) * w END AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM p),
q AS (
  SELECT d.doc_id, d.size, r.*,
         CASE WHEN r.rest > 0 THEN (u / (1.0 - u)) * ((1.0 - rest / source_size) / (rest / source_size)) END AS q
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, q) AS tied
  FROM q)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN q IS NOT NULL AND CAST(2 * upto - tied AS DOUBLE) < 2.0 * rest THEN 1 ELSE 0 END) * size AS taken
FROM c
"""


@query
def op11_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)),
v AS (SELECT q, item_id, i.t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM i JOIN f ON i.t = f.t CROSS JOIN c),
s AS (
  SELECT q, item_id, doc_id, p.r,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM v JOIN p ON v.t = p.t JOIN n ON n.r = p.r CROSS JOIN c GROUP BY q, item_id, doc_id, p.r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query
def op12_vector_code(spark, sf_dir):
    return vectorcode.compress(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = vectorcode.PARTS, entries: int = vectorcode.ENTRIES, rounds: int = vectorcode.ROUNDS) -> str:
    """Plain Lloyd rounds over (row, position, dimension, component), one pair of tables a round."""
    steps = [f"""v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (
  SELECT r, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS j, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
b0 AS (SELECT p, r - 1 AS e, j, x AS c FROM x WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, x.p AS p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{k} b ON x.p = b.p AND x.j = b.j GROUP BY r, x.p, e)
  GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (
  SELECT b.p, b.e, b.j, CAST(coalesce(floor_mean, c) AS BIGINT) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, j, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
      SELECT x.p AS p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, e, j)) m
  ON b.p = m.p AND b.e = m.e AND b.j = m.j)""")
    return "WITH " + ",\n".join(steps) + f""",
o AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN o ON v.r = o.r CROSS JOIN s
"""


SQL["op12_vector_code"] = _lloyd_sql()


@query
def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
