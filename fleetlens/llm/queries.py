"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (centroid_threshold, decontaminate, html_extract, jaccard_join, lang_bitmask, minhash_hamming, multiset_hash,
                           packing, quality_gbdt, token_rans, toxicity, warc_merkle, whitening)
from fleetlens.llm.common import read_table as table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Build) -> Build:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


_OP1_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP1_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, s, s + 9) AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_OP1_WORDS}, []) AS w FROM documents),
hit AS (SELECT d.r, d.s, win.item, d.k
        FROM (SELECT r, s, k, list_slice(w, s, s + k - 1) AS g
              FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, sizes)) d
        JOIN win ON d.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN items USING (r)"""


_LINK_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM words),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT t FROM sh GROUP BY t HAVING count(*) > 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id WHERE a.t IN (SELECT t FROM rare)
        AND 100 * least(a.n, b.n) >= @NUM * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= @NUM * (any_value(a.n) + any_value(b.n) - count(*))),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id@MORE
FROM sets s LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON s.doc_id = c.a"""

OP2_SQL = _LINK_SQL.replace("@NUM", "85").replace("@MORE", "")
OP11_SQL = _LINK_SQL.replace("@NUM", "80").replace("@MORE", ", coalesce(c.c, s.doc_id) = s.doc_id AS kept")


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query("op2_jaccard_join", OP2_SQL)
def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4_SQL = """
WITH rec AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r, url FROM pages),
placed AS (SELECT page_id, page_id // 1024 AS file, r, strlen(r) AS length,
    coalesce(sum(strlen(r)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM rec)
SELECT page_id, file, CAST(start AS BIGINT) AS start, length, sha256(r) AS record_sha256,
    CASE WHEN page_id % 307 = 5 THEN NULL WHEN page_id % 211 = 3 THEN sha256(left(r, -1) || 'x') ELSE sha256(r) END AS replica_sha256,
    CASE WHEN page_id % 307 = 5 THEN 'missing' WHEN page_id % 211 = 3 THEN 'damaged' ELSE 'intact' END AS state
FROM placed"""


@query("op4_warc_merkle", OP4_SQL)
def op4_warc_merkle(spark, sf_dir):
    """Audits a replica of all pages that lost every record with
    page_id % 307 = 5 and has the last byte changed where page_id % 211 = 3.
    Its records are hashed from their own bytes."""
    damaged = F.when(F.col("page_id") % 211 == 3, F.concat(F.expr("substring(record, 1, char_length(record) - 1)"), F.lit("x")))
    written = warc_merkle.records(table(spark, sf_dir, "pages")).withColumn("copy_hash", F.sha2(F.coalesce(damaged, F.col("record")), 256))
    both = warc_merkle.leaves(written, "copy_hash")
    replica = both.where("page_id is null or page_id % 307 != 5").select("page_id", "file", "start", "length", F.col("copy_hash").alias("hash"))
    return warc_merkle.fixity_report(both.drop("copy_hash"), replica)


@query("op5_token_files")
def op5_token_files(spark, sf_dir):
    import public_tokenizers
    return token_rans.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_html_text")
def op6_html_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return quality_gbdt.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_multiset_hash")
def op9_multiset_hash(spark, sf_dir):
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10_language(spark, sf_dir):
    return lang_bitmask.language(table(spark, sf_dir, "documents"))


@query("op11_minhash_dedup", OP11_SQL)
def op11_minhash_dedup(spark, sf_dir):
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


def _op12_sql(rounds: int = 5) -> str:
    near = """SELECT r, min(d * 64 + c) AS near FROM (SELECT v.r, c.c,
        CAST(list_sum(list_transform(v.q, lambda x, i: (x - c.q[i]) * (x - c.q[i]))) AS BIGINT) AS d FROM v, {c} c) GROUP BY r"""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
        FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 40))"""]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(g.q, c{i}.q) AS q FROM c{i} LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM (
            SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT near % 64 AS c, unnest(range(64)) AS p, unnest(v.q) AS x FROM a{i} JOIN v USING (r)) GROUP BY c, p) GROUP BY c) g USING (c))""")
    parts.append(f"final AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(near % 64 AS INTEGER) AS cluster, near // 64 AS distance,
    CAST(sum(near // 64) OVER (PARTITION BY near % 64) AS BIGINT) AS cluster_inertia, CAST(sum(near // 64) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM final JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = near % 64"""


OP12_SQL = _op12_sql()


@query("op12_centroid_clusters", OP12_SQL)
def op12_centroid_clusters(spark, sf_dir):
    return centroid_threshold.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
