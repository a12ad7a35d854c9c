"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, jaccard, language, licenses, packing, scoring, secrets, training_order, url_filter
from .common import VOCABULARY, document_remainder, table

# Fixed values of the query's contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_near(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), spark.createDataFrame(licenses.KNOWN, "license_id string, text string"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(document_remainder(4) == 2, F.lit(False))
    model = language.learn(docs, F.coalesce(document_remainder(4) != 2, F.lit(False)))
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", *[F.col(f"contamination.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan_documents(docs, secrets.learn(docs))
    return scanned.select("doc_id", *[F.col(f"secrets.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score_documents(docs, scoring.trained_on(), VOCABULARY)
    return scored.withColumn("held_out", F.coalesce(document_remainder(scoring.HELD_OUT) == 0, F.lit(False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_fingerprint": op1_edit_fingerprint,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_training_order": op8_training_order,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_score": op10_lm_score,
    "pipeline": corpus_pipeline.run,
}

def _canonical_sql(text: str) -> str:
    form = f"lower(regexp_replace(coalesce({text}, ''), '(?im)^[^\\n\\p{{L}}]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g'))"
    for other, one in licenses.SPELLINGS:
        form = f"replace({form}, '{other}', '{one}')"
    return f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_KNOWN_SQL = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in licenses.KNOWN)

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""
WITH d AS (SELECT doc_id, {_canonical_sql("text")} AS form FROM documents),
     k AS (SELECT sha256({_canonical_sql("text")}) AS h, min(name) AS license_id FROM (VALUES {_KNOWN_SQL}) t(name, text) GROUP BY 1)
SELECT doc_id, CASE WHEN form != '' THEN sha256(form) END AS canonical_sha256, k.license_id FROM d LEFT JOIN k ON form != '' AND sha256(form) = k.h
""",
    "op4_url_filter": r"""
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(rule, rule_host, rule_path, rule_verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), numbered AS (
    SELECT *, row_number() OVER () AS n FROM parts
), best AS (
    SELECT p.n, max_by(struct_pack(rule := r.rule, verdict := r.rule_verdict), length(r.rule)) AS b
    FROM numbered p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
    GROUP BY p.n
)
SELECT p.page_id, p.host, p.path, b.b.rule AS rule, coalesce(b.b.verdict, 'allow') AS verdict
FROM numbered p LEFT JOIN best b ON p.n = b.n
""",
    "op5_decontaminate": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
    SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), places AS (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
), found AS (
    SELECT p.doc_id, p.i, p.k, x.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM places) p JOIN windows x ON p.k = x.k AND p.win = x.win
), hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, coalesce(i.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, array_to_string(w, ' ') AS shingle FROM d WHERE len(w) BETWEEN 1 AND 2
    UNION SELECT doc_id, array_to_string(w[i:i + 2], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id != y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reached AS (
    SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, b FROM reached r JOIN links ON r.other = a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) r ON r.doc_id = d.doc_id
""",
}
