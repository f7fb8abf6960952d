"""The numbered operators on the given tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    centroids,
    conversation_repair,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    neighbours,
    packing,
    quality,
    repeats,
    secret_scan,
    url_filter,
    word_windows,
)
from tidemark.llm.shared import crc_fold, prepared

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vocabulary files of public tokenizers.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

#: The rules (verdict, host, path prefix).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A page with one of these words puts its URL on the list.
RUDE_WORDS = ("disgusting", "idiot", "moron", "stupid", "trash")


def rude_urls(pages: DataFrame) -> DataFrame:
    """URLs of pages whose html holds a rude word."""
    return pages.filter(F.rlike("html", F.lit("|".join(RUDE_WORDS)))).select("url")


def found_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out), PIECE_VOCABULARY)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the rows of four folds of five."""
    fold = crc_fold(F.col("doc_id"), 5)
    return quality.train(docs.filter(fold != 0), labels.filter(fold != 0))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.score(docs, quality_model(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    predicted = F.when(F.col("score") >= LEAST_QUALITY, 1).otherwise(0)
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.balanced_copies(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, rude_urls(pages), URL_RULES)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.binary_pieces(docs, WORD_VOCABULARY, keep_ids=False).drop("ids")


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def without_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.remove_repeated_windows(_table(spark, sf_dir, "documents"))


def clustered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": found_secrets,
        "op2_language_id": languages,
        "op3_quality": quality_scores,
        "op4_mixing": mixed_sources,
        "op5_neighbours": nearest_vectors,
        "op6_url_filter": url_verdicts,
        "op7_suffix_dedup": without_repeats,
        "op8_packing": packed_pieces,
        "op9_jaccard_join": similar_documents,
        "op10_fingerprints": document_fingerprints,
        "op11_conversation_repair": repaired_conversations,
        "op12_word_windows": without_repeated_windows,
        "op13_centroids": clustered_vectors,
    }


#: op6 in DuckDB: rules written out, the list joined without a filter.
URL_SQL = r"""
WITH parts AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id, html, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|ref)(?:=|$)'))) AS query
  FROM parts
), keyed AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key
  FROM split
), listed AS (
  SELECT DISTINCT url_key FROM keyed
  WHERE regexp_matches(html, 'disgusting|idiot|moron|stupid|trash') AND url_key IS NOT NULL
), ruled AS (
  SELECT *, '.' || host AS h, url_key IS NOT NULL AND url_key IN (SELECT url_key FROM listed) AS on_list FROM keyed
), named AS (
  SELECT *, CASE
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM ruled
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR on_list THEN 'block' ELSE 'allow' END AS verdict,
  url_key, on_list
FROM named
"""


#: op12 in DuckDB: every window written out.
WINDOW_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT r, p, array_to_string(words[p:p + 34], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM texts)
), repeated AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM windows SEMI JOIN repeated USING (w)
), words AS (
  SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM texts
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

#: One round of op13 in DuckDB: numbers of the nearest centroids (a), and the floor of their means (c).
_ROUND_SQL = """
a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT r, cluster, sum((x - y) * (x - y)) AS d FROM v JOIN c{k} USING (i) GROUP BY r, cluster) GROUP BY r
), c{n} AS MATERIALIZED (
  SELECT cluster, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y
  FROM c{k} LEFT JOIN (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (r) GROUP BY cluster, i) USING (cluster, i)
)"""

#: op13 in DuckDB.
CENTROID_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), v AS MATERIALIZED (
  SELECT r, unnest(x) AS x, unnest(range(64)) AS i FROM kept
), c0 AS MATERIALIZED (
  SELECT cluster, unnest(x) AS y, unnest(range(64)) AS i
  FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster FROM kept) WHERE cluster < 16
), """
    + ", ".join(_ROUND_SQL.format(k=k, n=k + 1) for k in range(4))
    + """, named AS (
  SELECT cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster
)
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a3 USING (r) JOIN named USING (cluster)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": URL_SQL, "op12_word_windows": WINDOW_SQL, "op13_centroids": CENTROID_SQL}
