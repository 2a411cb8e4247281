"""The operators as queries over the driver's tables, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm import decontaminate, html_text, language, nearest, packing, pii, secrets, simhash, token_count, url_filter
from tidelark.llm.common import span_digest

TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", *[c.alias(k) for k, c in span_digest(F.col("spans"), secrets.BASE).items()])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", "vec_id", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(k) for k, c in span_digest(F.col("spans"), pii.BASE).items()])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_url_filter, op3_language, op4_nearest, op5_pii, op6_best_fit_packing, op7_html_text, op8_decontaminate, op9_token_count, op10_simhash)}

URL_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS k FROM pages),
raw AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT k, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM raw),
fits AS (
  SELECT p.k, u.host || u.path AS rule, u.verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(u.host) + length(u.path) DESC, length(u.host) DESC, u.verdict DESC) AS n
  FROM parts p JOIN rules u ON (p.host = u.host OR p.host LIKE '%.' || u.host) AND starts_with(p.path, u.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)
"""

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCHMARK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[j:least(j + 9, len(w))] AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS j FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT k, n, w, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT a.k, a.j, a.n, x.item_id FROM spots a JOIN wins x ON x.win = a.w[a.j:a.j + a.n - 1]),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(j, j + n - 1)) AS p FROM hits) GROUP BY k),
its AS (SELECT k, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hits GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""

ORACLE: dict[str, str] = {"op2_url_filter": URL_SQL, "op8_decontaminate": BENCHMARK_SQL}
