"""The queries of this subpackage, and the SQL that a single-node engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, embeddings, labelled_pages, lm, mixing, negatives, pages, quality, sharding, simhash, tokens, toxicity, urls, whitening
from geoloom.llm.text import bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that aren't held out."""
    return table(spark, sf_dir, "labels").where(bucket(F.col("doc_id"), 5) != 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.train_and_score(table(spark, sf_dir, "documents"), learned_labels(spark, sf_dir))
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, learned_labels(spark, sf_dir))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")  # the shards that take them are mix's own column


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 5) == 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


@cache
def page_model() -> pages.Model:
    """The page model of labelled pages, trained once in a process."""
    return pages.train(labelled_pages.pages())


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"), page_model())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
         FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fits USING (page_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s FROM bk),
dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k),
ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s FROM dk),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n_shingles) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), ':' || coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM d GROUP BY source),
rounds AS (
  SELECT source, source_size, weight, 0 AS k, (SELECT sum(source_size) FROM s) * weight / (SELECT sum(weight) FROM s) AS target FROM s
  UNION ALL
  SELECT source, source_size, weight, k + 1,
         CASE WHEN target >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
              ELSE (sum(source_size) OVER () - sum(CASE WHEN target >= 3 * source_size THEN 3 * source_size ELSE 0 END) OVER ()) * weight
                   / sum(CASE WHEN target >= 3 * source_size THEN 0 ELSE weight END) OVER () END
  FROM rounds WHERE k < 40),
t AS (SELECT source, source_size, target, CAST(least(4096, pow(2, floor(log2(greatest(min(target) FILTER (target > 0) OVER () / 64, 1))))) AS BIGINT) AS block FROM rounds WHERE k = 40),
seats AS (SELECT source, row_number() OVER (ORDER BY target / (2 * u.s + 1) DESC, source NULLS LAST, u.s) AS r, block, sum(DISTINCT 0) OVER () AS z
          FROM t, unnest(range(0, CAST(ceil(2 * target / block) AS BIGINT) + 4)) AS u(s) WHERE target > 0),
q AS (SELECT source, count(*) * any_value(block) AS quota FROM seats WHERE r <= (SELECT CAST(round(sum(target) / any_value(block)) AS BIGINT) FROM t WHERE target > 0) GROUP BY source),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(coalesce(q.quota, 0), 3 * t.source_size) AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN quota // source_size * size + greatest(least(start + size, quota % source_size) - start, 0) ELSE 0 END AS BIGINT) AS taken
FROM p
"""

OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same WHERE r <= 5 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_output": op7_token_output,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_lm_score": op10_lm_score,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_extraction": op12_html_extraction,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL, "op9_mixing": OP9_SQL, "op11_hard_negatives": OP11_SQL}
