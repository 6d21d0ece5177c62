"""The corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .embedneighbours import near_vectors
from .exactdedup import exact_duplicates
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .quality import resample
from .repeats import repeated_passages
from .runtime import table
from .tokencount import count_tokens
from .toxicity import fit, score_toxicity
from .urlfilter import judge_urls

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024, with_ids=False).drop("ids")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_embedneighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_urlfilter": op4_urlfilter,
    "op5_repeats": op5_repeats,
    "op6_tokencount": op6_tokencount,
    "op7_toxicity": op7_toxicity,
    "op8_embedneighbours": op8_embedneighbours,
    "op9_exactdedup": op9_exactdedup,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op4_urlfilter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS row_id, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, hits.rule AS rule, coalesce(hits.verdict, 'allow') AS verdict
FROM split LEFT JOIN hits ON split.row_id = hits.row_id AND hits.n = 1
""",
    "op9_exactdedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
}
