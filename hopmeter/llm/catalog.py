"""Registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.llm import (
    bpe, collocations, decontam, langid, licenses, lm, merkle, pii, quality, shards, simhash, tokenfile, urlrules,
)
from hopmeter.llm.common import documents


# The rules of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda rule: F.struct(*[F.lit(x).alias(n) for x, n in zip(rule, ("host", "path", "verdict"))])
    rules = spark.range(1).select(F.inline(F.array(*map(row, URL_RULES))))
    return urlrules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair of which the document holds the item."""
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.digests(F.col("text")).alias("found")
    return documents(spark, sf_dir).select("doc_id", found).select("doc_id", "found.*")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(F.col("text")).alias("found")
    return documents(spark, sf_dir).select("doc_id", found).select("doc_id", "found.*")


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as shards, and every document read back by its key."""
    store = tokenfile.write(documents(spark, sf_dir), "doc_id", F.col("text"))
    return tokenfile.read(store).select(
        F.col("key").cast(store.key_type).alias("doc_id"), "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and the root that a tampered copy of some would give."""
    def fields(n_chars: Column) -> list[Column]:
        return [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]

    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    other = F.when(changed, merkle.leaf_digest(fields(F.col("n_chars") + 1)))
    manifest = merkle.build(
        documents(spark, sf_dir), fields(F.col("n_chars")), F.col("lang"), F.col("doc_id"), {"other": F.unhex(other)}
    )
    proved = merkle.proofs(manifest).withColumn(
        "folded_root", merkle.folded(F.coalesce(F.lower(F.hex("other")), "leaf"), F.col("steps"))
    )
    return proved.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT *, host = 'com' OR host LIKE '%.com' AS com, host = 'net' OR host LIKE '%.net' AS net,
         host = 'example.com' OR host LIKE '%.example.com' AS ex,
         host = 'www.example.com' OR host LIKE '%.www.example.com' AS www
  FROM cut),
ruled AS (
  SELECT *, CASE WHEN www AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN ex AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN net AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN net AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN com AND path LIKE '/%' THEN 'com/' END AS rule
  FROM fit)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can express the operator: no checksum, model or automaton is among its functions."""
    return {"op1_url_filter": URL_SQL}
