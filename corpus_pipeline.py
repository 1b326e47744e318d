"""Training-data pipeline over ``documents``: five stages, each a table of its own.

``run`` writes every stage to the shared folder and reads it again as the next
stage's documents, so a lost executor costs at most one stage. All stages but the
last return the columns they got. Null and empty texts fail the first stage; an
empty table passes through all of them; further columns are carried along, also if
their names occur in an operator's own tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.llm import bpe, decontam, pii, quality, simhash
from hopmeter.llm.common import documents
from hopmeter.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed and the learned quality rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows."""
    found = pii.redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; ``round_trip`` tells whether they decode to it again."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("encoded", bpe.encoded(F.col("text"))).select(
        *docs.columns, F.size("encoded.ids").cast("bigint").alias("n_tokens"), F.col("encoded.ids").alias("ids"),
        (F.sha2(text, 256) == F.col("encoded.decoded_sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_texts),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express fingerprints, edit distance search or the learned models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
