"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
DIGITS = "0123456789abcdef"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; everything else stays, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda that names a column of an earlier projection may get that column's
    expression inlined and evaluated for every element; a lambda variable can't.
    """
    return F.transform(F.array(value), body)[0]


def fold_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def by_task(result: str, build: Callable[[], Callable]) -> Callable:
    """An Arrow function of columns; ``build()`` is called once in every task.

    What ``build`` returns takes one Arrow array for each column and gives one.
    """
    made: list[Callable] = []

    @F.arrow_udf(result)
    def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
        if not made:
            made.append(build())
        return made[0](first, *rest)

    return run
