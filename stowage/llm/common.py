"""What the text operators share: whole texts, Arrow batches of a bounded size, group hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch. Texts may be long, so a batch must not hold ten thousand of them.
BATCH_ROWS = 512
# What separates words: ASCII white space, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def whole(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once. A runtime setting, so any session takes it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Within, a Python worker takes up to `rows` rows at once, or fewer as soon as they have `size` bytes."""
    keys = {f"spark.sql.execution.arrow.max{kind}PerBatch": str(most) for kind, most in (("Records", rows), ("Bytes", size))}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def words(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(f"({WORD})"), F.lit(1))
