"""From raw documents to token ids: five stages, each a table that the next one reads.

Every stage is a function of (spark, docs, folder): `docs` is what the stage before kept, in the
columns of `documents`, and `folder` holds the other tables. Stages write nothing themselves.

1. toxicity: documents that the network finds toxic go.
2. exact copies: of equal texts the row with the largest id stays.
3. near copies: of texts linked by SimHash the row with the smallest id stays.
4. mixing: documents are repeated or left out to meet the sources' targets, in training order.
5. tokens: byte-level BPE; the last table has ids' and decoded texts' digests instead of texts, and the
   `position` of each row in the training order, from 1.

Null texts pass as empty ones. An empty table stays empty through all stages. Repeated rows are
exact copies, of which one stays. Copies of equal ids are ordered by a hash of their text. Columns
beyond those of `documents` are left out, whatever their names. The mixed table is written in
training order, so a row's file and its place in the file are its position, and the copies of a
document are told apart by it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm import exact_dedup, mixing, queries, simhash, toxicity
from stowage.llm.common import read
from stowage.session import working_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    net = toxicity.learn(docs, read(spark, folder, "labels"))
    return toxicity.score(docs.select(*COLUMNS), net, to="__score").where(F.col("__score") < 0.5).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs.select(*COLUMNS), queries.arrives_later())


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def in_parts(docs: DataFrame) -> DataFrame:
    """`docs` with __part and __row: the file and the place in it, or where there are no files the partition."""
    try:
        return docs.select(
            *COLUMNS, F.col("_metadata.file_path").alias("__part"), F.col("_metadata.row_index").alias("__row")
        )
    except AnalysisException:  # not read from files
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return docs.select(
            *COLUMNS, F.format_string("part-%d", F.spark_partition_id()).alias("__part"), within.alias("__row")
        )


def tokenise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    placed = in_parts(docs)
    found = queries.encoded(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), "__part", "__row")
    # A row per file that was written: few, and texts do not move.
    number = F.regexp_extract("__part", "part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    ahead = Window.orderBy(number, "__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    starts = parts.select("__part", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__before"))
    position = (F.col("__before") + F.col("__row") + 1).alias("position")
    return found.join(starts, "__part").select(*(c for c in found.columns if c not in ("__part", "__row")), position)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

# A trained network decides in the first stage: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{working_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return docs
