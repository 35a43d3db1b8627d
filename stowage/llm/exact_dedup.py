"""Exact duplicates of an incoming batch against an immutable snapshot, and within the batch.

A snapshot is a table of (digest, keep_id, copies), one row per distinct text, cut into buckets
by digest. For each bucket a static binary fuse filter is built once; a snapshot never changes,
so neither does its filter. Digests of a batch are first grouped among themselves, which takes
only the largest id and a count per digest. Then each distinct digest is tested against the
filter of its bucket. What the filter does not know is new. What it may know is joined to the
exact rows of the bucket, and the texts behind the two rows are compared byte for byte.

A bucket holds some thousand digests whatever the corpus size, since the number of buckets
follows the snapshot. Texts move only for the byte check.

Null texts count as empty and equal each other. Of equal texts the row with the largest id
stays; null ids are the smallest. Rows that repeat both id and text are counted one by one and
share one verdict. Columns besides `doc_id` and `text` play no part. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm import fuse
from stowage.llm.common import whole
from stowage.session import settle

BUCKET_DIGESTS = 32_768
LEAST_BUCKETS = 128


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the snapshot: its filter."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *fuse.build(_keys(part["digest"])))])

    keyed = snapshot.select(bucket_of(buckets).alias("bucket"), "digest")
    fields = "bucket bigint, seed bigint, length bigint, segments bigint, slots binary"
    return keyed.groupBy("bucket").applyInPandas(build, fields)


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """`batch` (one row per digest) with `known`: false if the snapshot surely lacks the digest."""

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.zeros(len(left), bool)
        if len(left) and len(right):
            f = right.iloc[0]
            known = fuse.contains(_keys(left["digest"]), int(f.seed), int(f.length), int(f.segments), f.slots)
        return left.drop(columns="bucket").assign(known=known)

    keyed = batch.select(bucket_of(buckets).alias("bucket"), *batch.columns)
    fields = "digest binary, keep_id bigint, copies bigint, known boolean"
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, fields)


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The digests of `pairs` (digest, old_id, new_id) whose two texts are equal byte for byte."""
    wanted = pairs.select(
        "digest", F.explode(F.array(F.struct(F.col("old_id").alias("id")), F.struct(F.col("new_id").alias("id"))))
    ).select("digest", "col.id")
    texts = docs.select("doc_id", whole().alias("text"))
    # A merge join at every size: sending the pairs to all tasks would only do for a few.
    wanted = wanted.hint("merge")
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"])).where(digest(F.col("text")) == F.col("digest"))
    return (
        found.groupBy("digest")
        .agg(F.min("text").alias("a"), F.max("text").alias("b"))
        .where(F.col("a") == F.col("b"))
        .select("digest")
    )


def deduplicate(docs: DataFrame, incoming: Column) -> DataFrame:
    """Judge every row of `docs`; `incoming` tells the batch from the snapshot it is held against.

    Returns doc_id, digest, keep_id, copies, kept.
    """
    rows, _ = settle(docs.select("doc_id", digest(whole()).alias("digest"), incoming.alias("incoming")))
    snapshot, size = settle(grouped(rows.where(~F.col("incoming"))))
    buckets = max(LEAST_BUCKETS, size // BUCKET_DIGESTS)
    screened, _ = settle(screen(grouped(rows.where("incoming")), build_filters(snapshot, buckets), buckets))

    old = snapshot.withColumnsRenamed({"keep_id": "old_id", "copies": "old_copies"})
    matches, _ = settle(
        screened.where("known").withColumnsRenamed({"keep_id": "new_id", "copies": "new_copies"}).join(old, "digest")
    )
    equal = matches.join(same_bytes(docs, matches), "digest", "left_semi").select(
        "digest",
        F.greatest("old_id", "new_id").alias("keep_id"),
        (F.col("old_copies") + F.col("new_copies")).alias("copies"),
    )
    # Groups of more than one row; everything else stays as it is.
    alone = snapshot.withColumn("incoming", F.lit(False)).unionByName(
        screened.drop("known").withColumn("incoming", F.lit(True))
    )
    merged = (
        alone.alias("own")
        .join(equal.alias("both"), "digest", "left")
        .select(
            "digest",
            "incoming",
            F.when(F.col("both.copies").isNull(), F.col("own.keep_id")).otherwise(F.col("both.keep_id")).alias("keep_id"),
            F.coalesce("both.copies", "own.copies").alias("copies"),
        )
        .where("copies > 1")
    )
    return rows.join(merged, ["digest", "incoming"], "left").select(
        "doc_id",
        "digest",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, incoming: Column) -> DataFrame:
    """`docs` without the rows that an equal text replaces; repeated rows of one id stay once."""
    stays = deduplicate(docs, incoming).where("kept").select(F.col("doc_id").alias("__id"), "digest").hint("merge")
    keyed = docs.withColumn("__digest", digest(whole()))
    match = keyed["doc_id"].eqNullSafe(stays["__id"]) & (keyed["__digest"] == stays["digest"])
    return keyed.join(stays, match, "left_semi").dropDuplicates(["doc_id", "__digest"]).select(docs.columns)
