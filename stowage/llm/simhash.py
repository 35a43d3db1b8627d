"""SimHash fingerprints and their near-duplicates by an index over byte positions.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes, each
at its own position. Of the first 7 positions they then agree in at least 4, so the index posts
a fingerprint under each of the 35 choices of 4 positions. The lists that a pair meets in are
gathered per pair: their positions together are all of the first 7 in which its bytes are equal,
and the byte at the eighth is compared. Pairs whose tally stays below the guaranteed 5 are
dropped, and only the pairs left are verified bit by bit. Equal fingerprints are one node, however
many documents share it.

Lists of more than `dense` fingerprints (a large family of near copies) are not paired out.
Their fingerprints are first linked with those one bit away, through 64 masked keys that at most
two fingerprints share. They are then posted under all 56 choices of 5 positions, and pairs are
made only in lists that still hold several components. No link is lost either way.

Null and empty texts have no shingles: fingerprint zero, linked like any other. A text of one or
two words is one shingle. Repeated rows share a fingerprint. Null ids are never the smallest id
unless a component has no other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import small_batches, whole
from stowage.llm.components import components
from stowage.session import settle

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
DENSE = 32
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = text.encode().lower().split()  # of bytes: lowers A-Z and splits on ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, "i8")
    for begin in range(0, n, CHUNK):
        stop = min(n, begin + CHUNK)
        codes = [hashed(join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(begin, stop)]
        bits = np.unpackbits(np.array(codes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, column: str = "text", to: str = "fp") -> DataFrame:
    """`docs` with a bigint column `to`, and without `column`."""
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (column, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(text or "") for text in batch.column(column).to_pylist()]
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(codes, pa.int64())], [*(f.name for f in fields), to])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.LongType())]))


def _same(x: Column, position: int) -> Column:
    return (F.shiftrightunsigned(x, 8 * position).bitwiseAND(F.lit(255)) == 0).cast("int")


def postings(nodes: DataFrame, choose: int, of: int) -> DataFrame:
    """`nodes` once per choice of positions: `at` (bit set of positions), `upto`, `kept` (their bytes)."""
    lists = []
    for positions in combinations(range(of), choose):
        mask = sum(255 << 8 * p for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        at = sum(1 << p for p in positions)
        lists.append(
            F.struct(
                F.lit(at).alias("at"),
                F.lit((2 << positions[-1]) - 1).alias("upto"),
                F.col("fp").bitwiseAND(F.lit(signed)).alias("kept"),
            )
        )
    return nodes.select("*", F.explode(F.array(*lists)).alias("list")).select(*nodes.columns, "list.*")


def meetings(posts: DataFrame) -> DataFrame:
    """(a, b, at) for every list in which a pair a < b meets."""
    left = posts.select("at", "kept", F.col("fp").alias("a"))
    # Spark sizes postings like the nodes they were made of, 35 times too low: never to be broadcast.
    right = posts.select("at", "kept", F.col("fp").alias("b")).hint("merge")
    return left.join(right, ["at", "kept"]).where("a < b").select("a", "b", "at")


def tallies(met: DataFrame) -> DataFrame:
    """(a, b, shared): how many bytes a pair that meets has in common, each at its own position."""
    last = _same(F.col("a").bitwiseXOR(F.col("b")), BYTES - 1)
    gathered = met.groupBy("a", "b").agg(F.bit_or("at").alias("at"))
    return gathered.select("a", "b", (F.bit_count("at") + last).alias("shared"))


def _links(posts: DataFrame) -> DataFrame:
    """Verified pairs (a, b) among those whose tally reaches the guaranteed number."""
    candidates, _ = settle(tallies(meetings(posts)).where(F.col("shared") >= MIN_SHARED).select("a", "b"))
    return candidates.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def _links_apart(posts: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of two components. Lists are of MIN_SHARED positions here, so meeting in one
    reaches the number; a pair that meets in several counts in the first only."""
    left = posts.select("at", "upto", "kept", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    right = posts.select("at", "kept", F.col("fp").alias("b"), F.col("root").alias("root_b")).hint("merge")
    x = F.col("a").bitwiseXOR(F.col("b"))
    equal = sum((_same(x, p) * F.lit(1 << p) for p in range(BYTES)), F.lit(0))
    first = equal.bitwiseAND(F.col("upto")) == F.col("at")
    wanted = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & first & (F.bit_count(x) <= MAX_BITS)
    return left.join(right, ["at", "kept"]).where(wanted).select("a", "b")


def _one_bit_links(nodes: DataFrame) -> DataFrame:
    masks = [-1 - (1 << bit if bit < 63 else -(1 << 63)) for bit in range(64)]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(mask)) for mask in masks))).alias("bit", "key")
    ends = nodes.select("fp", keys).groupBy("bit", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    return ends.where("a < b").select("a", "b")


def near_pairs(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `nodes` (fp) at MAX_BITS or fewer bits.

    All such pairs are returned, except within a dense list pairs that other links connect.
    """
    posts = postings(nodes, MIN_SHARED - 1, BYTES - 1)
    large, how_many = settle(posts.groupBy("at", "kept").count().where(F.col("count") > dense).select("at", "kept"))
    if how_many == 0:
        return _links(posts)
    usual = posts.join(large, ["at", "kept"], "left_anti")
    crowded, _ = settle(posts.join(large, ["at", "kept"], "left_semi").select("fp").distinct())
    near, _ = settle(_one_bit_links(crowded))
    roots = components(near, "a", "b").withColumnRenamed("node", "fp")
    labelled = crowded.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    finer = postings(labelled, MIN_SHARED, BYTES)
    mixed = finer.groupBy("at", "kept").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    rest = finer.join(mixed.select("at", "kept"), ["at", "kept"], "left_semi")
    return _links(usual).unionAll(near).unionAll(_links_apart(rest)).distinct()


def near_duplicates(fingerprinted: DataFrame, dense: int = DENSE) -> DataFrame:
    """Add `component_id`, the smallest doc_id reachable over links, and `root_fp`, the component's
    smallest fingerprint, to rows (doc_id, fp, …)."""
    nodes, _ = settle(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    links, _ = settle(near_pairs(nodes.select("fp"), dense))
    roots = components(links, "a", "b").withColumnRenamed("node", "fp")
    rooted, _ = settle(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes, _ = settle(rooted.join(least, "root").select("fp", "component_id", F.col("root").alias("root_fp")))
    return fingerprinted.join(classes, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row per component: the smallest id, then the smallest hash of the text."""
    hashed = docs.select("doc_id", whole().alias("text")).withColumn("th", F.xxhash64("text"))
    rows, _ = settle(with_fingerprints(hashed))
    # Rows without an id come after all others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    chosen = near_duplicates(rows).groupBy("root_fp").agg(F.min(order).alias("one"))
    stays = chosen.select(F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th")).hint("merge")
    keyed = docs.withColumn("__hash", F.xxhash64(whole()))
    match = keyed["doc_id"].eqNullSafe(stays["__id"]) & (keyed["__hash"] == stays["__th"])
    return keyed.join(stays, match, "left_semi").dropDuplicates(["doc_id", "__hash"]).select(docs.columns)
