"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target: its share by weight of all words, but at most `MAX_EPOCHS` times what
it holds; what a source cannot take is shared out again by weight. A source is read in the order
of a hash of its ids, epoch after epoch, until its target is met: a document is taken in an epoch
if its middle lies within the target, so the source's words miss the target by half a document
at most.

Each source also has a schedule: how strongly it is drawn at a time of the training run (0 to
1), linear between knots. Its integral, scaled to the target, is the source's cumulative demand
for words. Inverting that at the middle of a document gives the time at which the document is
due, its training position. Sorting all copies by position, in ranges, gives the mixed corpus.

Running sums never see a whole source in one task: a source is cut by the leading digits of the
hash, the cuts' totals are summed up first, and the sums within a cut follow.

Null texts and texts without words have size 0; they are placed like any other where their
source has words, and once where it has none. A null source is a source of its own, the last.
Null ids are hashed as an empty text, rows of one id are told apart by their text. Results
depend on the rows only. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import WORD, whole
from stowage.operators.stats import positions as ranked
from stowage.session import settle

MAX_EPOCHS = 3
CUT_ROWS = 4096
# Knots (time, strength) by weight: light sources early, heavy ones late.
SCHEDULES = {
    1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole(column), F.lit(WORD)).cast("bigint")


def source_key(column: str = "source") -> Column:
    """A key that is never null."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of `sizes` (__source, __size): total, weight and target."""
    totals = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"))
    # "+" sorts before "-", so the null source comes last; Spark compares strings by code point.
    named = ranked(totals, F.asc("__source"), name="__rank")
    weighed, _ = settle(named.withColumn("__weight", (F.col("__rank") - 1) % 3 + 1).drop("__rank"))
    room = F.col("__total") * MAX_EPOCHS
    per_weight, full = 0.0, -1
    while True:  # each round fills at least one more source, or is the last
        is_full = F.lit(per_weight) * F.col("__weight") > room
        row = weighed.agg(
            F.sum("__total").alias("all"),
            F.sum(F.when(is_full, room).otherwise(0)).alias("given"),
            F.sum(F.when(is_full, 0).otherwise(F.col("__weight"))).alias("weights"),
            F.count_if(is_full).alias("full"),
        ).first()
        if row["full"] == full or not row["weights"]:
            break
        full, per_weight = row["full"], (row["all"] - row["given"]) / row["weights"]
    return weighed.withColumn(
        "__target", F.least(F.lit(per_weight) * F.col("__weight"), F.col("__total") * F.lit(float(MAX_EPOCHS)))
    )


def due(share: Column, weight: Column) -> Column:
    """When a source's cumulative demand reaches `share` (0 to 1) of its target."""
    result = None
    for own, knots in SCHEDULES.items():
        spans = list(zip(knots, knots[1:]))
        areas = [(b - a) * (f + g) / 2 for (a, f), (b, g) in spans]
        total, done, found = sum(areas), 0.0, None
        for ((a, f), (b, g)), area in zip(spans, areas):
            left = share * total - F.lit(done)
            slope = (g - f) / (b - a)
            # Where f x + slope x² / 2 = left, in the form that also holds for slope 0.
            at = F.lit(a) + 2 * left / (F.lit(f) + F.sqrt(F.lit(f * f) + 2 * slope * left))
            done += area
            fits = share * total <= F.lit(done)
            found = F.when(fits, at) if found is None else found.when(fits, at)
        found = found.otherwise(F.lit(knots[-1][0]))
        result = F.when(weight == own, found) if result is None else result.when(weight == own, found)
    return result


def plan(docs: DataFrame) -> DataFrame:
    """`docs` with __size, __total, __weight, __target, __before (words of its source ahead), __copies."""
    tagged = docs.select(
        "*",
        source_key().alias("__source"),
        word_count().alias("__size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__order"),
        F.xxhash64(whole()).alias("__tie"),
    )
    sizes, rows = settle(tagged.select("__source", "__size", "__order"))
    per_source, _ = settle(targets(sizes))
    digits = max(1, math.ceil(math.log(max(1, rows / CUT_ROWS), 16)))
    cut = F.substring("__order", 1, digits).alias("__cut")
    ahead = Window.partitionBy("__source").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.groupBy("__source", cut).agg(F.sum("__size").alias("__held"))
    cuts = cuts.select("__source", "__cut", F.coalesce(F.sum("__held").over(ahead), F.lit(0)).alias("__cuts_before"))
    starts, _ = settle(cuts.join(per_source, "__source"))
    within = (
        Window.partitionBy("__source", "__cut")
        .orderBy("__order", F.asc_nulls_last("doc_id"), "__tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = tagged.select("*", cut).withColumn("__ahead", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    room = 2 * F.col("__target") - 2 * F.col("__before") - F.col("__size")
    copies = F.floor(room / (2 * F.col("__total"))).cast("bigint") + 1
    return (
        placed.join(starts, ["__source", "__cut"])
        .withColumn("__before", F.col("__ahead") + F.col("__cuts_before"))
        .withColumn(
            "__copies",
            F.when(F.col("__total") == 0, F.lit(1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(MAX_EPOCHS), copies))),
        )
        .drop("__tie", "__order", "__ahead", "__cuts_before", "__cut")
    )


def position(copy: Column) -> Column:
    """Training position of a planned row's copy number `copy` (from 0)."""
    middle = copy * F.col("__total") + F.col("__before") + F.col("__size") / F.lit(2.0)
    share = F.when(F.col("__target") > 0, middle / F.col("__target")).otherwise(F.lit(0.0))
    return due(share, F.col("__weight"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as they are taken, in the order of training."""
    copies = plan(docs).where("__copies > 0")
    numbered = copies.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies").cast("int") - 1)))
    placed = numbered.withColumn("__position", position(F.col("__copy")))
    return placed.orderBy("__position", "__source", "doc_id", "__copy").select(docs.columns)
