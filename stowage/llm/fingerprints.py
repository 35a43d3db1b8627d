"""Document fingerprints: Merkle trees over the paragraphs and sections of a text.

A text is cut into pieces: up to the end of a sentence or line, 64 letters at most. A paragraph
is the pieces up to a line end; its digest covers the digests of its pieces. A section is the
paragraphs up to a blank line or up to a paragraph whose digest starts with 0 or 1, so borders
come from the text and find themselves again behind an insertion; its digest covers those of
its paragraphs. The root covers the sections. All digests are SHA-256.

A fingerprint is the root and, shortened to 8 digits, every digest below it:
`root|section(paragraph[piece,piece];paragraph[piece])section(…)`. Equal texts have equal roots, and texts
of equal roots are equal. Below differing roots, only sections that the other tree lacks need a
look, and in them only the paragraphs that its differing sections lack, which locates an edit. The likeness of two fingerprints is twice
the number of pieces they share over the pieces they have, each distinct piece counted once.

Null counts as the empty text, which has a root and no pieces; two empty texts are alike 1, an
empty one and another 0. Everything is SQL expressions of one row; only neighbours move rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import whole

PIECE = r"([^.!?\n]{0,63}(?:\n|[.!?]+[ ]?\n?)|[^.!?\n]{1,64})"
BUCKET_ROWS = 1024
MAX_BUCKETS = 1 << 16
BLOCK = 256


def _let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    blank = hashlib.sha256(b"\n").hexdigest()
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    coded = F.array_join(
        F.transform(pieces, lambda p: F.concat(F.sha2(p, 256), F.when(F.endswith(p, F.lit("\n")), ";").otherwise(","))), ""
    )
    paragraphs = F.filter(F.split(coded, ";"), lambda q: q != "")

    def node(q: Column) -> Column:
        short = F.regexp_replace(q, "([0-9a-f]{8})[0-9a-f]{56},?", "$1,")
        ends = F.substring(F.sha2(q, 256), 1, 1).isin("0", "1") | (q == blank)
        return F.concat(F.sha2(q, 256), F.lit("["), F.rtrim(short, F.lit(",")), F.lit("]"), F.when(ends, "\n").otherwise(";"))

    sections = F.filter(F.split(F.array_join(F.transform(paragraphs, node), ""), "\n"), lambda s: s != "")
    digests = F.transform(
        sections,
        lambda s: F.struct(
            F.sha2(F.regexp_replace(s, r"\[[^\]]*\];?", ""), 256).alias("digest"),
            F.rtrim(F.regexp_replace(s, r"([0-9a-f]{8})[0-9a-f]{56}\[", "$1["), F.lit(";")).alias("tree"),
        ),
    )

    def text_of(nodes: Column) -> Column:
        below = F.transform(nodes, lambda n: F.concat(F.substring(n["digest"], 1, 8), F.lit("("), n["tree"], F.lit(")")))
        return F.concat(F.sha2(F.array_join(nodes["digest"], ""), 256), F.lit("|"), F.array_join(below, ""))

    return _let(digests, text_of)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def pieces(fp: Column) -> Column:
    """The distinct shortened digests of all pieces."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"([0-9a-f]{8})(?=[,\]])"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal texts and only for them."""

    def dice(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["a"], both["b"]))
        total = F.size(both["a"]) + F.size(both["b"])
        # Same distinct pieces in another order or number: alike, but not equal.
        return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1 - 1e-6), 2 * shared / total))

    different = _let(F.struct(pieces(a).alias("a"), pieces(b).alias("b")), dice)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(different)


def sections(fp: Column) -> Column:
    return F.regexp_extract_all(fp, F.lit(r"([0-9a-f]{8}\([^)]*\))"), F.lit(1))


def paragraphs(fp: Column) -> Column:
    """(section, paragraph, tree) from 0, in reading order."""
    nested = F.transform(
        sections(fp),
        lambda s, i: F.transform(
            F.split(F.regexp_extract(s, r"\((.*)\)", 1), ";"),
            lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("tree")),
        ),
    )
    return F.flatten(nested)


def _trees(own: Column) -> Column:
    """The paragraphs of some sections, as texts."""
    return F.flatten(F.transform(own, lambda s: F.split(F.regexp_extract(s, r"\((.*)\)", 1), ";")))


def branches(a: Column, b: Column) -> Column:
    """What `b` has and `a` lacks: (sections, paragraphs), lists of shortened digests in reading order, each
    once. Found from the root down: equal roots have none, and only differing sections are opened."""

    def below(both: Column) -> Column:
        fresh = F.array_except(both["b"], both["a"])
        unknown = F.array_except(_trees(fresh), _trees(F.array_except(both["a"], both["b"])))
        digests = lambda nodes: F.array_distinct(F.transform(nodes, lambda n: F.substring(n, 1, 8)))
        return F.struct(digests(fresh).alias("sections"), digests(unknown).alias("paragraphs"))

    nothing = F.array().cast("array<string>")
    none = F.struct(nothing.alias("sections"), nothing.alias("paragraphs"))
    found = _let(F.struct(sections(a).alias("a"), sections(b).alias("b")), below)
    return F.when(root(a) == root(b), none).otherwise(found)


def differing(a: Column, b: Column) -> Column:
    """Where in `b` those paragraphs are: (section, paragraph, tree), as `paragraphs` gives them."""

    def placed(found: Column) -> Column:
        opened = F.filter(
            paragraphs(b), lambda p: F.array_contains(found["paragraphs"], F.substring(p["tree"], 1, 8))
        )
        return F.when(F.size(found["paragraphs"]) > 0, opened).otherwise(F.filter(opened, lambda p: F.lit(False)))

    return _let(branches(a, b), placed)


def edited(text: Column, following: Column) -> Column:
    """`text` with its last third replaced by the first letters of `following`, as many or all."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def with_next(docs: DataFrame, make) -> DataFrame:
    """(doc_id, text, made, next_text, next_made), each row with that of the next smaller id.

    The last row is followed by the first; a lone row by itself. Rows of one id follow each other by the hash of
    their text, null ids come last. `make` is computed once per row, where the row has been sent.

    Rows are cut into buckets by the borders of a range partitioning of the ids alone, 65,536
    at most. The first row of a bucket also goes to the bucket before it, so each text moves
    once and no bucket needs another.
    """
    rows = docs.select("doc_id", whole().alias("text"))
    count = rows.count()
    buckets = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    ranges = docs.select("doc_id").repartitionByRange(buckets, F.desc_nulls_last("doc_id"))
    tops = ranges.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).select("top")
    largest = sorted((r["top"] for r in tops.collect() if r["top"] is not None), reverse=True)
    first, borders = (largest[0] if largest else None), largest[1:]
    blocks = [borders[i : i + BLOCK] for i in range(0, len(borders), BLOCK)]

    def block(number: Column) -> Column:
        nested = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
        return F.coalesce(F.get(nested, number.cast("int")), F.array().cast("array<bigint>"))

    # How many borders are at or above the id: whole blocks first, then within the next block.
    lowest = F.from_json(F.lit(json.dumps([b[-1] for b in blocks])), "array<bigint>")
    full = F.size(F.filter(lowest, lambda v: v >= F.col("doc_id")))
    rest = F.size(F.filter(block(F.col("__full")), lambda v: v >= F.col("doc_id")))
    last = len(borders)
    placed = rows.withColumn("__full", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(full)).withColumn(
        "__bucket", F.least(F.lit(last), F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.col("__full") * BLOCK + rest))
    )
    is_border = (F.col("__bucket") > 0) & F.array_contains(block((F.col("__bucket") - 1) / BLOCK), F.col("doc_id"))
    is_first = F.col("doc_id").eqNullSafe(F.lit(first).cast("bigint"))
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    before = F.when(is_border, F.struct((F.col("__bucket") - 1).alias("bucket"), F.lit(1).alias("guest")))
    wrapped = F.when(is_first, F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("guest")))
    homes = F.explode(F.filter(F.array(own, before, wrapped), lambda x: x.isNotNull())).alias("home")
    sent = placed.select("doc_id", "text", homes).select("doc_id", "text", "home.*").repartition("bucket")
    made = sent.withColumn("made", make(F.col("text"))).withColumn("__tie", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "__tie")
    return (
        made.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_made", F.lead("made").over(order))
        .where("guest = 0")
        .drop("bucket", "guest", "__tie")
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and how alike they and the next one's are."""
    paired = with_next(docs, fingerprint)
    changed = paired.select("doc_id", "text", "made", "next_made", edited(F.col("text"), F.col("next_text")).alias("edit"))
    printed = changed.select("*", fingerprint(F.col("edit")).alias("edited_made"))
    printed = printed.withColumn("branches", branches(F.col("made"), F.col("edited_made")))
    return printed.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        F.col("made").alias("fingerprint"),
        F.col("edited_made").alias("edited_fingerprint"),
        likeness(F.col("made"), F.col("edited_made")).alias("near_edited"),
        likeness(F.col("made"), F.col("next_made")).alias("near_next"),
        F.col("branches.sections").alias("edited_sections"),
        F.col("branches.paragraphs").alias("edited_paragraphs"),
    )
