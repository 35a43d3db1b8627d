"""The registered queries over the text operators, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import alignment, bpe, conversations, exact_dedup, fingerprints, fuzzy_lines, mixing, permutation_index, pseudonyms, quality, simhash, toxicity, warc
from stowage.llm.common import read, whole
from stowage.session import settle


def encoded(documents: DataFrame, ranks_path: str, *carried: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to; `carried` columns are passed on."""
    ranks = bpe.read_ranks(ranks_path)
    ids = bpe.encode(documents.select("doc_id", "text", *carried), ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *carried,
    )


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def arrives_later() -> Column:
    """Which half of a table is held as the incoming batch against the other half."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


def exact_copies(documents: DataFrame) -> DataFrame:
    return exact_dedup.deduplicate(documents, arrives_later()).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(read(spark, folder, "documents"))


def near_copies(documents: DataFrame) -> DataFrame:
    fingerprinted, _ = settle(simhash.with_fingerprints(documents.select("doc_id", "text")))
    return simhash.near_duplicates(fingerprinted).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(read(spark, folder, "documents"))


def mixed(documents: DataFrame) -> DataFrame:
    first = F.when(F.col("__copies") > 0, F.round(mixing.position(F.lit(0)), 6))
    return mixing.plan(documents.select("doc_id", "text", "source")).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
        first.alias("first_position"),
    )


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(read(spark, folder, "documents"))


def archived(pages: DataFrame) -> DataFrame:
    """What the archives of all pages hold; a revisit's length is that of the record it points to."""
    read_back, _ = settle(
        warc.round_trip(pages.select("page_id", "url", "html")).select(
            "kind", "record_id", "refers_to", "digest", "written", "sound", F.length("payload").alias("bytes")
        )
    )
    page = lambda name: F.regexp_extract(name, "^<urn:page:([0-9-]+):", 1).try_cast("bigint")
    stored = read_back.where("kind = 'response'").select(
        F.col("record_id").alias("target"), F.col("bytes").alias("stored_bytes")
    )
    revisits = read_back.where("kind = 'revisit'").join(
        stored.distinct(), F.col("refers_to") == F.col("target"), "left"
    )
    both = read_back.where("kind = 'response'").unionByName(
        revisits.select(*(c for c in read_back.columns if c != "bytes"), F.col("stored_bytes").alias("bytes"))
    )
    return (
        both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("written"))))
        .select(
            page("record_id").alias("page_id"),
            F.col("bytes").cast("bigint").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            page("refers_to").alias("refers_to"),
        )
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(read(spark, folder, "pages"))


def document_trees(documents: DataFrame) -> DataFrame:
    return fingerprints.compare_with_edits(documents.select("doc_id", "text"))


def op1_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return document_trees(read(spark, folder, "documents"))


PSEUDONYM_KEY = "key for tests and examples"


def pseudonymised(documents: DataFrame) -> DataFrame:
    changed = F.filter("found", lambda x: x["changed"])
    return pseudonyms.pseudonymise(documents.select("doc_id", "text"), PSEUDONYM_KEY).select(
        "doc_id",
        "text",
        F.size(changed).alias("replaced"),
        F.array_sort(F.array_distinct(changed["kind"])).alias("kinds"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised(read(spark, folder, "documents"))


def ratings(labels: DataFrame) -> DataFrame:
    """The labels' own grades of quality, as many as there are, from 0 (poor) up."""
    return labels.select("doc_id", F.when(F.col("quality") >= 0, F.col("quality").cast("int")).alias("grade"))


def graded(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected grade of every text, whether it is likelier good than poor (the tail of grade 1), and the
    chance of the best grade (the last tail; with two grades the same)."""
    model = quality.fit(*quality.rated_sample(documents, ratings(labels)))
    tails = quality.grade(documents.select("doc_id", "text"), model).drop("text")
    tail = F.get("tails", F.lit(0))
    return tails.select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        F.aggregate("tails", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"),
        tail.alias("score"),
        F.element_at("tails", -1).alias("top_tail"),
        (tail >= 0.5).cast("int").alias("predicted"),
        (tail >= 0.5).alias("kept"),
    )


def op5_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    return graded(read(spark, folder, "documents"), read(spark, folder, "labels"))


def toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    net = toxicity.learn(documents, labels)
    return toxicity.score(documents.select("doc_id", "text"), net).select(
        "doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic(read(spark, folder, "documents"), read(spark, folder, "labels"))


def deduplicated_lines(documents: DataFrame) -> DataFrame:
    """Which lines of every document stay, numbered from 0."""
    lines = F.size(F.split(whole(), "\n"))
    counted = documents.select("doc_id", "text", lines.alias("n_lines"))
    return fuzzy_lines.with_removals(counted).select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        (F.col("n_lines") - F.size("__removed")).cast("bigint").alias("kept_lines"),
        F.col("__removed").alias("removed_lines"),
    )


def op6_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated_lines(read(spark, folder, "documents"))


def repaired(rows: DataFrame) -> DataFrame:
    """Every conversation's repair after the damage; none is left out that lost all its rows."""
    found = conversations.digests(conversations.edits(conversations.damaged(rows)))
    everyone = rows.select(F.col("conv_id").alias("_conv_id")).distinct()
    number = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return everyone.join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        F.col("_conv_id").alias("conv_id"),
        *(number(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(read(spark, folder, "conversations"))


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def linked(documents: DataFrame, files: alignment.Tokenizers) -> DataFrame:
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = alignment.align(documents.select("doc_id", "text"), files).documents
    return found.select("doc_id", *(F.col(f"__{name}").alias(name) for name in names))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return linked(read(spark, folder, "documents"), files)


QUERIES = {
    "op1_merkle_fingerprints": op1_merkle_fingerprints,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_mix_sources": op7_mix_sources,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_nearest": op12_nearest,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op7_mix_sources": """
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
            FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
        weighed AS (
            SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
                   sum(total) OVER () AS everything
            FROM totals),
        filled AS (  -- by how full a source is at equal words per weight
            SELECT *, everything - coalesce(sum(3 * total) OVER earlier, 0) AS rest,
                   sum(weight) OVER (ORDER BY 3.0 * total / weight DESC, source NULLS FIRST) AS weights
            FROM weighed WINDOW earlier AS (ORDER BY 3.0 * total / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (
            SELECT max(CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE)) AS per_weight
            FROM filled WHERE CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) * weight <= 3 * total),
        goals AS (
            SELECT source, total, weight, least(coalesce(per_weight, 0) * weight, CAST(3 * total AS DOUBLE)) AS target
            FROM weighed, level),
        placed AS (
            SELECT doc_id, size, total, weight, target,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
        counted AS (
            SELECT *, CASE WHEN total = 0 THEN 1 ELSE greatest(0, least(3, CAST(floor(
                       (2 * target - 2 * CAST(before AS DOUBLE) - size) / (2 * total)) AS BIGINT) + 1)) END AS copies,
                   CASE WHEN target > 0 THEN (CAST(before AS DOUBLE) + size / 2.0) / target ELSE 0 END AS share
            FROM placed)
        SELECT doc_id, size, total AS source_size, target, size * copies AS taken, copies,
               CASE WHEN copies > 0 THEN round(CASE weight
                   WHEN 1 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
                   WHEN 2 THEN share
                   ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END, 6) END AS first_position
        FROM counted""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversations": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                       || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
            FROM conversations),
        fated AS (  -- the checksum, bit by bit
            SELECT *, xor(list_reduce(codes, lambda crc, code: list_reduce(list_prepend(xor(crc, code),
                       CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295),
                       4294967295) % 20 AS fate
            FROM keyed),
        hurt AS (
            SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM fated WHERE fate <> 0),
        ordered AS (
            SELECT *, row_number() OVER same AS n, row_number() OVER (PARTITION BY conv_id, role, text
                       ORDER BY turn NULLS FIRST) AS seen,
                   lag(role[1]) OVER same AS before
            FROM hurt WINDOW same AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        judged AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' END AS fault,
                   before || role[1] NOT IN ('su', 'ua', 'au') AS odd
            FROM ordered),
        priced AS (
            SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stays,
                   coalesce(fault IN ('blank', 'duplicate'), false) AS must_go
            FROM judged),
        walk AS (  -- cheapest and ASCII-least edits to each state: (cost, initials, what stays)
            SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': 0, 'a': '', 't': ''} AS z, {'c': 1000000, 'a': '', 't': ''} AS s,
                   {'c': 1000000, 'a': '', 't': ''} AS u, {'c': 1000000, 'a': '', 't': ''} AS a
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, n,
                   {'c': z.c + 4, 'a': z.a || 'D', 't': z.t},
                   list_sort([{'c': s.c + 4, 'a': s.a || 'D', 't': s.t}]
                       || CASE WHEN NOT must_go AND role[1] = 's' THEN
                          [{'c': z.c + stays, 'a': z.a || 'K', 't': z.t || chr(10) || line}] ELSE [] END)[1],
                   list_sort([{'c': iu.c + 4, 'a': iu.a || 'D', 't': iu.t}]
                       || CASE WHEN must_go THEN [] ELSE list_transform([z, s, ia], lambda x:
                          {'c': x.c + 3 + stays, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || text}) END
                       || CASE WHEN NOT must_go AND role[1] = 'u' THEN list_transform([z, s, ia], lambda x:
                          {'c': x.c + stays, 'a': x.a || 'K', 't': x.t || chr(10) || line}) ELSE [] END)[1],
                   list_sort([{'c': ia.c + 4, 'a': ia.a || 'D', 't': ia.t}]
                       || CASE WHEN must_go THEN [] ELSE
                          [{'c': iu.c + 3 + stays, 'a': iu.a || 'R', 't': iu.t || chr(10) || 'assistant:' || text}] END
                       || CASE WHEN NOT must_go AND role[1] = 'a' THEN
                          [{'c': iu.c + stays, 'a': iu.a || 'K', 't': iu.t || chr(10) || line}] ELSE [] END)[1]
            FROM (
                SELECT *, list_sort([a, {'c': iu.c + 3, 'a': iu.a || 'I', 't': iu.t || chr(10) || 'assistant:'}])[1] AS ia
                FROM (
                    SELECT w.conv_id, p.n, p.role, p.text, p.role || ':' || p.text AS line, p.must_go, p.stays, z, s, u, a,
                           list_sort([u] || list_transform([z, s, a], lambda x:
                               {'c': x.c + 3, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'}))[1] AS iu
                    FROM walk w JOIN priced p ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = w.n + 1))),
        ends AS (
            SELECT conv_id, n, list_sort([z, a, {'c': iu.c + 3, 'a': iu.a || 'I', 't': iu.t || chr(10) || 'assistant:'}])[1] AS best
            FROM (
                SELECT *, list_sort([u] || list_transform([z, s], lambda x:
                    {'c': x.c + 3, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'}))[1] AS iu
                FROM (SELECT *, n = max(n) OVER (PARTITION BY conv_id) AS last FROM walk) WHERE last)),
        counted AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (odd) AS illegal
            FROM judged GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost,
               best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
        FROM ends e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op9_warc": """
        WITH hashed AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM hashed)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(sha, 1 + CAST(i // 4 AS BIGINT) * 5, 5) AS INT)
                         >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM grouped""",
}
