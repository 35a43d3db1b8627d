"""Web archives: write pages as WARC records, read them back, put segments together again.

Writing. A page whose payload occurs more than once is stored in full once, under the largest
page id; the others become revisit records that point to it. A response block (HTTP header and
body) longer than `SEGMENT_BYTES` is cut: a first record numbered 1 and continuation records
that name it as their origin, the last one with the total length. Bodies longer than
`CHUNK_BYTES` use chunked transfer framing. Records are the lines of Spark's text sink, whose
line separator is the two line ends that close a WARC record, so the sink's commit protocol,
retries and any file system apply. A file holds at most `FILE_RECORDS` records.

Reading. Files are parsed record by record, by content length. Records that are whole are decoded
at once; only segments are shuffled: grouped by origin identifier, ordered by number, checked
for gaps and for the total length, joined, and the chunked framing is taken off. A record that is
damaged, incomplete or does not match its digest comes back with `sound` false and no payload.

Null payloads count as empty, null ids and addresses as unknown (`none`). Rows that repeat id and
payload write the same record again; it is put together once and returned as often as it was
written. A file that is no archive gives no records. Empty tables write no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import small_batches, whole
from stowage.session import settle, working_folder

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4_096
FILE_RECORDS = 4_096
LEAST_BYTES = 0

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

RECORDS = (
    "kind string, record_id string, refers_to string, digest string, origin string, segment int, total bigint, block binary"
)
PAYLOADS = "kind string, record_id string, refers_to string, digest string, written bigint, sound boolean, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest}>"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    fields |= {"Content-Length": len(block)}
    head = [VERSION, *(f"{name}: {value}".encode() for name, value in fields.items() if value is not None)]
    return END.join(head) + END + END + block


def _http(payload: bytes, with_body: bool = True) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if len(payload) <= CHUNK_BYTES or not with_body:
        return head + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if with_body else b"")
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    body = b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in parts)
    return head + b"Transfer-Encoding: chunked\r\n\r\n" + body + b"0\r\n\r\n"


def page_records(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """The records of one page, without the two line ends that close each."""
    digest = payload_digest(payload)
    own = record_id(page, digest)
    common = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": own,
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="/:?&=#%~+,;@") if url else "urn:none",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        more = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
        yield _record(common | more, _http(payload, with_body=False))
        return
    block = _http(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record(common, block)
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    for number, begin in enumerate(cuts, 1):
        part = block[begin : begin + SEGMENT_BYTES]
        if number == 1:
            yield _record(common | {"WARC-Segment-Number": 1}, part)
            continue
        fields = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"{own[:-1]}:{number}>",
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": own,
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(cuts) else None,
        }
        yield _record(fields, part)


def mark_revisits(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is set where an equal payload of a larger id is stored."""
    rows = pages.select("page_id", "url", whole(payload).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.where(F.length("payload") >= LEAST_BYTES).groupBy("sha")
    several = groups.agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stored, _ = settle(several.select("sha", "largest"))
    other = ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(stored, "sha", "left").select(
        "page_id", "url", "payload", F.when(other, F.col("largest")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, payload: str = "html") -> None:
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("page_id", "url", "payload", "refers_to"))):
                yield pa.record_batch([pa.array(page_records(*row), pa.binary())], ["record"])

    records = mark_revisits(pages, payload).mapInArrow(run, "record binary")
    # A cast from binary keeps the bytes as they are, so a cut may fall within a letter.
    sink = records.select(F.col("record").cast("string")).write.option("lineSep", (END + END).decode())
    sink.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def parse(content: bytes) -> Iterator[tuple]:
    """The records of an archive in the order of RECORDS; stops where the bytes are no record."""
    view, at, size = memoryview(content), 0, len(content)
    while at < size:
        head_end = content.find(END + END, at)
        lines = content[at:head_end].split(END) if head_end > 0 else []
        if not lines or not lines[0].startswith(b"WARC/"):
            return
        pairs = (line.decode("utf-8", "replace").partition(":")[::2] for line in lines[1:])
        fields = {name.strip().lower(): value.strip() for name, value in pairs}
        number = lambda name: int(fields[name]) if fields.get(name, "").isdigit() else None  # noqa: E731, B023
        length = number("content-length")
        if length is None:
            return
        begin = head_end + 4
        block = bytes(view[begin : begin + length])
        at = begin + length + 4
        yield (
            fields.get("warc-type"),
            fields.get("warc-record-id"),
            fields.get("warc-refers-to"),
            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            fields.get("warc-segment-origin-id"),
            number("warc-segment-number"),
            number("warc-segment-total-length"),
            block if len(block) == length else None,
        )


def body_of(block: bytes | None) -> bytes | None:
    """The body of an HTTP message without its transfer framing; None if it is damaged."""
    head, found, body = (block or b"").partition(END + END)
    if not found:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(END)[1:])}
    if fields.get(b"transfer-encoding", b"").lower() != b"chunked":
        return body if int(fields.get(b"content-length", len(body))) == len(body) else None
    parts, at = [], 0
    while True:
        line_end = body.find(END, at)
        try:
            size = int(body[at:line_end].split(b";")[0], 16) if line_end > 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        at = line_end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != END:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    text, binary = pa.string(), pa.binary()
    types = [text, text, text, text, text, pa.int32(), pa.int64(), binary]
    names = [field.split()[0] for field in RECORDS.split(", ")]
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORDS)


def join_segments(records: DataFrame) -> DataFrame:
    """One row per segmented record: its block if no segment and no byte is missing."""
    own = F.coalesce("origin", "record_id").alias("own")
    parts = records.where(F.col("segment").isNotNull()).select(own, "*")
    # Repeats of a segment are combined before the shuffle, so no group outgrows its record.
    parts = parts.groupBy("own", "segment").agg(
        *(F.max(name).alias(name) for name in ("kind", "refers_to", "digest", "total", "block")),
        F.count(F.lit(1)).alias("written"),
    )
    first = F.col("segment") == 1
    joined = parts.groupBy("own").agg(
        *(F.max(F.when(first, F.col(name))).alias(name) for name in ("kind", "refers_to", "digest", "written")),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
        F.count(F.lit(1)).alias("found"),
        F.sum(F.length("block")).alias("bytes"),
        F.sort_array(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("text")))).alias("texts"),
    )
    whole_again = (F.col("found") == F.col("last")) & (F.col("bytes") == F.col("total"))
    block = F.when(whole_again, F.array_join("texts.text", "").cast("binary"))
    return joined.where("written > 0").select(
        "kind", F.col("own").alias("record_id"), "refers_to", "digest", "written", block.alias("block")
    )


def payloads(records: DataFrame) -> DataFrame:
    """Responses and revisits with decoded payloads; a revisit has none of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            kinds, digests = columns[0].to_pylist(), columns[3].to_pylist()
            bodies, sound = [], []
            for kind, digest, block in zip(kinds, digests, batch.column(5).to_pylist()):
                body = body_of(block) if kind == "response" else None
                fits = body is not None and digest in (None, payload_digest(body))
                bodies.append(body if fits else None)
                sound.append(fits or kind == "revisit")
            extra = [pa.array(sound, pa.bool_()), pa.array(bodies, pa.binary())]
            names = [*batch.schema.names[:5], "sound", "payload"]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names)

    single = records.where(F.col("segment").isNull() & F.col("kind").isin("response", "revisit")).select(
        "kind", "record_id", "refers_to", "digest", F.lit(1).cast("bigint").alias("written"), "block"
    )
    return single.unionAll(join_segments(records)).mapInArrow(run, PAYLOADS)


def round_trip(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write `pages` as archives into the session's shared folder and read their payloads back."""
    spark = pages.sparkSession
    folder = f"{working_folder(spark)}/archives-{uuid.uuid4().hex}"
    write(pages, folder, payload)
    return payloads(read_records(spark, folder))
