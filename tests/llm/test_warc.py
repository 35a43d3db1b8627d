import base64
import hashlib
import random

import pytest

from stowage.llm import warc
from stowage.llm.queries import archived


def brute(rows):
    groups = {}
    for page, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        keep = max(ids, default=None)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(groups[html or ""]) > 1 and keep is not None and page != keep
        out.append((page, len(raw), digest, "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(spark):
    rng = random.Random(8)
    tricky = ["\r\n\r\nWARC/1.1\r\n", "<p>é漢😀</p>\r\n", "0\r\n\r\n", "Content-Length: 5\r\n", "\x00 \x0b"]
    rows = [(i, "".join(rng.choices(tricky, k=rng.choice([0, 1, 5, 900, 9000])))) for i in range(60)]
    rows += [(100 + i, "the same page") for i in range(40)] + [(200 + i, "x" * 100_000) for i in range(3)]
    rows += [(300, None), (301, ""), (None, "the same page"), (None, "only unknown"), (None, "only unknown")]
    rows += [(202, "x" * 100_000), (139, "the same page"), (400, "y" * 70_000), (400, "y" * 70_000)]
    urls = ["http://a/b c?d=é\r\nX: y", None, "http://h/"]
    df = spark.createDataFrame(
        [(p, urls[k % 3], h, "q") for k, (p, h) in enumerate(rows)], "page_id bigint, url string, html string, payload string"
    )
    got = sorted(map(tuple, archived(df).collect()), key=repr)
    assert got == brute(rows)


def records_of(spark, page, raw):
    rows = [r for content in warc.page_records(page, "http://u/", raw, None) for r in warc.parse(content)]
    return rows, lambda use: {r.record_id: r for r in warc.payloads(spark.createDataFrame(use, warc.RECORDS)).collect()}


@pytest.mark.parametrize("harm", ["none", "order", "gap", "short", "no end", "twice"])
def test_segments_are_ordered_and_verified(spark, harm):
    raw = bytes(range(256)) * 500
    rows, read = records_of(spark, 7, raw)
    assert len(rows) == 4 and rows[1][0] == "continuation" and rows[-1][6] > len(raw)
    own = rows[0][1]
    if harm == "order":
        rows.reverse()
    elif harm == "gap":
        del rows[2]
    elif harm == "short":
        rows[1] = (*rows[1][:7], rows[1][7][:-1])
    elif harm == "no end":
        del rows[-1]
    elif harm == "twice":
        rows += rows
    found = read(rows)[own]
    whole = harm in ("none", "order", "twice")
    assert found.sound == whole and (found.payload == raw if whole else found.payload is None)
    assert found.written == (2 if harm == "twice" else 1)


def test_parser_follows_content_length_and_ends_at_damage():
    raw = b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3
    record = next(warc.page_records(1, None, raw, None))
    rows = list(warc.parse((record + b"\r\n\r\n") * 2 + b"junk"))
    assert len(rows) == 2 and warc.body_of(rows[1][7]) == raw
    assert list(warc.parse(b"no archive")) == [] and list(warc.parse(b"")) == []
    assert warc.body_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nab") is None
    assert warc.body_of(None) is None


def test_empty_table(spark):
    assert archived(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
