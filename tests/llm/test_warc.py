"""Archive round trip: records, digests, revisits, and damage."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import warc as W

PAGES = [(1, "http://a/", "same"), (9, "http://b/", "same"), (4, None, "same"), (2, "http://c/\r\nX: y", "ünique"),
         (3, "http://d/", None), (5, "http://e/", ""), (6, "http://f/", "a\r\n\r\nb\r\n"), (7, "u", "long " * 50000),
         (8, "u", "rep"), (8, "u", "rep"), (None, "u", "rep"), (None, "n", "only null id")]


def frame(spark):
    return spark.createDataFrame([(h, p, u, "z") for p, u, h in PAGES],
                                 "html string, page_id long, url string, record string").repartition(4)


def brute(min_bytes=0):
    out = []
    for p, _, h in PAGES:
        body = (h or "").encode()
        same = [q for q, _, g in PAGES if (g or "").encode() == body]
        last = max((q for q in same if q is not None), default=None)
        response = len(body) < min_bytes or p == last
        out.append((str(p), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if response else "revisit", None if response else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_read_back(spark, least):
    got = W.read_back(W.write_archive(frame(spark), min_bytes=least))
    rows = sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got.collect()], key=str)
    assert rows == brute(least)


def test_payloads_are_stored_once_and_records_are_exact(spark):
    archive = W.write_archive(frame(spark))
    bodies = {(h or "").encode() for _, _, h in PAGES}
    stored = archive.payloads.collect()
    assert len(stored) == len(bodies) and {W.verified_payload(bytes(r.digest), r.member) for r in stored} == bodies
    records = {r.page_id: bytes(r.record) for r in W.read_records(archive).collect()}
    one = records[6]
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:6>\r\n")
    assert one.endswith(b"\r\n\r\na\r\n\r\nb\r\n\r\n\r\n")
    assert b"WARC-Refers-To: <urn:x-page:9>" in records[4] and b"WARC-Target-URI" not in records[4]
    assert b"same" not in records[4] and b"\r\nX: y" not in records[2]


def test_damaged_and_missing_payloads_raise(spark):
    headers, payloads = W.write_archive(frame(spark))
    other = W.gzip.compress(b"other")
    bad = W.Archive(headers, payloads.withColumn("member", F.lit(other)))
    with pytest.raises(Exception, match="does not match its digest"):
        W.read_back(bad).collect()
    with pytest.raises(Exception, match="no payload"):
        W.read_back(W.Archive(headers, payloads.limit(0))).collect()


def test_empty_table(spark):
    assert W.read_back(W.write_archive(frame(spark).limit(0))).count() == 0
