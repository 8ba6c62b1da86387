"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds each distinct payload once, as a
gzip member under its SHA-256, and ``headers`` holds every record's exact
header bytes with the digest of its payload.  Reading joins them again: a
response record gets its payload back, a revisit record has none of its own
but must find the one it refers to.  Digests and lengths are verified against
the bytes that come out; a mismatch raises.

Payloads are compressed before they are shuffled and are combined per task
first, so a payload that a third of the records share moves once per task.

Which record is the response: of those with equal payloads of at least
``min_bytes`` bytes, the one with the largest page id (null is the least);
smaller payloads make every record a response.

Defined results: a null payload is empty; line ends in a URL are escaped, a
null URL is left out of the header; rows that repeat the response's page id
and payload are responses too; an empty table gives empty archives.  Other
input columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import map_rows, saved

DATE = "1970-01-01T00:00:00Z"  # the pages have no crawl time
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    headers: DataFrame   # page_id, record_type, digest, header
    payloads: DataFrame  # digest, sha1, n_bytes, member


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(html: str | None) -> tuple:
    payload = (html or "").encode()
    return (hashlib.sha256(payload).digest(), base32_sha1(payload), len(payload),
            gzip.compress(payload, 6, mtime=0))


def _record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def header_bytes(page_id: int | None, url: str | None, sha1: str, n_bytes: int,
                 response: bool, refers_to: int | None) -> bytes:
    """The record's WARC header, its HTTP header, and what ends them."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {n_bytes}\r\n\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}",
             f"WARC-Record-ID: {_record_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if not response:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (n_bytes if response else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 0) -> Archive:
    """Both tables, written to the shared checkpoint folder."""
    src = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"),
                       F.col(f"`{url}`").cast("string").alias("url"),
                       F.col(f"`{html}`").cast("string").alias("html"))
    packed = map_rows(src, ["html"], _pack, "digest binary, sha1 string, n_bytes long, member binary",
                      ["page_id"])
    payloads = saved(packed.groupBy("digest").agg(
        F.first("sha1").alias("sha1"), F.first("n_bytes").alias("n_bytes"),
        F.max("page_id").alias("last_page"), F.first("member").alias("member")), "warc-payloads")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = src.select("page_id", "url", F.unhex(F.sha2(body, 256)).alias("digest"))
    known = payloads.select("digest", "sha1", "n_bytes", "last_page")
    records = records.join(known, "digest").withColumn(
        "response", (F.col("n_bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("last_page")))

    def make(page, target, sha1, n_bytes, response, last):
        return ("response" if response else "revisit",
                header_bytes(page, target, sha1, n_bytes, response, last))

    headers = map_rows(records, ["page_id", "url", "sha1", "n_bytes", "response", "last_page"], make,
                       "record_type string, header binary", ["page_id", "digest"])
    return Archive(saved(headers, "warc-headers"), payloads.drop("last_page"))


def verified_payload(digest: bytes, member: bytes) -> bytes:
    """The payload of a gzip member; raises unless it has the digest."""
    payload = zlib.decompress(member, 31)
    if hashlib.sha256(payload).digest() != digest:
        raise ValueError(f"stored payload does not match its digest {digest.hex()}")
    return payload


def read_records(archive: Archive) -> DataFrame:
    """``page_id, record``: every original record's exact bytes.

    Responses are joined to their payload; revisits only to the proof that the
    payload they refer to is stored, so no payload is copied per revisit."""
    headers, payloads = archive
    responses = headers.filter("record_type = 'response'").join(
        payloads.select("digest", "member"), "digest", "left")

    def whole(digest, header, member):
        if member is None:
            raise ValueError(f"no payload {digest.hex()}")
        return (header + verified_payload(digest, member) + b"\r\n\r\n",)

    full = map_rows(responses, ["digest", "header", "member"], whole, "record binary", ["page_id"])
    stored = payloads.select("digest", F.lit(True).alias("stored"))
    revisits = headers.filter("record_type = 'revisit'").join(stored, "digest", "left").select(
        "page_id", F.when(F.col("stored"), F.concat("header", F.lit(b"\r\n\r\n")))
        .otherwise(F.raise_error(F.lit("no payload for a revisit record"))).alias("record"))
    return full.unionByName(revisits)


def parse_record(record: bytes) -> tuple[str, int, str, int | None]:
    """(type, payload bytes, payload digest, page referred to) of a record.

    A response's digest and length are those of its bytes, which must agree
    with its header; a revisit's are in its headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest, n_bytes = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(inner["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload), base32_sha1(payload)) != (n_bytes, digest):
        raise ValueError("a response record's payload does not match its header")
    to = fields.get("WARC-Refers-To", "").removeprefix("<urn:x-page:").removesuffix(">")
    return kind, n_bytes, digest, int(to) if to and to != "null" else None


def read_back(archive: Archive) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record."""

    def parsed(record):
        kind, n_bytes, digest, to = parse_record(record)
        return n_bytes, digest, kind, to

    return map_rows(read_records(archive), ["record"], parsed,
                    "payload_bytes long, payload_digest string, record_type string, refers_to long",
                    ["page_id"])
