"""WARC derivative builder: metadata and plain-text conversion records of response records.

``response_records`` puts fetched pages into the shape of WARC responses; ``derive`` turns
every response into a linked pair: a ``metadata`` record (application/warc-fields: title,
language, links, sizes and the source record's own headers) and a ``conversion`` record
(the page as plain text). Both name the response in WARC-Refers-To, with its target URI
and date, and carry SHA-1 block digests; the response's payload digest and its own WARC and
HTTP headers are kept in both (``source-`` and ``http-`` before their names). Pages are read by
``html_reader``, in time linear in their length.
Record ids are UUIDs derived from the source record's id and the record type, so a retry
gives the same ids. ``as_bytes`` writes a record in WARC/1.1 form and ``parse`` reads it
back.

Defined cases: a null url gives records without WARC-Target-URI; a null or empty page gives
an empty plain text; repeated rows give repeated records with equal ids; other columns are
ignored. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.html_reader import read_page

DATE = "2024-01-01T00:00:00Z"   # the tables carry no fetch time
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # the public name space of URLs


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode("ascii")


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join('' if p is None else p for p in parts))}>"


def header_lines(fields: list[tuple[str, str | None]]) -> str:
    """Header lines; line breaks in a value become spaces, null values are left out."""
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)


def as_bytes(headers: str, block: bytes) -> bytes:
    """A record in WARC/1.1 form."""
    return b"WARC/1.1\r\n" + headers.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record written by ``as_bytes``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


RECORD = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, "
          "payload_digest string, block_digest string, content_length long, headers string, block string")
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _record(page_id, kind, rid, refers, uri, payload_digest, content_type, block: str, more):
    raw = block.encode("utf-8")
    block_digest = digest(raw)
    headers = header_lines([
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", uri), ("WARC-Date", DATE),
        *more, ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", block_digest),
        ("Content-Type", content_type), ("Content-Length", str(len(raw)))])
    return page_id, kind, rid, refers, uri, payload_digest, block_digest, len(raw), headers, block


def _rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    types = [pa.int64() if n in ("page_id", "content_length") else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def response_records(pages: DataFrame) -> DataFrame:
    """Each page (page_id, url, html) as a WARC response record."""
    def one(page_id, url, page):
        page = page or ""
        rid = record_id("response", str(page_id), url, page)
        http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"Content-Length: {len(page.encode('utf-8'))}\r\n\r\n")
        return _record(page_id, "response", rid, None, url, digest(page.encode("utf-8")),
                       "application/http; msgtype=response", http + page, [])

    def run(batches):
        for b in batches:
            yield _rows([one(*r) for r in zip(*(c.to_pylist() for c in b.columns))])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, RECORD)


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response record: its ``metadata`` and its ``conversion``, linked to it."""
    def pair(page_id, rid, uri, payload_digest, headers, block):
        head, _, page = (block or "").partition("\r\n\r\n")
        read = read_page(page)
        conversion = record_id("conversion", rid)
        source = [("source-" + k, v) for k, _, v in (x.partition(": ") for x in (headers or "").split("\r\n")) if k]
        http = [("http-" + k.lower(), v) for k, _, v in (x.partition(": ") for x in head.split("\r\n")[1:]) if k]
        about = header_lines([
            ("title", read.title), ("language", read.language), ("outlinks", str(len(read.links))), ("text-length", str(len(read.text))),
            ("conversion", conversion), *source, *http, *(("outlink", x) for x in read.links)])
        refers = [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", DATE)]
        return (_record(page_id, "metadata", record_id("metadata", rid), rid, uri, payload_digest,
                        "application/warc-fields", about, refers),
                _record(page_id, "conversion", conversion, rid, uri, payload_digest,
                        "text/plain; charset=utf-8", read.text, [*refers, *source, *http]))

    def run(batches):
        for b in batches:
            yield _rows([x for r in zip(*(c.to_pylist() for c in b.columns)) for x in pair(*r)])

    return responses.where("record_type = 'response'").select(
        "page_id", "record_id", "target_uri", "payload_digest", "headers", "block").mapInArrow(run, RECORD)
