"""WARC archives as chunked record tables.

A record's bytes (header block, CRLF, payload, CRLF CRLF) are written as rows (record, chunk_no, bytes) of at most ``CHUNK`` payload bytes, sliced
from the column's buffer without copying the record. Every row carries the digest chained over the chunks so far, and the last one the payload's
SHA-1, both updated chunk by chunk. Concatenating an archive's rows in order gives a plain WARC/1.1 file. Records of one chunk are read back in
place; only chunks of oversized records are brought together, and they stream through one running digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import shelved

CHUNK = 64 << 10  #: payload bytes of a row
OUT_BYTES = 4 << 20  #: bytes of rows handed on at a time
CHUNKS = pa.schema([("archive", pa.int32()), ("record", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("head", pa.int32()), ("tail", pa.int32()), ("bytes", pa.binary()),
                    ("chain", pa.string())])
CHUNKS_SQL = "archive int, record string, chunk_no int, last boolean, head int, tail int, bytes binary, chain string"
END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}/{digest}'.encode()).digest())}>"


def header(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    """Header block of one record; control characters of a URL are percent-encoded."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
             f"Page-Id: {'' if page is None else page}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else size}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers, digest)}", f"Refers-To-Page-Id: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + END


def roles(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(page, digest, response): for each distinct id and payload the id whose record holds the payload, null if it is its own."""
    d = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    d = d.groupBy("page", F.sha1("p").alias("digest"), F.octet_length("p").alias("size")).count()
    top = d.groupBy("digest", "size").agg(F.max("page").alias("top"))
    big = F.col("size") >= least_bytes
    return d.join(top, ["digest", "size"]).select("page", "digest", F.when(big & ~F.col("page").eqNullSafe(F.col("top")), F.col("top")).alias("response"))


def _cells(column) -> Iterator[memoryview]:
    """Bytes of each string of an Arrow column, without copies."""
    kind = "large_string" if pa.types.is_large_string(column.type) else "string"
    width = 8 if kind == "large_string" else 4
    _, offsets, data = column.buffers()
    ends = memoryview(offsets).cast("q" if width == 8 else "i")[column.offset:column.offset + len(column) + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends[:-1], ends[1:]):
        yield raw[a:b]


def _written(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        rows, held = [], 0
        for b in batches:
            pages, urls, answers = (b.column(i).to_pylist() for i in (0, 1, 2))
            for page, url, answer, body in zip(pages, urls, answers, _cells(b.column(3))):
                count += 1
                name, whole = f"{part}-{count}", hashlib.sha1()
                for at in range(0, len(body), chunk):
                    whole.update(body[at:at + chunk])
                kind = "response" if answer is None else "revisit"
                head, size = header(kind, page, url, base32(whole.digest()), len(body), answer), 0 if answer is not None else len(body)
                chain = b""
                for no, at in enumerate(range(0, max(size, 1), chunk)):
                    piece, last = body[at:min(at + chunk, size)], at + chunk >= size
                    step = hashlib.sha1(chain)
                    step.update(piece)
                    chain = step.digest()
                    raw = b"".join([b"" if no else head, piece, END if last else b""])
                    rows.append((part, name, no, last, 0 if no else len(head), len(END) if last else 0, raw, chain.hex()))
                    held += len(raw)
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNKS.types)], schema=CHUNKS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNKS.types)], schema=CHUNKS)

    return run


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write one record per row to the shared folder and return the chunk table.

    Of equal payloads (``least_bytes`` or more) the largest id is a response, the others revisit it; repeated rows of that id are responses
    too. A null payload is empty, a null URL an empty target; a null id is smaller than all others. Other columns are not read.
    """
    r = roles(pages, key, payload, least_bytes)
    d = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p")).withColumn("digest", F.sha1("p"))
    r = r.select(F.col("page").alias("rp"), F.col("digest").alias("rd"), "response")
    d = d.join(r, F.col("page").eqNullSafe(F.col("rp")) & (F.col("digest") == F.col("rd"))).select("page", "url", "response", "p")
    return shelved(d.mapInArrow(_written(chunk), CHUNKS_SQL), "warc")


FIELDS = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)
READ = pa.schema([("page", pa.int64()), ("kind", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("refers", pa.int64())])
READ_SQL = "page long, kind string, bytes long, digest string, refers long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream chunk rows in order of record and number; one open record at a time."""
    head, size, whole, chain, want = {}, 0, None, b"", 0
    for b in batches:
        out = []
        for name, no, last, skip, tail, raw, seen in zip(*(b.column(c).to_pylist() for c in ("record", "chunk_no", "last", "head", "tail", "bytes", "chain"))):
            if no == 0:
                head, size, whole, chain, want = {k.decode().lower(): v.decode() for k, v in FIELDS.findall(raw[:skip])}, 0, hashlib.sha1(), b"", 0
            piece = memoryview(raw)[skip:len(raw) - tail]
            step = hashlib.sha1(chain)
            step.update(piece)
            chain = step.digest()
            if no != want or chain.hex() != seen:
                raise ValueError(f"record {name}: chunk {no} is missing or damaged")
            whole.update(piece)
            size, want = size + len(piece), want + 1
            if last:
                told, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if size != int(head["content-length"]) or kind == "response" and base32(whole.digest()) != told:
                    raise ValueError(f"record {name}: its payload differs from its header")
                number = lambda k: int(head[k]) if head.get(k) else None
                out.append((number("page-id"), kind, size, told if kind == "revisit" else base32(whole.digest()), number("refers-to-page-id")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), READ.types)], schema=READ)


def read(chunks: DataFrame) -> DataFrame:
    """(page, kind, bytes, digest, refers) of each record; for a revisit, bytes are those of the response it refers to."""
    one = (F.col("chunk_no") == 0) & F.col("last")
    many = chunks.filter(~one)
    many = many.repartition("record").sortWithinPartitions("record", "chunk_no")
    got = chunks.filter(one).mapInArrow(_read, READ_SQL).unionByName(many.mapInArrow(_read, READ_SQL))
    full = got.filter("kind = 'response'").groupBy(F.col("page").alias("rp"), F.col("digest").alias("rd")).agg(F.max("bytes").alias("full"))
    back = got.filter("kind = 'revisit'").join(full, (F.col("refers") == F.col("rp")) & (F.col("digest") == F.col("rd")), "left")
    return got.filter("kind = 'response'").unionByName(back.select("page", "kind", F.col("full").alias("bytes"), "digest", "refers"))


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM d"""
