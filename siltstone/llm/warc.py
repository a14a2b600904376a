"""WARC archives with an index first.

Each task writes its pages as records, one gzip member each, into archives of a bounded size in the shared store, and
returns the index: archive, offset, length, URL, digest. Reading starts from the index: the entries of an archive are
sorted by offset and neighbours are joined to one byte range, and only those ranges are read. An archive is under a
name of its own for each attempt of a task, so a repeated task never writes into another's file; what the index does
not name is nobody's and goes with the folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import need
from siltstone.session import remove, settle, shared_dir, small, table

#: Compressed bytes after which a task begins another archive.
ARCHIVE = 64 << 20
#: Bytes between two records that are read along rather than left out, and the most that one read takes, or one record.
GAP, SPAN = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, archive string, offset long, length long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record without the payload if it refers to another page."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join(url.split()) if url is not None else None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Profile": None if refers_to is None else REVISIT,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]}")
    headers = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, body.partition(b"\r\n\r\n")[2]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str, most: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page, url, html, refers in zip(*(b.column(c) for c in ("_page", "_url", "_html", "_refers")), strict=True):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    page, payload = page.as_py(), (html.as_py() or "").encode("utf-8", "replace")
                    data = gzip.compress(record(page, url.as_py(), payload, refers.as_py()), 6, mtime=0)
                    out.write(data)
                    rows.append((page, url.as_py(), name, at, len(data), "response" if refers.as_py() is None else "revisit", refers.as_py(), digest(payload), len(payload)))
                    at += len(data)
                    if at >= most:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX_NAMES, r, strict=True)) for r in rows], schema=INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return run


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in INDEX.split(", "))])


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", *, revisit_from: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of pages below folder and returns the index.

    Of rows with equal payloads of revisit_from bytes or more, that with the largest id is the response and the others
    refer to it; rows that repeat both id and payload are responses each. Null ids come below all others; among null ids
    alone all are responses. A null html is an empty payload, a null url leaves the header out. An empty table writes
    nothing and has an empty index. Payloads are compared by SHA-256 and length. Other columns are not read.
    """
    need(pages, page_id, url, html)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("_page"), F.col(url).alias("_url"), F.col(html).alias("_html"), F.unhex(F.sha2(body, 256)).alias("_sha"), F.octet_length(body).alias("_n"))
    often = rows.groupBy("_sha", "_n").agg(F.max("_page").alias("_best"), F.count("*").alias("_rows")).where((F.col("_rows") > 1) & (F.col("_n") >= revisit_from))
    best = settle(often.select(F.col("_sha").alias("_s"), F.col("_n").alias("_m"), "_best"))  # digests of repeated payloads alone
    linked = rows.join(small(best), (F.col("_sha") == F.col("_s")) & (F.col("_n") == F.col("_m")), "left")  # beyond the bound a shuffle of plain tables, of which adaptive execution splits a hot payload
    refers = F.when(~F.col("_best").eqNullSafe(F.col("_page")), F.col("_best"))
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    return settle(linked.select("_page", "_url", "_html", refers.alias("_refers")).mapInArrow(_write(folder, archive_bytes, INDEX), INDEX))


def ranges(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Byte ranges that hold the records of the index: neighbours in an archive are joined, up to `span` bytes."""
    by = Window.partitionBy("archive").orderBy("offset")  # an archive is of a bounded size
    before = F.lag(F.col("offset") + F.col("length")).over(by)
    cut = index.withColumn("_new", F.when(before.isNull() | (F.col("offset") - before > gap), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(by))
    part = F.floor((F.col("offset") - F.min("offset").over(Window.partitionBy("archive", "_run"))) / F.lit(span))
    return cut.withColumn("_part", part).groupBy("archive", "_run", "_part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("_run", "_part")


def read_warc(index: DataFrame, folder: str, *, gap: int = GAP, span: int = SPAN, payloads: bool = True) -> DataFrame:
    """Reads the indexed records back and checks each response's digest: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = opened(folder)
        for b in batches:
            for r in b.itertuples(index=False):
                with fs.open_input_file(f"{path}/{r.archive}") as f:
                    data = f.read_at(int(r.end - r.start), int(r.start))
                rows = []
                for x in r.records:
                    at = int(x["offset"] - r.start)
                    headers, payload = parse(gzip.decompress(data[at : at + int(x["length"])]))
                    kind, told = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != told:
                        raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
                    ids = [None if s in (None, "none") else int(s) for s in (headers.get(h, "<urn:page:none>")[10:-1] for h in ("WARC-Record-ID", "WARC-Refers-To"))]
                    size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    rows.append((ids[0], headers.get("WARC-Target-URI"), kind, ids[1], told, size, payload.decode("utf-8") if payloads and kind == "response" else None))
                yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = max(2 * index.sparkSession.sparkContext.defaultParallelism, (index.agg(F.sum("length")).first()[0] or 0) // span)
    return ranges(index, gap, span).repartition(spread).mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    back = settle(read_warc(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return back


#: Base32 of a hex digest: each letter is five of its bits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + (5 * i) // 4, 2))::INT) >> (3 - (5 * i) % 4)) & 31), 1)), '') AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
"""
