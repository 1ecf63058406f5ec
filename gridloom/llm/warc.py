"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task writes archives of its own, one gzip member a record, and returns for each record
file, offset, length, URL and digest. The index is a Parquet table; nothing reads an archive except
by it. Archive names carry a random part, so a task that runs again never changes an archive that
the index names.

Reading: the selected index rows are sorted by file and offset; neighbours no further apart than
`gap` bytes are fetched together in ranges of at most `most` bytes, and each record is inflated,
parsed and checked against its digest.

Equal payloads of at least `least` bytes are stored once, by the record with the largest page_id; the
others become revisit records. Rows that share that largest page_id are all responses.

Defined cases: a null html is an empty payload; a null URL gives no WARC-Target-URI; line breaks in
a URL are percent-encoded; a null page_id counts as smaller than any; an empty table writes no
archive. Other columns are ignored. Paths may be of any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored

#: Rows of the revisit table up to which it is broadcast (about 100 bytes each).
SMALL = 100_000
#: Bytes after which a task begins another archive.
ARCHIVE = 1 << 30
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response, or a revisit without its payload."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    fields.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = (html or "").encode()
                sha = digest(payload)
                z = zlib.compressobj(level, wbits=31)
                member = z.compress(record(page_id, url, payload, sha, refers_to)) + z.flush()
                if out is None or at >= ARCHIVE:
                    if out:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                rows.append((name, at, len(member), page_id, url, sha, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=[f.split()[0] for f in INDEX.split(", ")])
        if out:
            out.close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 4) -> DataFrame:
    """Writes archives below folder and returns their index, itself stored as a table."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    same = p.where(long).select(sha.alias("sha"), "page_id").groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = stored(same.where("n > 1 and first is not null").select("sha", "first"), "payloads")
    if same.count() <= SMALL:
        same = F.broadcast(same)
    both = p.withColumn("sha", F.when(long, sha)).join(same, "sha", "left")
    rows = both.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))
    return stored(rows.mapInArrow(_writer(folder, level), INDEX), "warc-index")


def _reader(folder: str, gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        opened, name, start, data = None, None, 0, b""
        for batch in batches:
            files, offsets, lengths, ids, urls, shas, kinds, refers = (batch.column(i).to_pylist() for i in range(8))
            out = []
            for i in range(batch.num_rows):
                if files[i] != name or not start <= offsets[i] <= offsets[i] + lengths[i] <= start + len(data):
                    if files[i] != name:
                        if opened:
                            opened.close()
                        name, opened = files[i], fs.open_input_file(f"{base}/{files[i]}")
                    start = end = offsets[i]
                    j = i  # the run of neighbours in this batch; the first record is read whatever its size
                    while j < batch.num_rows and files[j] == name and 0 <= offsets[j] - end <= gap and (j == i or offsets[j] + lengths[j] - start <= most):
                        end = offsets[j] + lengths[j]
                        j += 1
                    opened.seek(start)
                    data = opened.read(end - start)
                at = offsets[i] - start
                fields, http, payload = parse(zlib.decompress(data[at : at + lengths[i]], wbits=31))
                kind = fields["WARC-Type"]
                size = int(http["Content-Length"])
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest(payload) != sha) or sha != shas[i] or kind != kinds[i]:
                    raise ValueError(f"{name} at {offsets[i]}: not the record that the index names")
                target = fields.get("WARC-Refers-To")
                out.append((ids[i], size, sha, kind, int(target[10:-1]) if target else None, fields.get("WARC-Target-URI"), payload.decode() if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])
        if opened:
            opened.close()

    return run


def read(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that the index rows name: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url and html (null for a revisit)."""
    rows = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, gap, most), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives all pages and reads them all back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder).drop("html", "url")
