"""WARC archives: write them with an index, then read selected records by coalesced byte ranges.

Every record is a gzip member of its own. Writing gives the index first: archive, offset, length,
url and digest of each record. A reader takes any selection of index rows, sorts them by place, joins
neighbouring ranges into one read, and parses the records out of it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import arrow_rows, materialize
from emberkey.session import fresh_path

LEAST_PAYLOAD = 1000  # shorter payloads are always written in full
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20  # most bytes of one read
GAP_BYTES = 64 << 10  # unselected bytes worth reading over
TASK_BYTES = 32 << 20
MOST_TASKS = 20_000  # beyond it a task reads several stretches
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the payload's digest and length, but no payload."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:  # what would break a header line is escaped; the index has the url as it is
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _gzip(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of (page_id, url, html); returns the index, a table of its own.

    Of rows with equal payloads of at least 1000 bytes, that with the largest page_id is a response and
    the others are revisits of it; rows that repeat this page_id are responses as well. Null html is an
    empty payload, a null page_id the least of all. An empty table gives an empty index.

    Payload digests are grouped with map-side combine, and only those that occur twice meet the pages.
    Each task writes archives under names of its own; the index names only those of tasks that
    succeeded, so a lost executor leaves at most files that nobody refers to.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("size"),
    )
    long = rows.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("times"))
    long = materialize(long.where("times > 1 and kept is not null").select("digest", "kept"), "payloads")
    marked = rows.join(long, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        held: list[tuple] = []
        try:
            for page_id, url, html, digest, refers_to in arrow_rows(batches):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = _gzip(record(page_id, url, html.encode(), digest, refers_to, refers_to is not None))
                out.write(data)
                held.append((f"{folder}/{name}", at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
                if len(held) == 4096:
                    yield _table(held)
                    held = []
        finally:
            if out is not None:
                out.close()
        if held:
            yield _table(held)

    return materialize(marked.mapInArrow(write, INDEX), "index")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def coalesced(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(archive, start, ranges) for one read each; `rows` are (archive, offset, length) sorted by place."""
    archive, start, end, ranges = None, 0, 0, []
    for name, offset, length in rows:
        if ranges and (name != archive or offset - end > GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield archive, start, ranges
            ranges = []
        if not ranges:
            archive, start = name, offset
        ranges.append((offset, length))
        end = offset + length
    if ranges:
        yield archive, start, ranges


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that index rows name, with payload (null for revisits) on request.

    A response's digest is computed anew and must be the one in its header. Work is spread by
    archive and stretch of `TASK_BYTES`, in as many tasks as there are stretches: index rows are small, and left to
    itself Spark would join them into one task. A task holds one read of at most `RANGE_BYTES`, or one longer record.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for archive, start, ranges in coalesced(arrow_rows(batches)):
            if archive != name:
                if source is not None:
                    source.close()
                store, path = fs.FileSystem.from_uri(archive)
                name, source = archive, store.open_input_file(path)
            data = source.read_at(ranges[-1][0] + ranges[-1][1] - start, start)
            out = []
            for offset, length in ranges:
                fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                body = None
                if fields["warc-type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha1(body).hexdigest() != digest or len(body) != size:
                        raise ValueError(f"{archive} at {offset}: the payload is not what was written")
                row = (_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
                out.append((*row, body) if with_payload else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 6 + with_payload]
            names = [*(x.split()[0] for x in RECORDS.split(", ")), "payload"][: 6 + with_payload]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    spread = index.select("archive", "offset", "length", F.floor(F.col("offset") / TASK_BYTES).alias("stretch"))
    tasks = max(1, min(MOST_TASKS, spread.select("archive", "stretch").distinct().count()))
    spread = spread.repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return spread.mapInArrow(work, RECORDS + ", payload binary" * with_payload)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    return read_records(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
