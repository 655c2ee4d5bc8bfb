"""WARC archives: a writer that stores equal payloads once, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import shared_folder, staged

MAGIC = b"\x1f\x8b\x08"
MIN_SHARED = 1_000
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
MAX_TASKS = 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:rostrum:page:"
#: Rows that leave a reading task at a time, and bytes of payload among them.
OUT_ROWS, OUT_BYTES = 2_000, 16 << 20


def planned(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for (page_id, url, html).

    Of equal payloads of `min_shared` bytes or more the largest page_id is the response, the others
    revisit it. Rows that repeat that page_id are responses too; where no row of a payload has a
    page_id, all are. A null html is an empty payload. Only digests are grouped; the payload moves once, and a
    payload shared by many pages is a skewed join side that Spark splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    first = rows.filter(F.col("payload_bytes") >= min_shared).groupBy("payload_digest").agg(F.max("page_id").alias("_first"))
    both = rows.join(first, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{page_id if page_id is not None else f'none:{uuid.uuid4()}'}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {n}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Archives of the `planned` rows below `folder`, one gzip member per record -> (path, bytes, records).

    `folder` is a URI that all executors reach. Every task attempt writes files of its own names
    and reports them in its rows; the manifest is a table that Spark commits, so it lists the files
    of the successful attempts alone, whatever was lost, repeated or run twice.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(folder)
        made, path, sink, size, records = [], None, None, 0, 0
        try:
            for batch in batches:
                payloads = batch.column(2).cast(pa.binary())
                rest = [batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)]
                for k, (page_id, url, n, digest, kind, refers_to) in enumerate(zip(*rest)):
                    if sink is None:
                        store.create_dir(root, recursive=True)
                        path, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = store.open_output_stream(f"{root}/{path}", compression=None)  # records compress themselves
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(_record(page_id, url, payloads[k].as_py(), n, digest, kind, refers_to)) + packer.flush()
                    sink.write(data)
                    size, records = size + len(data), records + 1
                    if size >= archive_bytes:
                        sink.close()
                        made.append((path, size, records))
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        if sink is not None:
            made.append((path, size, records))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return staged(rows.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class _Source:
    """Random reads from a file through one cached block."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.block = 0, b""

    def read(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if not self.at <= pos <= pos + n <= self.at + len(self.block):
            self.file.seek(pos)
            self.at, self.block = pos, self.file.read(max(n, READ_BYTES))
        return self.block[pos - self.at : pos - self.at + n]


def _member(source: _Source, pos: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at `pos`; None unless it is whole and opens as a WARC record."""
    decoder, out, at, step = zlib.decompressobj(31), [], pos, 1 << 12
    try:
        while not decoder.eof:
            data = source.read(at, step)
            if not data:
                return None
            out.append(decoder.decompress(data))
            at, step = at + len(data), min(step * 2, 1 << 18)
            if out[0] == b"" and len(out) > 1:
                out.pop(0)
            if not b"WARC/1.".startswith(out[0][:7]):
                return None
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, at - len(decoder.unused_data)) if content.startswith(b"WARC/1.") and b"\r\n\r\n" in content else None


def records_in(source: _Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end).

    Looks for gzip magic and decodes what follows; the magic can also stand inside compressed
    data, which does not decode to a WARC header. Behind a record the next one is expected at once.
    """
    pos, end = start, min(end, source.size)
    while pos < end:
        if source.read(pos, len(MAGIC)) != MAGIC:  # behind a record this is rare
            window = source.read(pos, min(READ_BYTES // 2, end - pos + len(MAGIC) - 1))
            hit = window.find(MAGIC)
            if hit < 0:
                pos += max(1, len(window) - len(MAGIC) + 1)
                continue
            pos += hit
            if pos >= end:
                return
        found = _member(source, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[0]
        pos = found[1]


def parse(content: bytes) -> dict:
    """Header fields in lower case, `block`, and `whole`: the block has its stated length."""
    head, _, body = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields.get("content-length", "0"))
    return fields | {"block": body[:n], "whole": len(body) >= n}


SCHEMA = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, intact boolean"


def read(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archives in a manifest (path, bytes), a row each: SCHEMA, and `payload` if asked for.

    Archives are cut into byte ranges without regard to records; a task owns those that start
    in its range and reads on past its end to finish the last. payload_digest is bare lower-case hex;
    for a response it and payload_bytes are taken from the payload itself, and `intact` tells
    whether they agree with the header. Empty archives give no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("path", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    # The ranges are a few bytes each but stand for much reading: a task for every one, up to a bound.
    ranges = ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)))
    schema = SCHEMA + (", payload binary" if with_payload else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary()][: len(names)]

    def row(path: str, offset: int, content: bytes) -> tuple:
        r = parse(content)
        stated = r.get("warc-payload-digest", "").removeprefix("sha1:")
        digest, size, intact, payload = (base64.b32decode(stated).hex() if stated else None), int(r.get("x-payload-length", "0")), r["whole"], None
        if r.get("warc-type") == "response":
            payload = r["block"].partition(b"\r\n\r\n")[2]
            found = hashlib.sha1(payload).hexdigest()
            intact = intact and found == (digest or found)
            digest, size = found, len(payload)
        return (path, offset, r.get("warc-record-id", "").strip("<>"), r.get("warc-type"), r.get("warc-target-uri"), (r.get("warc-refers-to") or "").strip("<>") or None, digest, size, intact, payload)

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(folder)

        def flush(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for part in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{root}/{part['path']}") as file:
                    for offset, content in records_in(_Source(file), part["start"], part["end"]):
                        rows.append(row(part["path"], offset, content))
                        held += len(content) if with_payload else 0
                        if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return ranges.mapInArrow(run, schema)


def page_of(record: str):
    """The page_id in a record id this module wrote; null for a page without one."""
    return F.regexp_extract(record, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")


def archived(pages: DataFrame) -> DataFrame:
    """`pages` written as archives to a new shared folder and read back: a row per record."""
    folder = shared_folder(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read(write(planned(pages), folder), folder)
