"""WARC archives: written one per task, read back and assembled into captures.

A page becomes three records, each a gzip member of its own: the response (or a revisit of the
record that already holds the payload), and a request and a metadata record that name it in
WARC-Concurrent-To. The reader parses records of any archive in this form, joins them through their
concurrent-to identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch_path, with_place
from .files import open_fs

#: Bytes after which a task starts another archive; level of the gzip members; bytes read at once.
ARCHIVE_BYTES, LEVEL, READ_BYTES = 1 << 30, 1, 1 << 20
#: Rows of the table of repeated payloads that may be broadcast (about 200 bytes each).
BROADCAST_ROWS = 150_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\""
RECORD = "type string, id string, concurrent_to string, refers_to string, url string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, own: str, original: str | None, original_url: str | None) -> list[bytes]:
    """The records of one page: response or revisit, request, metadata. own and original are record identifiers."""
    date, (uri, original_uri) = "1970-01-01T00:00:00Z", (None if u is None else quote(u, safe=_URL_SAFE) for u in (url, original_url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC-Date": date, "WARC-Target-URI": uri}
    about = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if original is None:
        first = record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{own}>", **common, **about}, http + payload)
    else:
        first = record({"WARC-Type": "revisit", "WARC-Record-ID": f"<urn:uuid:{own}>", **common, **about, "WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{original}>", "WARC-Refers-To-Target-URI": original_uri, "WARC-Refers-To-Date": date}, http)
    parts = urlsplit(uri or "")
    get = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    sub = {k: f"<urn:uuid:{uuid.uuid5(uuid.UUID(own), k)}>" for k in ("request", "metadata")}
    with_first = {**common, "WARC-Concurrent-To": f"<urn:uuid:{own}>"}
    request = record({"WARC-Type": "request", "WARC-Record-ID": sub["request"], **with_first, "Content-Type": "application/http; msgtype=request"}, get)
    meta = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [first, request, record({"WARC-Type": "metadata", "WARC-Record-ID": sub["metadata"], **with_first, "Content-Type": "application/warc-fields"}, meta)]


def write_archives(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives and return their manifest (path, captures).

    Of pages with equal payloads of at least min_bytes the one with the smallest page_id is the response and the
    others revisit it; rows that repeat a page_id are pages of their own, the first in place being the response. A
    null html is an empty payload, a null page_id the smallest, a null url is left out; other columns are ignored;
    no rows give no archives. Payloads are not shuffled while the table of repeated payloads is small
    enough to be sent to all tasks. A task that runs again writes other files; the manifest names only
    files of committed tasks.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    rows = with_place(pages, "page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "file", F.col("row").cast("string")))
    rows = rows.select("page_id", "url", payload.alias("payload"), own.alias("own"))
    keys = materialize(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "own", "url", F.unhex(F.sha2("payload", 256)).alias("digest")), "payload-digests")
    groups = keys.groupBy("digest").agg(F.min(F.struct("page_id", "own", "url")).alias("original"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1"), "repeated-payloads")
    n_repeated, n_rows = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    if n_repeated <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        again = join_groups(keys.join(repeated, "digest", "left_semi"), repeated, "digest", "n", n_rows)
        rows = rows.join(again.select("own", "original"), "own", "left")
    revisit = F.col("original.own") != F.col("own")
    rows = rows.select("page_id", "url", "payload", "own", F.when(revisit, F.col("original.own")).alias("original"), F.when(revisit, F.col("original.url")).alias("original_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_fs(path)
        system.create_dir(folder, recursive=True)
        out, name, size, captures, done = None, "", 0, 0, []
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, captures = system.open_output_stream(f"{folder}/{name}", compression=None), 0
                    size = out.write(_gzip(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC/1.1\r\n")))
                for r in page_records(*(v.as_py() for v in values)):
                    data = _gzip(r)
                    out.write(data)
                    size = (size or 0) + len(data)
                captures += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{path}/{name}", captures))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", captures))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "captures": pa.array([d[1] for d in done], pa.int64())})

    return materialize(rows.mapInArrow(run, "path string, captures long"), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(READ_BYTES):
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def parse_record(data: bytes, payloads: bool) -> tuple | None:
    """A row of RECORD. The digest of a response is of the payload as found; a revisit gives its header's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = parse_headers(head)
    block = rest[: int(h["content-length"])]
    kind, fields, payload, size, digest = h["warc-type"], {}, None, None, None
    if kind in ("response", "revisit", "request"):
        http, _, body = block.partition(b"\r\n\r\n")
        fields = parse_headers(http)
        if kind == "response":
            size, digest, payload = len(body), sha1_base32(body), body if payloads else None
            if h.get("warc-payload-digest", "").removeprefix("sha1:") not in ("", digest):
                raise ValueError(f"payload of {h['warc-record-id']} is damaged")
        elif kind == "revisit":
            size, digest = int(fields.get("content-length", -1)), h.get("warc-payload-digest", "").removeprefix("sha1:")
    elif kind == "metadata":
        fields = parse_headers(b"\r\n" + block)
    else:
        return None
    return kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, payload, list(fields.items())


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of RECORD for all request, response, revisit and metadata records of the archives in manifest (path)."""
    types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, name = open_fs(uri)
                held, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        if row := parse_record(data, payloads):
                            held.append(row)
                            size += len(data) if payloads else 300
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: id, url, response (struct; type tells a revisit), request and metadata (structs or null).

    Requests and metadata name their response, or the response names its request; metadata may also name
    the request. Of several requests or metadata of one capture the smallest identifier stays.
    Captures without them have nulls; records that belong to no capture go.
    """
    records = materialize(records, "warc-records")
    first = records.where("type in ('response', 'revisit')")
    request = records.where("type = 'request'")
    metadata = records.where("type = 'metadata'")
    pairs = request.where("concurrent_to is not null").select(F.col("id").alias("sub"), F.col("concurrent_to").alias("capture"))
    pairs = pairs.unionByName(first.where("concurrent_to is not null").select(F.col("concurrent_to").alias("sub"), F.col("id").alias("capture")))
    requests = pairs.join(request.select(F.col("id").alias("sub"), F.struct("id", "url", "fields").alias("request")), "sub").groupBy("capture").agg(F.min_by("request", "sub").alias("request"))
    of_request = metadata.join(pairs.withColumnRenamed("sub", "concurrent_to"), "concurrent_to").select("capture", "id", "fields")
    named = metadata.select(F.col("concurrent_to").alias("capture"), "id", "fields").unionByName(of_request)
    named = named.groupBy("capture").agg(F.min_by(F.struct("id", "fields"), "id").alias("metadata"))
    response = first.select(F.col("id").alias("capture"), "url", F.struct("type", "refers_to", "digest", "payload_bytes", "payload", "fields").alias("response"))
    return response.join(requests, "capture", "left").join(named, "capture", "left").withColumnRenamed("capture", "id")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures (as assemble gives them) with the column original: the capture that WARC-Refers-To names, as a struct of id, url and metadata.

    Null for a response, and for a revisit whose original is not among the captures. Many revisits of one capture are
    spread before they meet it: captures that over 1/1024 of all rows refer to are few and are broadcast.
    """
    captures = materialize(captures, "warc-captures")
    refers = captures.where("response.type = 'revisit' and response.refers_to is not null").select("id", F.col("response.refers_to").alias("__to"))
    named = refers.groupBy("__to").agg(F.count("*").alias("__n"))
    originals = captures.where("response.type <> 'revisit'").select(F.col("id").alias("__to"), F.struct("id", "url", "metadata").alias("original"))
    originals = materialize(originals.join(named, "__to"), "warc-originals")
    found = join_groups(refers.join(originals.select("__to"), "__to", "left_semi"), originals, "__to", "__n", captures.count())
    return captures.join(found.select("id", "original"), "id", "left")
