"""WARC archives: writing, normalising to one gzip member a record, reading.

An archive that is one gzip stream can only be read from its start. The
normaliser inflates such a stream once, rewrites every record as a gzip member
of its own and writes a sidecar index of offsets, so that single records can be
read with one seek.

Archives are files in a folder that all executors share. A task writes under a
name of its own attempt and renames at the end, so a lost or repeated task
leaves a whole file or none. What tasks return is the list of files.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, join_by_count

REVISIT_BYTES = 1000
CHUNK = 1 << 20
GZIP = 31  # window bits of zlib for a gzip stream
LEVEL = 3
#: Fixed names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")
INDEX = "archive string, ordinal long, offset long, length long, record_type string, record_id string, uri string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class AtomicFile:
    """A file that has its name only once it is whole."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _store(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.file = self.fs.open_output_stream(self.temporary)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind:
            self.fs.delete_file(self.temporary)
        else:
            self.fs.move(self.temporary, self.path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    uri = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
           f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"] if revisit else []),
        f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(headers["Content-Length"])
    if len(rest) < length + 4:
        raise ValueError("a record is cut off")
    return headers, rest[:length]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream, holding one at a time."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                found = re.search(rb"\r\nContent-Length: (\d+)", held[:at])
                if not found:
                    raise ValueError("a record has no length")
                need = at + 4 + int(found[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in chunks."""
    inflate = zlib.decompressobj(GZIP)
    while data := file.read(CHUNK):
        while data:
            out = inflate.decompress(data, 4 * CHUNK)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(GZIP)


def deflated(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return deflate.compress(data) + deflate.flush()


def with_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages with ``payload``, ``digest`` and ``refers_to``: of equal payloads of
    at least ``REVISIT_BYTES``, the page of the largest id is the response that
    the others refer to. Only digests that repeat are joined back, from a written
    table, the most frequent ones by broadcast. Spark knows the size of the rest
    and ships it where it is below the session's broadcast threshold, so that
    payloads stay where they are; beyond it both sides are merged by digest."""
    read = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    read = read.withColumn("digest", F.sha1("payload"))
    long_ = read.where(F.octet_length("payload") >= REVISIT_BYTES)
    repeated = long_.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = scratch.keep(repeated, "repeated")
    return join_by_count(read, repeated, ["digest"], how="left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One whole-stream gzip WARC file for each partition of ``pages``
    (``page_id``, ``url``, ``payload``, ``digest``, ``refers_to``); returns ``archive``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/whole/part-{TaskContext.get().partitionId():06d}.warc.gz"
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        with AtomicFile(path) as out:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        revisit = r["refers_to"] is not None and r["refers_to"] != r["page_id"]
                        out.write(deflate.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], revisit)))
                batch = next(batches, None)
            out.write(deflate.flush())
        yield pa.RecordBatch.from_pydict({"archive": [path]})

    return pages.mapInArrow(write, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column ``archive``) with a gzip member for each record.

    Each is inflated once, as a stream. Returns the index: ``archive`` (the new
    file), ``ordinal``, ``offset`` and ``length`` of the member, and
    ``record_type``, ``record_id``, ``uri``. The same index is a sidecar file
    next to each new archive, as tab-separated lines.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                store, at = _store(source)
                path = f"{folder}/members/{at.rsplit('/', 1)[1]}"
                rows: list[dict] = []
                with AtomicFile(path) as out, AtomicFile(f"{path}.idx") as sidecar:
                    offset, count = 0, 0
                    for data in records(inflated(store.open_input_stream(at, compression=None))):
                        headers, _ = parse(data)
                        member = deflated(data)
                        out.write(member)
                        rows.append({
                            "archive": path, "ordinal": count, "offset": offset, "length": len(member), "record_type": headers.get("WARC-Type"),
                            "record_id": headers.get("WARC-Record-ID"), "uri": headers.get("WARC-Target-URI"),
                        })
                        sidecar.write("\t".join(str(v) for k, v in rows[-1].items() if k != "archive").encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)

    return archives.mapInArrow(rewrite, INDEX)


INDEX_ARROW = pa.schema([
    ("archive", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
])
READ = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records by index row: ``page_id``, ``record_type``, ``refers_to``,
    ``payload`` (null for revisits, or without ``payloads``), and bytes and
    SHA-1 of the full payload. Those of a response are taken from its payload,
    and must equal what its headers say."""
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    if r["archive"] != opened:
                        store, path = _store(r["archive"])
                        opened, file = r["archive"], store.open_input_file(path)
                    file.seek(r["offset"])
                    headers, block = parse(zlib.decompress(file.read(r["length"]), GZIP))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what its header says")
                    rows.append({
                        "page_id": int(headers["X-Page"]) if headers["X-Page"] else None, "record_type": headers["WARC-Type"],
                        "refers_to": int(headers["X-Refers-To-Page"]) if headers.get("X-Refers-To-Page") else None,
                        "payload": payload if payloads and not revisit else None, "payload_bytes": size, "payload_digest": digest,
                    })
                yield pa.RecordBatch.from_pylist(rows, READ_ARROW)

    return index.mapInArrow(read, READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) to archives, normalise
    them, and return the index.

    ``folder`` (a URI) is in the shared folder by default. Null html is an
    empty payload; a null url is about:blank. Rows that repeat a page are
    records of their own; of equal payloads the largest page_id is the
    response, and where several rows have it, all of them are; with null ids
    only, all are responses. Other columns are ignored; an empty table makes no
    archive.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or f"{scratch.root}/archives"
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    scheme, at = folder.split("://", 1)[0], F.col("archive")
    whole = scratch.keep(write_archives(with_roles(pages, scratch), folder), "whole")
    named = whole.select(F.when(at.contains("://"), at).otherwise(F.concat(F.lit(f"{scheme}://"), at)).alias("archive"))
    return scratch.keep(normalise(named.repartitionByRange(max(1, whole.count()), "archive"), folder), "index")  # an archive is a task


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages`` written, normalised and read back, a row a page. Null html is an
    empty payload; repeated rows are records of their own; an empty table gives
    no rows."""
    index = archive(documents(spark, sf_dir, "pages"))
    found = read_records(index, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    """DuckDB SQL of :func:`op5_warc_normaliser`."""
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to FROM r
"""
