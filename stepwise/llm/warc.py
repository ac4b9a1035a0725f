"""WARC archives with a two-level capture index.

Writing: every page is a record, a gzip member of its own, in the archive file of its task; of equal payloads of at
least ``LEAST_DEDUP`` bytes the smallest page id is a response, the others are revisit records without a
payload.  Index: the captures are sorted by reversed-host key into compressed blocks of
``BLOCK_LINES`` lines, appended to index files with a sparse directory of the blocks' first keys at the
end.  Lookup: the files' first keys choose the files, a binary search in a file's directory
the blocks, range reads get the blocks and then the records.

All files are under one shared folder and are opened through its file system.  A retried task writes a new
file; only files of tasks that succeeded are named in the index.

Defined results: null html is the empty payload; a null url has the empty key; rows of equal id and payload
are all responses or all revisits; null ids come after all others; equal rows get records of their own; an empty table
writes no record.  Columns of the input besides id, url and html are not kept.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm.textbuf import broadcast_if_small, delete_on_exit, stored
from stepwise.session import scratch_path

#: Types of ids that records hold as numbers; ids of other types are held as text.
WHOLE = ("tinyint", "smallint", "int", "bigint")
LEAST_DEDUP = 100
BLOCK_LINES = 256
#: Captures in one index file, about.
FILE_CAPTURES = 200_000
#: Bytes of an archive that one read task is given at once.
CHUNK = 32 << 20
#: Bytes of an archive whose records go to one read task together.
READ_TOGETHER = 4 << 20
#: Fixed date of the records: archives of the same pages are the same bytes.
DATE = "2020-01-01T00:00:00Z"


def file_system(folder: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    for hadoop in ("s3a://", "s3n://"):  # Hadoop's names of a scheme
        folder = f"s3://{folder[6:]}" if folder.startswith(hadoop) else folder
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``org,example)/a?b``; white space and controls are escaped."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return quote(url, safe="/?&=%:,)")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return quote(f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else ""), safe="/?&=%:,)+;@!$'(*~")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{json.dumps(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{json.dumps(refers_to)}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(head["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return head, http, payload


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; the stored captures (key, page_id, file, offset, length)."""
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_DEDUP
    firsts = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = broadcast_if_small(stored(firsts.select(F.col("digest").alias("d"), "first"), "firsts"), 160)
    rows = rows.join(firsts, (F.col("digest") == F.col("d")) & long, "left")
    as_text = (lambda c: F.col(c)) if kind in WHOLE or kind == "string" else (lambda c: F.col(c).cast("string").alias(c))
    rows = rows.select(as_text("page_id"), "url", "payload", "digest", as_text("first"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    kind = kind if kind in WHOLE else "string"

    def archive(batches):
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "first", "revisit")]
                keys, offsets, lengths = [], [], []
                for i in range(b.num_rows):
                    pid, u, payload, digest, first, revisit = (c[i].as_py() for c in cols)
                    if out is None:
                        system, path = file_system(folder)
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    member = gzip.compress(record(pid, u, payload, digest, first, revisit), 6, mtime=0)
                    out.write(member)
                    keys.append(url_key(u))
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), cols[0], pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(archive, f"key string, page_id {kind}, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the index files; the stored list of them (name, first_key, last_key), one row per file."""
    files = 1 + captures.count() // FILE_CAPTURES
    ordered = captures.repartitionByRange(files, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def pack(batches):
        out, at, directory, lines, last, name = None, 0, [], [], "", f"{uuid.uuid4().hex}.cdx"

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((lines[0].split("\t", 1)[0], at, len(block)))
            out.write(block)
            at += len(block)
            lines = []

        for b in batches:
            for key, file, offset, length in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    system, path = file_system(folder)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                last = key
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(tail + struct.pack(">Q", len(tail)))
        out.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "first_key": [directory[0][0]], "last_key": [last]})

    return stored(ordered.mapInArrow(pack, "name string, first_key string, last_key string"), "index_files")


class IndexFile:
    """A capture index file: its directory, and the captures of a key by binary search."""

    def __init__(self, folder: str, name: str):
        system, path = file_system(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        tail = struct.unpack(">Q", self.file.read_at(8, size - 8))[0]
        self.directory = json.loads(zlib.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.firsts = [d[0] for d in self.directory]
        self.held = (-1, [])

    def block(self, i: int) -> list[list[str]]:
        if self.held[0] != i:
            _, at, size = self.directory[i]
            self.held = (i, [line.split("\t") for line in zlib.decompress(self.file.read_at(size, at)).decode().split("\n")])
        return self.held[1]

    def find(self, key: str):
        """(file, offset, length) of every capture of a key."""
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            for k, file, offset, length in self.block(i):
                if k == key:
                    yield file, int(offset), int(length)


def lookup(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(key, file, offset, length): the captures of the distinct keys of ``wanted``.

    The driver holds one row per index file, FILE_CAPTURES captures each.
    """
    found = sorted((r["first_key"], r["last_key"], r["name"]) for r in files.collect())
    firsts, lasts, names = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    @F.arrow_udf("array<string>")
    def holders(keys: pa.Array) -> pa.Array:
        return pa.array([names[bisect_left(lasts, k):bisect_right(firsts, k)] for k in keys.to_pylist()], pa.list_(pa.string()))

    def search(batches):
        name, index = None, None
        for b in batches:
            rows = []
            for n, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != name:
                    name, index = n, IndexFile(folder, n)
                rows.extend((key, *hit) for hit in index.find(key))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    keys = wanted.select("key").where("key is not null").distinct()
    # a number of its own: the keys are few bytes, what is read for them isn't
    parts = max(slots(wanted), len(names))
    asked = keys.select(F.explode(holders("key")).alias("name"), "key").repartitionByRange(parts, "name", "key").sortWithinPartitions("name", "key")
    return asked.mapInArrow(search, "key string, file string, offset long, length long")


def slots(df: DataFrame) -> int:
    """Tasks of the cluster."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def read(captures: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """The records at the captures (file, offset, length): page_id, payload, payload_bytes, payload_digest, record_type, refers_to.

    There are as many read tasks as CHUNKs in the records asked for, and one for each task slot at least.
    The digest of a response is that of the payload read, and must be the one in its header.
    """
    def fetch(batches):
        name, file = None, None
        for b in batches:
            got = []
            for n, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if n != name:
                    system, path = file_system(folder)
                    name, file = n, system.open_input_file(f"{path}/{n}")
                head, http, payload = parse(gzip.decompress(file.read_at(length, offset)))
                revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest differs at {n}:{offset}")
                size = int(http.rpartition(b"Content-Length: ")[2])
                pid = lambda field: json.loads(head[field][len("<urn:page:"):-1])
                got.append((pid("WARC-Record-ID"), None if revisit else payload, size, digest, head["WARC-Type"], pid("WARC-Refers-To") if revisit else None))
            cols = list(zip(*got, strict=True)) or [[]] * 6
            kind = pa.string() if id_type == "string" else pa.int64()
            types = (kind, pa.binary(), pa.int64(), pa.string(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    captures = stored(captures.select("file", "offset", "length"), "asked")
    parts = max(slots(captures), -(-int(captures.agg(F.sum("length")).first()[0] or 0) // CHUNK))
    ordered = captures.withColumn("part", F.floor(F.col("offset") / READ_TOGETHER)).repartition(parts, "file", "part").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(fetch, f"page_id {id_type}, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives and indexes the pages, then reads every capture of their urls back through the index."""
    folder = scratch_path(spark, "warc")
    captures = write(pages, folder)
    files = build_index(captures, folder)
    kind = dict(pages.dtypes)["page_id"]
    delete_on_exit(spark, folder)
    found = read(lookup(captures.select("key"), files, folder), folder, "long" if kind in WHOLE else "string")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
