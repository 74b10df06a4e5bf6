"""WARC archives: a deterministic sharded writer and a reader.

Records are cut into ranges of page ids by size-weighted sampled splitters and sorted; each range is written by one task as
gzip files, a member per record, a new file when the compressed size passes `roll_bytes`. Headers and digests are made anew
from the payload. Files get their final names only when a written manifest holds them all; a task that runs twice leaves
files that the manifest does not name, and these are deleted with the temporary folder. The same rows and parameters
give the same files, whatever the cluster.

Of records with equal payloads of at least `revisit_bytes` the one with the smallest page id is a response, the others are
revisits that refer to it, row by row: an id may have payloads of both kinds. Rows that repeat a page id and payload of which no
smaller id has a copy are responses each. Null html is an empty payload, a null url an empty target. Null page ids are written last and refer as others do. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import text_buffer
from ._shared import apart, longs, written
from .sharding import range_of, splitters

ROLL_BYTES = 16 << 20
#: Bytes of html in a range for a byte of roll_bytes: html that compresses to a quarter fills four files a range.
RANGE_ROLLS = 16
#: Bytes of a file that the reader decompresses at once.
READ_BYTES = 64 << 10
MAX_RANGES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _info(name: str, date: str) -> bytes:
    body = b"software: runnel\r\nformat: WARC File Format 1.0\r\n"
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return _gzip(head.encode() + body + CRLF * 2)


def revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """page_id, digest (SHA-256) and hash (xxhash64) of the payload, and refers_to, of the pages whose payload an earlier page has."""
    html = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.where(F.octet_length(html) >= revisit_bytes).select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.xxhash64(html).alias("hash"))
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ids.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "hash", "refers_to").distinct()


def range_count(total: int, roll_bytes: int = ROLL_BYTES, range_bytes: int | None = None) -> int:
    return min(MAX_RANGES, max(16, total // (range_bytes or RANGE_ROLLS * roll_bytes)))


def write(pages: DataFrame, path: str, revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int | None = None, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as path/data/*.warc.gz and returns the manifest: a row a file.

    A range has about range_bytes of html, RANGE_ROLLS times roll_bytes by default, so that rolling decides the sizes of files;
    small tables, of less than 16 such ranges, are cut into 16 all the same.
    """
    spark = pages.sparkSession
    sized = pages.select(F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)).alias("key"), F.col("page_id").alias("id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 400).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    bounds = splitters(sized, range_count(total, roll_bytes, range_bytes))
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", F.col("url"), F.col("html"), F.lit(None).cast("long").alias("refers_to"), none.alias("digest"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("hash"), F.lit(True).alias("page"))
    marks = revisits(pages, revisit_bytes).select("page_id", none.alias("url"), none.alias("html"), "refers_to", "digest", "hash", F.lit(False).alias("page"))
    both = rows.unionByName(marks).withColumn("range", range_of(F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)), bounds))
    n = len(bounds) + 1
    both = both.withColumn("place", F.get(longs(apart(n)), F.col("range")).cast("int"))  # each range is a task
    # the marks of an id and hash come just before its pages
    order = [F.col("range"), F.asc_nulls_last("page_id"), F.col("hash"), F.col("page"), F.col("url")]
    dealt = both.repartition(n, "place").sortWithinPartitions(*order).drop("place")
    attempt_dir = f"{path.rstrip('/')}/_temporary"

    def run(batches):
        store, root = pafs.FileSystem.from_uri(attempt_dir)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        out, state, marked, marks = None, {}, None, {}

        def close():
            out.write(state["buffer"])
            out.close()
            return state["range"], state["name"], state["temp"], state["records"], state["bytes"]

        for batch in batches:
            files = []
            html = batch.column("html")
            data, offs = text_buffer(html.fill_null("") if html.null_count else html)
            ids, urls, refers, digests, hashes, page, ranges = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "digest", "hash", "page", "range"))
            for i, pid in enumerate(ids):
                if marked != (pid, hashes[i]):
                    marked, marks = (pid, hashes[i]), {}
                if not page[i]:
                    marks[digests[i]] = refers[i]
                    continue
                if out is None or state["range"] != ranges[i] or state["bytes"] >= roll_bytes:
                    if out is not None:
                        files.append(close())
                    part = state["part"] + 1 if out is not None and state["range"] == ranges[i] else 0
                    name = f"part-{ranges[i]:05d}-{part:05d}.warc.gz"
                    state = {"range": ranges[i], "part": part, "name": name, "temp": f"{name}.{attempt}", "records": 0, "buffer": bytearray(_info(name, date)), "bytes": 0}
                    state["bytes"] = len(state["buffer"])
                    out = store.open_output_stream(f"{root}/{state['temp']}")
                payload = bytes(data[offs[i] : offs[i + 1]])
                refers_to = marks.get(hashlib.sha256(payload).hexdigest()) if marks else None
                raw = _gzip(record(pid, urls[i] or "", payload, refers_to, refers_to is not None, date))
                state["buffer"] += raw
                state["bytes"] += len(raw)
                state["records"] += 1
                if len(state["buffer"]) > 1 << 20:
                    out.write(state["buffer"])
                    state["buffer"] = bytearray()
            if files:
                yield _manifest(files)
        if out is not None:
            yield _manifest([close()])

    manifest = written(dealt.mapInArrow(run, "range int, name string, temp string, records long, bytes long"), "warc-manifest")

    def rename(batches):
        store, root = pafs.FileSystem.from_uri(attempt_dir)
        final = root.removesuffix("/_temporary") + "/data"
        store.create_dir(final, recursive=True)
        for batch in batches:
            for name, temp in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{temp}", f"{final}/{name}")
                elif store.get_file_info(f"{final}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{temp}")
            yield batch

    done = written(manifest.mapInArrow(rename, manifest.schema).drop("temp"), "warc-committed")
    conf = spark._jsc.hadoopConfiguration()
    at = spark._jvm.org.apache.hadoop.fs.Path(attempt_dir)
    at.getFileSystem(conf).delete(at, True)
    done.coalesce(1).write.json(f"{path.rstrip('/')}/manifest")
    return done


def _manifest(files: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files, strict=True), types, strict=True)], names=["range", "name", "temp", "records", "bytes"])


def records(raw: bytes):
    """Headers (a dict with lower-case names) and block of each record of a gzip file."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # in pieces: what follows a record is copied each time
            if at >= len(raw):
                raise ValueError("a record is cut off")
            parts.append(z.decompress(view[at : at + READ_BYTES]))
            at = min(len(raw), at + READ_BYTES)
        at -= len(z.unused_data)
        body = b"".join(parts)
        head, _, block = body.partition(CRLF * 2)
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, block[: int(fields["content-length"])]


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a page record of the archives under path; digests of responses are checked against their payloads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(f"{path.rstrip('/')}/data").select("content")

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for f, block in records(raw.as_py()):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(CRLF * 2)
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"wrong digest: {f['warc-record-id']}")
                    size = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
                    rows.append((int(f["x-page-id"]) if f["x-page-id"] else None, f["warc-target-uri"], f["warc-type"], size, digest, int(f["x-refers-to-page-id"]) if "x-refers-to-page-id" in f else None, payload if f["warc-type"] == "response" else None))
                    if len(rows) == 2000:
                        yield _rows(rows, payloads)
                        rows = []
                if rows:
                    yield _rows(rows, payloads)

    return files.mapInArrow(run, READ_SCHEMA + (", payload binary" if payloads else ""))


def _rows(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    n = 7 if payloads else 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names=names[:n])
