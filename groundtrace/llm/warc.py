"""WARC archives: written by tasks, read back record by record.

A record is one gzip member. The reader is sequential: it inflates incrementally, frames each block by
Content-Length and holds the digests of block and payload against the headers while the bytes pass, so
memory does not depend on the size of a record unless its payload is asked for. Archives roll over at
``ARCHIVE_BYTES``; each is one unit of reading.

Tasks write below a folder all executors reach under names of their own attempt. The returned manifest
names the archives of the attempts that Spark accepted; files of lost attempts are never read.

Defined cases: null html is an empty payload. A null or non-ASCII url is left out or percent-encoded. Pages of
equal payload of at least ``REVISIT_BYTES`` bytes: those of the smallest page_id are responses, the others
revisits of it; where no page of the group has an id, all are responses. Repeated rows are separate records.
An empty table gives no archive and an empty result. Extra columns are ignored.
"""

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import Work, arrow_batches

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, valid boolean"


def open_file(path: str, mode: str):
    """A binary stream, without pyarrow's own decompression, on any file system that it knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        system, name = fs.LocalFileSystem(), path
    else:
        system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    if mode == "rb":
        return system.open_input_stream(name, compression=None)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def _record(page_id, url, payload: bytes, kind: str, digest: str, refers_to) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="~:/?#[]@!$&'()*+,;=%-._"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, first): ``first`` is the page that holds the payload, if another does."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("digest").alias("d"), "first")
    joined = rows.join(groups, F.col("digest") == F.col("d"), "left").drop("d")
    return joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write(pages: DataFrame, work: Work) -> DataFrame:
    """Write all pages; the manifest: (path, records)."""
    arrow_batches(pages.sparkSession)
    folder = f"{work.folder}/warc"

    def run(batches):
        context = TaskContext.get()
        stem = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done, file, size, count, path = [], None, 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    path, size, count = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    file = open_file(path, "wb")
                kind = "response" if row["first"] is None else "revisit"
                data = _record(row["page_id"], row["url"], row["html"].encode(), kind, row["digest"], row["first"])
                file.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    file.close()
                    file = None
                    done.append((path, count))
        if file is not None:
            file.close()
            done.append((path, count))
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())],
                              names=["path", "records"])

    return work.store(with_revisits(pages).mapInArrow(run, "path string, records long"))


class _Member:
    """The inflated bytes of one gzip member of a stream."""

    def __init__(self, source):
        self.source, self.rest, self.inflate = source, b"", None

    def start(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(READ_BYTES)
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return self.inflate is not None

    def read(self) -> bytes:
        """The next bytes of the member, empty at its end."""
        while not self.inflate.eof:
            if not self.rest:
                self.rest = self.source.read(READ_BYTES)
                if not self.rest:
                    raise ValueError("archive ends inside a record")
            data = self.inflate.decompress(self.rest, READ_BYTES)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                return data
        return b""


def _until(member: _Member, data: bytes, mark: bytes, limit: int = 1 << 20) -> tuple[bytes, bytes]:
    while (at := data.find(mark)) < 0:
        more = member.read()
        if not more or len(data) > limit:
            raise ValueError("record without end of header")
        data += more
    return data[:at], data[at + len(mark):]


def read_archive(source, payloads: bool = False):
    """Records of an open archive, in order: dict of headers, payload size and digest, validity, payload."""
    member = _Member(source)
    while member.start():
        head, data = _until(member, b"", b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        block, payload, size, kept, http = hashlib.sha256(), hashlib.sha256(), 0, [], b""
        inside = False  # past the HTTP header
        while left:
            part = data[:left]
            data = data[left:]
            left -= len(part)
            block.update(part)
            if not inside:
                http += part
                at = http.find(b"\r\n\r\n")
                inside = at >= 0
                part = http[at + 4:] if inside else b""
            payload.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
            if left and not data:
                data = member.read()
                if not data:
                    raise ValueError("record is shorter than its Content-Length")
        while more := member.read():
            data += more
        if data != b"\r\n\r\n":
            raise ValueError("record is longer than its Content-Length")
        valid = fields.get("warc-block-digest") == "sha256:" + block.hexdigest()
        if fields["warc-type"] == "response":
            valid &= fields.get("warc-payload-digest") == "sha256:" + payload.hexdigest()
        yield fields, size, payload.hexdigest(), valid, b"".join(kept)


def read(manifest: DataFrame) -> DataFrame:
    """All records of the archives of a manifest, a task for each archive at most; revisits as written."""
    def run(batches):
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "valid"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_file(path, "rb") as source:
                    for fields, size, digest, valid, _ in read_archive(source):
                        revisit = fields["warc-type"] == "revisit"
                        page, other = fields.get("warc-page-id"), fields.get("warc-refers-to-page")
                        stated = fields["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"],
                                     None if revisit else size, stated if revisit else digest,
                                     int(other) if other else None, valid))
                        if len(rows) == 2000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    arrow_batches(manifest.sparkSession)
    archives = manifest.select("path").repartition(
        max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return archives.mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with every revisit given the payload size of the response it refers to.

    A record with a wrong digest, or a revisit without its response, raises.
    """
    wrong = F.raise_error(F.concat(F.lit("invalid record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    good = records.withColumn("payload_digest", F.when(F.col("valid"), F.col("payload_digest")).otherwise(wrong.cast("string")))
    response = good.filter("record_type = 'response'")
    target = response.groupBy(F.col("payload_digest").alias("d")).agg(
        F.min("page_id").alias("target"), F.max("payload_bytes").alias("size"))
    revisit = good.filter("record_type = 'revisit'").join(target, F.col("payload_digest") == F.col("d"), "left")
    found = revisit.withColumn("payload_bytes", F.when(
        F.col("refers_to").eqNullSafe(F.col("target")), F.col("size")).otherwise(wrong.cast("long")))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(columns).unionByName(found.select(columns))
