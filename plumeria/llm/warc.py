"""Operator 4: web archives: writing them, and a normaliser of whole-file gzip streams.

The writer makes one gzip stream of each archive. The normaliser inflates each such stream once, from its first byte to
its last, holding one record at a time, and writes every record as a gzip member of its own, with a sidecar index of
offsets. Readers then cut members by the index. Archives lie in shared tables as chunks of bytes (archive, chunk, base,
data), since executors share no local folders; ``save_archives`` and ``open_archives`` write and read them as files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, written

CHUNK = 1 << 20
ARCHIVE = 32 << 20
#: Fixed names of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = NO_DATE) -> bytes:
    """A response record, or where it refers to another page's, a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = " ".join((url or "about:blank").split())
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased header fields and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class RecordSplitter:
    """Takes inflated bytes in any pieces and gives whole records; holds no more than one record and a piece."""

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        at = 0
        while True:
            if not self.need:
                end = self.buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(self.buffer[at:end]).lower()
                length = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.startswith(b"content-length:")), None)
                if length is None or length < 0:
                    raise ValueError("a record without a content length")
                self.need = end - at + 4 + length + 4
            if len(self.buffer) - at < self.need:
                break
            yield bytes(self.buffer[at : at + self.need])
            at += self.need
            self.need = 0
        del self.buffer[:at]

    def close(self) -> None:
        """Raises where bytes of an unfinished record are left."""
        if self.buffer.strip(b"\r\n"):
            raise ValueError(f"{len(self.buffer)} bytes of a cut record")


class Inflater:
    """Inflates a gzip stream of any number of members, fed in pieces; zero bytes between and after members are padding."""

    def __init__(self) -> None:
        self.member = None

    def feed(self, data: bytes, most: int = 4 << 20) -> Iterator[bytes]:
        while data:
            if self.member is None:
                data = data.lstrip(b"\0")
                if not data:
                    return
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(data, most)
            data = self.member.unconsumed_tail
            if self.member.eof:
                data, self.member = self.member.unused_data, None
            yield out

    def close(self) -> None:
        """Raises where a member has not ended."""
        if self.member is not None:
            raise ValueError("a cut gzip stream")


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: for payloads of at least ``least`` bytes, all but the smallest page_id refer to it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= least, F.sha1(payload)).alias("sha1"))
    groups = rows.where("sha1 is not null").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = written(groups.where("n > 1").select("sha1", "first"), "revisited")
    out = rows.join(several, "sha1", "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Chunks (archive, chunk, data) of archives that are one gzip stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        packer, size, chunk, buffer = None, 0, 0, bytearray()

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal buffer, chunk
            while len(buffer) >= CHUNK or (last and buffer):
                data, buffer = bytes(buffer[:CHUNK]), buffer[CHUNK:]
                yield pa.RecordBatch.from_pydict({"archive": pa.array([f"pages-{task:06d}-{number:04d}"]), "chunk": pa.array([chunk], pa.int32()), "data": pa.array([data], pa.binary())})
                chunk += 1

        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(c)[r].as_py() for c in range(4))
                packer = packer or zlib.compressobj(6, zlib.DEFLATED, 31)
                record = build_record(page_id, url, (html or "").encode(), refers)
                buffer += packer.compress(record)
                size += len(record)
                yield from rows(False)
                if size >= archive_bytes:
                    buffer += packer.flush()
                    yield from rows(True)
                    packer, size, chunk, number = None, 0, 0, number + 1
        if packer is not None:
            buffer += packer.flush()
            yield from rows(True)

    return marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, chunk int, data binary")


INDEX = "archive string, chunk int, start long, length long, record_id string, record_type string, uri string, payload_digest string"
_INDEX_ITEM = pa.struct([("start", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "uri", "payload_digest"))])


def normalise(archives: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Archives with one gzip member for each record (archive, chunk, base, data), and their sidecar index (INDEX).

    ``archives`` are chunks (archive, chunk, data) of any gzip streams, of one member or many. Each archive is read in order
    by one task; the writer bounds an archive's size. ``base`` is a chunk's offset in its archive, ``start`` a member's. A
    stream or record that is cut off, or a record without a length, is an error that names the archive; zero bytes after
    a member are padding. ``parts`` is the number of tasks: by default two for each 32 MB of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inflate, split, base, chunk = None, None, None, 0, 0
        members: list[bytes] = []
        index: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, chunk, members, index
            if members:
                data = b"".join(members)
                yield pa.RecordBatch.from_pydict({
                    "archive": pa.array([now]), "chunk": pa.array([chunk], pa.int32()), "base": pa.array([base], pa.int64()),
                    "data": pa.array([data], pa.binary()), "members": pa.array([index], pa.list_(_INDEX_ITEM)),
                })
                base, chunk, members, index = base + len(data), chunk + 1, [], []

        def records(data: bytes) -> Iterator[bytes]:
            try:
                for out in inflate.feed(data):
                    yield from split.feed(out)
            except (ValueError, zlib.error) as x:
                raise ValueError(f"archive {now}: {x}") from x

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                try:
                    inflate.close()
                    split.close()
                except ValueError as x:
                    raise ValueError(f"archive {now}: {x}") from x
            yield from flush()

        for batch in batches:
            for r in range(batch.num_rows):
                archive, data = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                if archive != now:
                    yield from done()
                    now, inflate, split, base, chunk = archive, Inflater(), RecordSplitter(), 0, 0
                for record in records(data):
                    fields, _ = parse_record(record)
                    member = gzip.compress(record, 6, mtime=0)
                    start = index[-1]["start"] + index[-1]["length"] if index else base
                    index.append({
                        "start": start, "length": len(member), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
                        "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"),
                    })
                    members.append(member)
                    if index[-1]["start"] + len(member) - base >= CHUNK:
                        yield from flush()
        yield from done()

    kinds = "archive string, chunk int, base long, data binary, members array<struct<start:long,length:long,record_id:string,record_type:string,uri:string,payload_digest:string>>"
    parts = parts or max(16, 2 * (archives.select(F.sum(F.octet_length("data"))).first()[0] or 0) // ARCHIVE)
    dealt = archives.repartition(parts, "archive")
    both = written(dealt.sortWithinPartitions("archive", "chunk").select("archive", "chunk", "data").mapInArrow(run, kinds), "members")
    index = written(both.select("archive", "chunk", F.explode("members").alias("m")).select("archive", "chunk", "m.*"), "index")
    return both.drop("members"), index


def read_members(archives: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all records, each cut out by the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                base, data, cuts = batch.column(0)[r].as_py(), batch.column(1)[r].as_buffer(), batch.column(2)[r].as_py()
                out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for cut in cuts:
                    raw = gzip.decompress(data[cut["start"] - base : cut["start"] - base + cut["length"]])
                    fields, block = parse_record(raw)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    refers = fields.get("refers-to-page-id")
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    if refers is None:
                        size, digest = len(payload), base32_sha1(payload)
                        if digest != told:
                            raise ValueError(f"digest of {fields['warc-record-id']} differs")
                    else:
                        size, digest = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), told
                    page = fields.get("page-id")
                    for c, v in zip(out, (int(page) if page else None, size, digest, fields["warc-type"], int(refers) if refers else None), strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_digest"], pa.string()), pa.array(out["record_type"], pa.string()), pa.array(out["refers_to"], pa.int64())], list(out))

    cuts = index.groupBy("archive", "chunk").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    rows = archives.join(cuts, ["archive", "chunk"]).select("base", "data", "cuts")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write (page_id, url, html, ...) to archives, normalise them and read all records back.

    A null html is an empty payload, a null url is about:blank; all empty payloads are equal. Rows that repeat a page_id and
    its payload are responses if theirs is the smallest. Rows with a null page_id are never referred to where another has
    the payload, and are responses. An empty table makes no archive and gives an empty table. Other columns are ignored.
    """
    streams = written(write_archives(mark_revisits(pages, least), archive_bytes), "streams")
    archives, index = normalise(streams)  # both are written tables, so the streams are needed no more
    discard(pages.sparkSession, "streams")
    return read_members(archives, index)


def save_archives(archives: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Write each archive (archive, chunk, data, ...) as ``folder/archive.warc.gz``; returns archive, path and bytes.

    ``folder`` is a URI of a file system that Arrow can open and all executors share. A file is written under a name of its
    attempt and renamed at its end, so a task that runs again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(folder)
        now, out, size = None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                fs.move(f"{root}/.{now}.{attempt}", f"{root}/{now}.warc.gz")
                yield pa.RecordBatch.from_pydict({"archive": [now], "path": [f"{folder}/{now}.warc.gz"], "bytes": [size]})

        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(root)
        for batch in batches:
            for r in range(batch.num_rows):
                archive, data = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                if archive != now:
                    yield from done()
                    now, size = archive, 0
                    out = fs.open_output_stream(f"{root}/.{now}.{attempt}", compression=None)
                out.write(data)
                size += len(data)
        yield from done()

    rows = archives.select("archive", "chunk", "data")
    rows = rows.repartition(parts, "archive") if parts else rows.repartition("archive")
    return written(rows.sortWithinPartitions("archive", "chunk").mapInArrow(run, "archive string, path string, bytes long"), "saved")


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """Chunks (archive, chunk, data) of all .warc.gz files under a path, read in ranges; the archive is the file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = pa_fs.FileSystem.from_uri(name)
                with fs.open_input_stream(at, compression=None) as file:
                    chunk = 0
                    while data := file.read(CHUNK):
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "chunk": pa.array([chunk], pa.int32()), "data": pa.array([data], pa.binary())})
                        chunk += 1

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("path").mapInArrow(run, "archive string, chunk int, data binary")
