"""WARC archives: writing records, and reading them as a chunked record table.

A payload is one row for each chunk of at most CHUNK bytes: record identifier, chunk number,
bytes, and the digest of all bytes so far. Writer and reader hold one chunk at a time,
however large a record is; the last chunk's row has the digest and the size of the whole.

Archives are real ``.warc.gz`` files, a gzip member for each record, written by the tasks to
a folder that all executors share. Names are unique to each attempt of a task, and only files
that the stored manifest lists are read, so a lost executor leaves at most unlisted files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from disputeflow.llm.frames import batches, raw, rows, staged
from disputeflow.operators.skew import join_dimension
from disputeflow.session import shared_folder

CHUNK = 64 << 10
#: Payloads below this size are always stored in full.
REVISIT_BYTES = 100
#: A task begins another archive beyond this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Tasks that read archives, at most.
READERS = 50_000
LEVEL = 5
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
GZIP = 31

MANIFEST = "archive string, n_records bigint, n_bytes bigint"
CHUNKS = (
    "archive string, record_id bigint, record_type string, refers_to bigint, url string, "
    "chunk_no bigint, data binary, payload_bytes bigint, payload_digest string, is_last boolean, intact boolean"
)


def marked(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(record_id, url, payload, payload_bytes, payload_digest, refers_to)`` for each page.

    ``refers_to`` is set where an equal payload of at least REVISIT_BYTES belongs to a
    smaller id. Revisits are found among ids and digests alone; a digest that a third of
    all pages have is salted, and payloads are dealt by id and digest.
    """
    named = pages.select(
        F.col(key).cast("bigint").alias("record_id"), F.col(url).cast("string").alias("url"), raw(payload).alias("payload")
    ).select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    slim = staged(named.where(F.col("payload_bytes") >= REVISIT_BYTES).select("record_id", "payload_digest"), "digests")
    first = slim.groupBy("payload_digest").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = join_dimension(slim, first.where("n > 1").drop("n"), "payload_digest")
    later = found.where(F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))).distinct()
    later = later.select(F.col("record_id").alias("later_id"), F.col("payload_digest").alias("later_digest"), "first")
    same = named["record_id"].eqNullSafe(later["later_id"]) & (named["payload_digest"] == later["later_digest"])
    joined = named.join(later, same, "left")
    return joined.select("record_id", "url", "payload", "payload_bytes", "payload_digest", F.col("first").alias("refers_to"))


def chunk_rows(records: DataFrame) -> DataFrame:
    """The records of ``marked`` with a row for each chunk; revisits have one empty chunk."""
    data = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(data) / CHUNK), F.lit(1)) - 1
    numbered = records.select(
        "record_id", "url", "payload_bytes", "payload_digest", "refers_to", data.alias("payload"),
        last.cast("int").alias("last"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no"),
    )
    return numbered.select(
        "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no",
        (F.col("chunk_no") == F.col("last")).alias("is_last"),
        F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("data"),
    )


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _number(value: int | None) -> str:
    return "" if value is None else str(value)


def record_start(record_id, url, payload_bytes, payload_digest, refers_to) -> bytes:
    """All of a record that stands before its payload."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{_number(record_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else payload_bytes))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _one_line(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return _header(fields) + http


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Archive:
    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = _open(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(path, compression=None)
        self.n_records = self.n_bytes = 0
        self.member = None
        self.write(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                            ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]))
        self.end()

    def write(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        self._put(self.member.compress(data))

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self._put(self.member.flush())
        self.member = None

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.n_bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        return self.uri, self.n_records, self.n_bytes


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: without one, executors would take it for their own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``chunk_rows`` below ``folder``; returns the stored manifest."""
    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(found):
        def each():
            archive = None
            for record_id, url, size, digest, refers_to, number, is_last, data in rows(found):
                if number == 0:
                    if archive is not None and archive.n_bytes > ARCHIVE_BYTES:
                        yield archive.close()
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.write(record_start(record_id, url, size, digest, refers_to))
                archive.write(data)
                if is_last:
                    archive.end()
                    archive.n_records += 1
            if archive is not None:
                yield archive.close()

        return batches(each(), schema)

    return staged(chunks.mapInArrow(write, MANIFEST), "manifest")


class _Bytes:
    """Decompressed bytes of a file of gzip members, a piece at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.member, self.held = stream, None, b""
        self.pieces = self._pieces()

    def _pieces(self) -> Iterator[bytes]:
        while packed := self.stream.read(CHUNK):
            while packed:
                if self.member is None:
                    self.member = zlib.decompressobj(GZIP)
                data = self.member.decompress(packed, CHUNK)
                if data:
                    yield data
                packed = self.member.unconsumed_tail
                if self.member.eof:
                    packed, self.member = self.member.unused_data, None
        if self.member is not None:
            raise EOFError("an archive ends within a record")

    def more(self) -> bool:
        data = next(self.pieces, b"")
        self.held += data
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise EOFError("an archive ends within a header")
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        if len(self.held) < size:
            raise EOFError("an archive ends within a payload")
        found, self.held = self.held[:size], self.held[size:]
        return found


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _id(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(URN)
    return int(number) if number else None


def read_records(stream, archive: str) -> Iterator[tuple]:
    """Rows of CHUNKS for the records of an open archive."""
    source = _Bytes(stream)
    while (header := source.until(b"\r\n\r\n")) is not None:
        known = _fields(header)
        left = int(known["content-length"])
        kind = known["warc-type"]
        if kind in ("response", "revisit"):
            http = source.until(b"\r\n\r\n")
            left -= len(http)
            of = int(_fields(http).get("content-length", left))
            told = known["warc-payload-digest"].removeprefix("sha256:")
            common = (archive, _id(known["warc-record-id"]), kind, _id(known.get("warc-refers-to")), known.get("warc-target-uri"))
            if kind == "revisit":
                yield *common, 0, b"", of, told, True, True
            else:
                digest, number, size = hashlib.sha256(), 0, 0
                while True:
                    data = source.take(min(left, CHUNK))
                    left -= len(data)
                    size += len(data)
                    digest.update(data)
                    so_far = digest.copy().hexdigest()
                    yield *common, number, data, size, so_far, not left, left > 0 or (so_far == told and size == of)
                    number += 1
                    if not left:
                        break
        while left:
            left -= len(source.take(min(left, CHUNK)))
        source.take(4)


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunked record table of the archives in ``manifest``, a task for each archive.

    ``payload_bytes`` and ``payload_digest`` cover the payload up to and with the chunk; for
    a revisit, which has no payload of its own, they are those of the payload it stands for.
    ``intact`` is false where a whole payload does not match its header.
    """
    fields = [
        ("archive", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("url", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("is_last", pa.bool_()), ("intact", pa.bool_()),
    ]

    def read(found):
        def each():
            for (archive,) in rows(found):
                system, path = _open(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    yield from read_records(stream, archive)

        return batches(each(), pa.schema(fields), size=128)

    # the manifest is small, so adaptive execution would merge its partitions; an explicit number stays
    n = min(max(1, manifest.count()), READERS)
    return manifest.select("archive").coalesce(1).repartition(n).mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record: its last chunk has the size and digest of the whole payload."""
    return chunks.where("is_last").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and reads them back, a row a record.

    A null html is an empty payload, a null url has no target, a null page_id makes a record
    without a number that other records never refer to. Rows with the same page_id and
    payload count as the same page: if it is the smallest, each is a response. An empty table
    gives no rows; other columns are not read.
    """
    folder = qualified(pages.sparkSession, folder or shared_folder(pages.sparkSession, "archives"))
    return records(read_chunks(write_archives(chunk_rows(marked(pages)), folder)))
