"""Web archives of pages: WARC records, each compressed on its own with a dictionary of the archive.

A task buffers the first SAMPLE_BYTES of an archive's records, trains a Zstandard
dictionary from them and writes it in a skippable frame at the head of the file. Every
record follows as a frame of its own, so one can be read from its offset alone. Too
few records to train from serve as the dictionary themselves, as raw content.

Of records of equal payloads of LEAST bytes or more, that of the smallest page_id is a
response, the others are revisits that refer to it and hold no payload. Only digests
and ids are grouped. Pages go to their tasks with their html unless the table of
repeated digests is small enough to broadcast; hot digests are always broadcast.

Archives appear under their names when the job that wrote them is over, and only those
of tasks that ended; what a lost executor left goes. Files are written and read by
tasks, in any store that pyarrow.fs opens by its address (local, HDFS, S3, GCS).

Null html counts as empty. Rows that share the smallest id of their payload are all
responses: record ids are made of page ids, and these are expected to be unique. A null id
is never the smallest; where a payload has only null ids, all are responses. A null
url leaves the target out; control characters in one are percent-encoded. Empty
tables give no archive and no rows. Very long payloads are compressed and read in
pieces. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import folder as new_folder
from .common import join_by_key, ship, stored, tidy

#: Payloads below this many bytes are always kept whole.
LEAST = 100
DICTIONARY_BYTES = 64 << 10
#: Records that a dictionary is trained from, and the most of any one.
SAMPLE_BYTES = 2 << 20
SAMPLE_OF_ONE = 32 << 10
#: Bytes of records, before compression, after which a task begins a new archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

#: The frame that holds a dictionary, the first bytes of a Zstandard frame, and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 1 << 20
INDEX = "page_id long, record_type string, archive string, offset long, length long"


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    refers_to: int | None


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page: Page, date: str = DATE) -> tuple[bytes, bytes]:
    """A record's bytes up to its payload, and the payload, which a revisit leaves out."""
    revisit = page.refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.payload)}\r\n\r\n"
    body = b"" if revisit else page.payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page.page_id)), ("WARC-Date", date)]
    if page.url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", page.url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{page.digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(page.refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head) + len(body))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + head).encode(), body


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the samples; from too few, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One file. Records wait until the dictionary can be trained; index rows come when they are written."""

    def __init__(self, store: fs.FileSystem, path: str, name: str, level: int = LEVEL) -> None:
        self.file, self.name, self.level = store.open_output_stream(path, compression=None), name, level  # else the name would have it compressed as a whole
        self.waiting: list[tuple[Page, bytes, bytes]] = []
        self.held = self.seen = self.at = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, page: Page) -> list[tuple]:
        head, body = record(page)
        self.seen += len(head) + len(body) + 4
        if self.compressor:
            return [self._written(page, head, body)]
        self.waiting.append((page, head, body))
        self.held += min(len(head) + len(body), SAMPLE_OF_ONE)
        return self._begun() if self.held >= SAMPLE_BYTES or self.seen >= 4 * SAMPLE_BYTES else []

    def _begun(self) -> list[tuple]:
        known = dictionary([(head + body)[:SAMPLE_OF_ONE] for _, head, body in self.waiting])
        known.precompute_compress(level=self.level)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True)
        data = known.as_bytes()
        self.at = self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(data))) + self.file.write(data)
        out = [self._written(*w) for w in self.waiting]
        self.waiting = []
        return out

    def _written(self, page: Page, head: bytes, body: bytes) -> tuple:
        begin, size = self.at, len(head) + len(body) + 4
        if size <= CHUNK:
            self.at += self.file.write(self.compressor.compress(head + body + b"\r\n\r\n"))
        else:
            frame = self.compressor.compressobj(size)
            self.at += self.file.write(frame.compress(head))
            for i in range(0, len(body), CHUNK):
                self.at += self.file.write(frame.compress(body[i : i + CHUNK]))
            self.at += self.file.write(frame.compress(b"\r\n\r\n")) + self.file.write(frame.flush())
        return page.page_id, "response" if page.refers_to is None else "revisit", self.name, begin, self.at - begin

    def close(self) -> list[tuple]:
        out = [] if self.compressor else self._begun()
        self.file.close()
        return out


def _store(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address if "://" in address or address.startswith("file:") else f"file://{address}"))


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to of each page; refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = stored(groups.where("copies > 1"), "warc-repeated")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return join_by_key(rows, repeated, "digest", "copies", lambda t: t.select("digest", "first")).withColumn("refers_to", first).drop("first")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages in folder. Returns the written index: page_id, record_type, archive, offset and length of each record."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder.rstrip("/")
    run = uuid.uuid4().hex[:12]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        part, archive = TaskContext.get().partitionId(), None

        def index(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "record_type", "archive", "offset", "length"])

        number = 0
        for batch in batches:
            found: list[tuple] = []
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if archive and archive.seen >= archive_bytes:
                    found += archive.close()
                    archive = None
                if not archive:
                    name = f"pages-{run}-{part:05d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.zst"  # each attempt of a task has files of its own
                    store.create_dir(f"{root}/_written-{run}", recursive=True)
                    archive, number = Archive(store, f"{root}/_written-{run}/{name}", f"{folder}/{name}", level), number + 1
                found += archive.add(Page(page_id, url, payload, digest.hex(), refers_to))
            yield index(found)
        if archive:
            yield index(archive.close())

    table = typed(pages, id_col, url_col, html_col).select("page_id", "url", "payload", "digest", "refers_to")
    out = stored(table.mapInArrow(tidy(rows), INDEX), "warc-index")
    _publish(out.select("archive").distinct(), folder, run)
    return out


def _publish(archives: DataFrame, folder: str, run: str) -> None:
    """Move what ended tasks wrote to its name, then drop the rest. A repeated task finds its archives moved."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in (a.rpartition("/")[2] for a in batch.column(0).to_pylist()):
                old = f"{root}/_written-{run}/{name}"
                if store.get_file_info(old).type == fs.FileType.File:
                    store.move(old, f"{root}/{name}")
            yield batch

    stored(archives.mapInArrow(moved, "archive string"), "warc-moved")
    store, root = _store(folder)
    if store.get_file_info(f"{root}/_written-{run}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_written-{run}")


class Record(NamedTuple):
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes | None  # null if it wasn't asked for, or not there
    payload_bytes: int
    digest: str


def _fields(stream: io.BufferedIOBase) -> tuple[dict[str, str], int]:
    """Header lines up to an empty one, by lower-case name, and how many bytes they took."""
    out, size = {}, 0
    while line := stream.readline():
        size += len(line)
        if not line.strip():
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, size


def records(stream: io.BufferedIOBase, payloads: bool = True) -> Iterator[Record]:
    """The records of an archive's bytes, payloads read in pieces."""
    while line := stream.readline():
        if not line.strip():  # after a record
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields, _ = _fields(stream)
        left = int(fields["content-length"])
        http: dict[str, str] = {}
        if fields.get("content-type", "").startswith("application/http"):
            first = stream.readline()
            http, size = _fields(stream)
            left -= len(first) + size
        kept, total, digest = [], 0, hashlib.sha256()
        while left:
            piece = stream.read(min(left, CHUNK))
            if not piece:
                raise ValueError(f"archive ends within {fields.get('warc-record-id')}")
            left, total = left - len(piece), total + len(piece)
            digest.update(piece)
            if payloads:
                kept.append(piece)
        whole = fields.get("warc-type") != "revisit"
        yield Record(fields, http, b"".join(kept) if payloads and whole else None, total, digest.hexdigest())


def opened(file: BinaryIO, offset: int | None = None) -> io.BufferedReader:
    """The records of an archive, decompressed: all, or from the frame at offset. A dictionary at the head may be compressed itself."""
    head = file.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        data = file.read(struct.unpack("<II", head)[1])
        if data.startswith(ZSTD_MAGIC):
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        known = zstandard.ZstdCompressionDict(data)
    else:
        file.seek(0)
    if offset is not None:
        file.seek(offset)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    return io.BufferedReader(reader.stream_reader(file, read_across_frames=offset is None), CHUNK)


def record_at(archive: str, offset: int) -> Record:
    """One record, by its row of the index."""
    store, path = _store(archive)
    with store.open_input_file(path) as file:
        return next(records(opened(file, offset)))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in a folder, by their names alone."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.col("path").alias("archive"))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest and intact of every record of the archives in a column.

    A response's length and digest are those of the payload as read, and intact tells whether they are as stated; a
    revisit has no payload, and length and digest as its record states them.
    """
    ship(archives.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
        page = lambda name: int(m.group(1)) if name and (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)) else None
        found: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for address in batch.column(0).to_pylist():
                store, path = _store(address)
                with store.open_input_file(path) as file:
                    for r in records(opened(file), payloads):
                        kind, stated = r.fields.get("warc-type"), r.fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        length, digest = (r.payload_bytes, r.digest) if kind != "revisit" else (int(r.http.get("content-length", 0)), stated)
                        intact = digest == stated and length == int(r.http.get("content-length", length))
                        found.append((page(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"), kind, page(r.fields.get("warc-refers-to")), r.payload, length, digest, intact))
                        held += len(r.payload or b"")
                        if len(found) >= 5000 or held >= 4 * CHUNK:
                            yield made()
                            found, held = [], 0
        if found:
            yield made()

    names = stored(archives.select(F.col(archives.columns[0]).cast("string").alias("archive")), "warc-names")
    return names.repartition(max(1, min(names.count(), 10_000))).mapInArrow(tidy(rows), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, and read these back: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    index = write(pages, new_folder(pages.sparkSession, "warc"))
    return read(index.select("archive").distinct(), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's version of round_trip() over pages.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""
