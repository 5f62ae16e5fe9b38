"""WARC records in ZIP archives: a writer, and a reader that needs no extraction.

An archive holds stored (uncompressed) members: data members `archive/data-000.warc.gz` and so on, one gzip
member per WARC record, and `indexes/index.cdxj`, one line per record with its member and place. The reader
parses the end of the file, the ZIP64 records if there are any, and the central directory, reads
every index below `indexes/`, packed or not, whatever member its lines name, and range-reads records straight out
of the archive. Records that lie side by side are dealt to tasks in chunks; the number of tasks follows
from the bytes of the chunks, so one large archive is read by many tasks.

Archives go to a folder that all executors share, under a name of their own for every attempt; the
written manifest names those of the attempts that count, so a lost executor leaves at most an unread
file. Data rolls over to a new member at `MEMBER_BYTES` and to a new archive at `ROLL_BYTES`.

Of records with equal payloads of at least `REVISIT_BYTES` the one with the smallest id is a response
and the others are revisits of it; a revisit carries digest and length of the full payload.

Defined results: a null payload is empty; a null URL is an empty one; URLs come back as they are, one
with control characters is written quoted and marked so; a null id is read back as null
and is never the response of a payload that some id also has (payloads that only null ids have are all
responses); rows that repeat the smallest id are all responses; an empty table gives no archive and an
empty result; only the three named columns are read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferbatch.llm.sizes import BROADCAST_BYTES
from inferbatch.session import materialize, scratch_path

DATA_MEMBER = "archive/data-{:03d}.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
INDEXES = re.compile(r"indexes/.*\.cdxj?(\.gz)?")
DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
MEMBER_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
# Bytes of records that one task reads.
TASK_BYTES = 32 << 20
INDEX_PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_LEVEL = 4


class FormatError(ValueError):
    """An archive or record that does not follow its format."""


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names of one store are its own name."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def with_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", most: int = BROADCAST_BYTES
) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses). Repeated payloads are sent to
    every task up to `most` bytes."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.filter((F.octet_length("payload") >= REVISIT_BYTES))
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "firsts")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    if firsts.count() * 96 <= most:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
        return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))
    # Too many to send around: repeated payloads meet as ids and digests, and each page meets its own verdict.
    verdicts = rows.select("page_id", "digest").join(firsts, "digest").filter(other).distinct()
    verdicts = verdicts.select(F.col("page_id").alias("v_id"), F.col("digest").alias("v_digest"), "first_id")
    same = F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("digest") == F.col("v_digest"))
    joined = rows.join(verdicts, same, "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "unknown:" + uuid.uuid5(uuid.NAMESPACE_URL, url + digest).hex if page_id is None else f"page:{page_id}"
    quoted = bool(HIDDEN.search(url))
    head = [
        "WARC/1.1",
        "WARC-Type: response" if refers_to is None else "WARC-Type: revisit",
        f"WARC-Record-ID: <urn:{name}>",
        f"WARC-Target-URI: {quote(url, safe=SAFE) if quoted else url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if quoted:
        head.append("X-Target-URI-Quoted: true")
    if refers_to is not None:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "!#$&'()*+,/:;=?@[]-._~"
# What a header line cannot hold, or would lose at its ends.
HIDDEN = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]|^ | $")


def parse_record(data: bytes) -> dict:
    """The fields of one WARC record; `payload` is null for a revisit."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise FormatError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length:
        raise FormatError("a WARC record is cut short")
    kind, url = fields["WARC-Type"], fields.get("WARC-Target-URI", "")
    name = re.fullmatch(r"<urn:page:(-?\d+)>", fields["WARC-Record-ID"])
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return {
        "page_id": int(name[1]) if name else None,
        "url": unquote(url) if fields.get("X-Target-URI-Quoted") == "true" else url,
        "record_type": kind,
        "refers_to": int(refers[1]) if refers else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_length": int(fields["WARC-Payload-Length"]),
        "payload": block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
    }


class _Archive:
    """One archive being written: records first, then their index."""

    def __init__(self, folder: str, member_bytes: int):
        store, base = filesystem(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store.create_dir(base, recursive=True)
        self.stream = store.open_output_stream(f"{base}/{self.path.rsplit('/', 1)[1]}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member_bytes, self.members, self.data = member_bytes, 0, None
        self.index, self.size = [], 0

    def add(self, url: str, digest: str, data: bytes) -> None:
        packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        if self.data is not None and self.at >= self.member_bytes:
            self.data.close()
            self.data = None
        if self.data is None:
            self.member, self.at = DATA_MEMBER.format(self.members), 0
            self.data = self.zip.open(zipfile.ZipInfo(self.member), "w", force_zip64=True)
            self.members += 1
        place = {"filename": self.member, "offset": self.at, "length": len(packed), "digest": f"sha256:{digest}"}
        self.index.append(f"{quote(url, safe=SAFE)} {DATE[:19].translate(DIGITS_ONLY)} {json.dumps(place)}\n")
        self.data.write(packed)
        self.at += len(packed)
        self.size += len(packed)

    def close(self) -> str:
        if self.data is not None:
            self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.path


DIGITS_ONLY = str.maketrans("", "", "-:T")


def write_archives(
    rows: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, member_bytes: int = MEMBER_BYTES
) -> DataFrame:
    """Write rows of `with_revisits` to archives below a shared folder; their paths, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive.close()])], names=["path"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder, member_bytes)
                archive.add(url, digest, record(page_id, url, payload, digest, refers_to))
                if archive.size >= roll_bytes:
                    yield closed()
                    archive = None
        if archive:
            yield closed()

    columns = ["page_id", "url", "payload", "digest", "refers_to"]
    return materialize(rows.select(*columns).mapInArrow(run, "path string"), "manifest")


def directory(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Members of a ZIP file: name to (offset of the data, size). Reads the directories only."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise FormatError("no end of a central directory")
    count, cd_size, cd_at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or cd_size == 0xFFFFFFFF or cd_at == 0xFFFFFFFF or file.read_at(4, max(0, tail_at + end - 20)) == b"PK\x06\x07":
        locator = file.read_at(20, max(0, tail_at + end - 20))
        if locator[:4] != b"PK\x06\x07":
            raise FormatError("no ZIP64 locator")
        record_at = struct.unpack_from("<Q", locator, 8)[0]
        end64 = file.read_at(56, record_at)
        if end64[:4] != b"PK\x06\x06":
            raise FormatError("no ZIP64 end of a central directory")
        count, cd_size, cd_at = struct.unpack_from("<QQQ", end64, 32)
    entries, at, members = file.read_at(cd_size, cd_at), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise FormatError("a broken central directory")
        method, packed, whole = struct.unpack_from("<H8xII", entries, at + 10)[0:3]
        name_len, extra_len, comment_len = struct.unpack_from("<HHH", entries, at + 28)
        header_at = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + name_len].decode()
        extra = entries[at + 46 + name_len : at + 46 + name_len + extra_len]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                # 64-bit values stand here for those fields only that are full in the entry.
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + length :]
        if method or packed != whole:
            raise FormatError(f"{name} is not a stored member")
        local = file.read_at(30, header_at)
        if local[:4] != b"PK\x03\x04":
            raise FormatError("a broken local header")
        members[name] = (header_at + 30 + sum(struct.unpack_from("<HH", local, 26)), whole)
        at += 46 + name_len + extra_len + comment_len
    return members


def index_lines(file: pa.NativeFile, at: int, size: int, packed: bool) -> Iterator[str]:
    """The lines of an index member, read in pieces and unpacked on the way if it is packed."""
    unpacker, rest = zlib.decompressobj(31), b""
    for start in range(at, at + size, INDEX_PIECE):
        piece = file.read_at(min(INDEX_PIECE, at + size - start), start)
        if packed:
            piece, data = b"", piece
            while data:
                piece += unpacker.decompress(data)
                data = unpacker.unused_data
                if unpacker.eof:
                    unpacker = zlib.decompressobj(31)
        *lines, rest = (rest + piece).split(b"\n")
        yield from (line.decode() for line in lines if line)
    if rest:
        yield rest.decode()


def places(file: pa.NativeFile, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Records side by side in an archive, by its indexes: offset of the first, and their lengths."""
    members = directory(file)
    starts, sizes = [], []
    for name, (index_at, index_size) in members.items():
        if not INDEXES.fullmatch(name):
            continue
        for line in index_lines(file, index_at, index_size, name.endswith(".gz")):
            json_at = line.find("{")
            if json_at < 0 or line.startswith("!"):
                # Header lines of an index.
                continue
            place = json.loads(line[json_at:])
            data = members.get(place["filename"]) or members.get(f"archive/{place['filename']}")
            if data is None:
                raise FormatError(f"an index names {place['filename']}, which the archive does not hold")
            at, length = int(place["offset"]), int(place["length"])
            if at + length > data[1]:
                raise FormatError(f"a record reaches beyond the end of {place['filename']}")
            starts.append(data[0] + at)
            sizes.append(length)
    # Indexes are in the order of their keys; records are read in the order of the file.
    order = np.argsort(np.array(starts, np.int64), kind="stable").tolist()
    start, lengths, end = None, [], None
    for k in order:
        at, length = starts[k], sizes[k]
        if start is not None and (at != end or end - start >= chunk_bytes):
            yield start, lengths
            start, lengths = None, []
        start = at if start is None else start
        lengths.append(length)
        end = at + length
    if start is not None:
        yield start, lengths


RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_length bigint, payload binary"
)


def read_records(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every record of the archives named in the column `path`."""
    arrow = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())]
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    found = list(places(file, chunk_bytes))
                columns = [pa.array([path] * len(found)), pa.array([s for s, _ in found], pa.int64()),
                           pa.array([n for _, n in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = filesystem(path)
                with store.open_input_file(name) as file:
                    data = file.read_at(sum(lengths), start)
                rows, at = [], 0
                for length in lengths:
                    rows.append(parse_record(zlib.decompress(data[at : at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_pylist(rows, arrow)

    # A task per archive up to the cores there are, then tasks by the bytes of the chunks. The numbers are
    # given, as rows this small would otherwise be put together into one task.
    cores = paths.sparkSession.sparkContext.defaultParallelism
    listed = paths.select("path").repartition(max(1, min(paths.count(), cores)), "path")
    chunks = materialize(listed.mapInArrow(locate, "path string, start bigint, lengths array<bigint>"), "chunks")
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)
    found = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(found["n"], cores), -(-found["bytes"] // TASK_BYTES))
    return chunks.repartition(tasks, "path", "start").mapInArrow(read, RECORD_SCHEMA)


def round_trip(
    spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back."""
    rows = with_revisits(pages, id_col, url_col, payload_col)
    return read_records(write_archives(rows, scratch_path(spark, "wacz")))
