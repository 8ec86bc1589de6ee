"""WARC: archives from pages, and a normaliser that gives every record its own gzip member and an offset index."""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylomart.runtime import cut_lineage, shared_dir

ROLL_BYTES = 64 << 20  # payload of one archive, before compression
READ_BYTES = 1 << 20
LEVEL = 3
MOST_TASKS = 10_000  # tasks over archive files; with more files, a task takes several in turn
LEAST_BYTES = 0  # smaller payloads are never revisits
DATE = "2020-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip header


def bare_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value in one line."""
    return " ".join(value.splitlines())


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit of page ``first``; a revisit keeps the HTTP header, which tells the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    header = [
        "WARC/1.1",
        f"WARC-Type: {RESPONSE if first is None else REVISIT}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {_clean(url)}")
    if first is not None:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A parsed record: header fields with lower-case names, and the block."""

    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def number(self, name: str) -> int | None:
        digits = self.headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None


def parse_record(stream: io.BufferedIOBase) -> tuple[Record, bytes] | None:
    """The next record and its bytes, or None at the end; a record cut short raises."""
    raw = bytearray()
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:20]!r}")
    raw += line
    headers: dict[str, str] = {}
    while (line := stream.readline()).strip():
        raw += line
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    raw += line
    size = int(headers["content-length"])
    block = stream.read(size)
    if len(block) < size:
        raise ValueError("a WARC record ends early")
    return Record(headers, block), bytes(raw) + block + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """What a gzip file of one or more members holds, read once and in pieces."""

    def __init__(self, source):
        self.source, self.inflater, self.left = source, zlib.decompressobj(GZIP), b""
        self.ended = False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ended:
            if not self.left:
                self.left = self.source.read(READ_BYTES)
            if not self.left:
                if not self.inflater.eof:
                    raise EOFError("a gzip stream ends early")
                break
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(GZIP)
            out = self.inflater.decompress(self.left, len(buffer))
            self.left = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)
        self.ended = True
        return 0


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder all executors reach, local or remote, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Sink:
    """A file that appears under its name only when it is whole.

    Every attempt of a task writes to a name of its own, so attempts that are lost or repeated harm nothing.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.path = f"{base}/{name}", f"{base}/{name}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.path, compression=None)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.path, self.final)


def mark_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and ``first``, the page to refer to, or null for a response.

    Only payloads that several rows share are joined back, one row for each. Null ids come last and are never referred to;
    rows that repeat the smallest id of a payload are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    shared = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = keyed.join(cut_lineage(shared.select("sha", "first")), "sha", "left")
    again = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return joined.withColumn("first", F.when(again & (F.octet_length("payload") >= least_bytes), F.col("first")))


def write_archives(marked: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 1) -> DataFrame:
    """Write records as archives that are one gzip stream each; returns the table (path, n_records) of the files.

    A task begins a new file when ``roll_bytes`` of payload are in the current one, so a file never grows with the input.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        sink = deflater = None
        size = n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, deflater, size, n = Sink(folder, name), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                    done.append((f"{folder}/{name}", 0))
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                sink.stream.write(deflater.compress(build_record(row["page_id"], row["url"], row["payload"], digest, row["first"])))
                size, n = size + len(row["payload"]), n + 1
                done[-1] = (done[-1][0], n)
                if size >= roll_bytes:
                    sink.stream.write(deflater.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.stream.write(deflater.flush())
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    # the table names the files of the attempts that counted
    return cut_lineage(marked.select("page_id", "url", "payload", "sha", "first").mapInArrow(write, "path string, n_records long"))


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite gzip WARC files, given by ``path``, with one member per record; returns (path, index, n_records).

    Every file is inflated once, from its beginning, in pieces; memory is bounded by the largest record. ``index`` is the
    sidecar, a tab-separated line of offset, length, type and id per member. Files that are in members already come out alike.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_normalise_file(path, folder, level) for path in batch.column("path").to_pylist()]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "index", "n_records"])

    return cut_lineage(one_a_task(files.select("path")).mapInArrow(rewrite, "path string, index string, n_records long"))


def one_a_task(files: DataFrame) -> DataFrame:
    """A table of files dealt out one to a task. Its rows are tiny, so without a stated number the adaptive
    planner would put all files in one task."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)))


def _normalise_file(path: str, folder: str, level: int) -> tuple[str, str, int]:
    fs, source = open_fs(path)
    name = f"{uuid.uuid4().hex}.warc.gz"
    records, index = Sink(folder, name), Sink(folder, f"{name}.idx")
    offset = n = 0
    with fs.open_input_stream(source, compression=None) as stream, io.BufferedReader(Inflated(stream), READ_BYTES) as inflated:
        while (found := parse_record(inflated)) is not None:
            record, raw = found
            deflater = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            member = deflater.compress(raw) + deflater.flush()
            records.stream.write(member)
            index.stream.write(f"{offset}\t{len(member)}\t{record.kind}\t{record.headers.get('warc-record-id', '')}\n".encode())
            offset, n = offset + len(member), n + 1
    records.close()
    index.close()
    return f"{folder}/{name}", f"{folder}/{name}.idx", n


def read_index(index: str) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, type, id) of each member, from the sidecar."""
    fs, path = open_fs(index)
    with fs.open_input_stream(path, compression=None) as stream, io.BufferedReader(stream, READ_BYTES) as lines:
        for line in lines:
            offset, length, kind, name = line.decode().rstrip("\n").split("\t")
            yield int(offset), int(length), kind, name


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each inflated on its own at
    the offset its index names. A response whose payload does not have the digest in its header raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fs, place = open_fs(path)
                out = []
                with fs.open_input_file(place) as file:
                    for offset, length, _, _ in read_index(index):
                        file.seek(offset)
                        out.append(_told(zlib.decompress(file.read(length), GZIP)))
                yield pa.RecordBatch.from_pylist(out, schema=TOLD)

    return one_a_task(files.select("path", "index")).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


TOLD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _told(member: bytes) -> dict:
    record, _ = parse_record(io.BytesIO(member))
    http, _, payload = record.block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = record.headers["warc-payload-digest"].removeprefix("sha1:")
    if record.kind == RESPONSE and (len(payload), bare_digest(payload)) != (length, digest):
        raise ValueError(f"the payload of {record.headers['warc-record-id']} does not have its digest")
    return {
        "page_id": record.number("warc-record-id"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": record.kind,
        "refers_to": record.number("warc-refers-to"),
    }


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder, normalise them and read them back.

    Null html is an empty payload; a null id is written as an empty number and comes back null; an empty table
    writes no file. Extra columns are not archived.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(mark_revisits(pages, least_bytes), f"{folder}/streams")
    return read_archives(normalise(written, f"{folder}/members"))
