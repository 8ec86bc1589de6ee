"""Polygon shape files (.shp with .shx and .dbf) in and out, by the published format.

A file is read in slices of its bytes: the driver looks at file sizes only, and a task takes the records that begin in its slices
from the index, so one large file spreads over many tasks and none is held whole. Small slices share a task, which opens the files and
reads the index once for all of them. Files are opened through ``pyarrow.fs``, so
a path may be local or a URI of a file system that Arrow knows.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phylomart.runtime import cut_lineage

# Fixed values of the format.
FILE_CODE, VERSION = 9994, 1000
NULL_SHAPE, POLYGON, POLYGON_Z, POLYGON_M = 0, 5, 15, 25
HEADER, INDEX_ROW = 100, 8
TEXT_BYTES = 254

# Bytes of a slice, bytes that a task takes where slices are smaller, points that a batch holds before it goes to the JVM, and size at
# which a written set ends.
SLICE_BYTES = 32 * 1024 * 1024
TASK_BYTES = 4 * 1024 * 1024
BATCH_POINTS = 500_000
FILE_BYTES = 64 * 1024 * 1024

ATTRIBUTES = ("binomial", "legend")
RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


class BadShapes(ValueError):
    """A file that does not keep to the format."""


class Slices(InputPartition):
    """Neighbouring slices of one file: its bytes from ``first`` up to ``last``."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ShapeSource(DataSource):
    """Spark format ``polygon_shapes``; options ``path``, ``attributes`` (comma-separated), ``slice_bytes``, ``task_bytes`` (a slice's by default) and
    ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "polygon_shapes"

    def schema(self) -> str:
        texts = [f"`{a}` string" for a in _names(self.options)]
        return ", ".join([*texts, "rings array<array<struct<x:double,y:double>>>"])

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(dict(self.options))


def _names(options) -> list[str]:
    return [a.strip() for a in options.get("attributes", ",".join(ATTRIBUTES)).split(",") if a.strip()]


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.names = _names(options)
        self.slice_bytes = int(options.get("slice_bytes", SLICE_BYTES))
        self.task_bytes = int(options.get("task_bytes", self.slice_bytes))
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> Sequence[InputPartition]:
        files, base = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(base)
        if found.type == fs.FileType.Directory:
            listed = files.get_file_info(fs.FileSelector(base, recursive=True))
            shapes = [f for f in listed if f.is_file and f.path.lower().endswith(".shp") and not posixpath.basename(f.path).startswith(("_", "."))]
        elif found.type == fs.FileType.File:
            shapes = [found]
        else:
            raise FileNotFoundError(self.path)
        step = max(self.task_bytes // self.slice_bytes, 1) * self.slice_bytes
        return [Slices(f.path, at, at + step) for f in sorted(shapes, key=lambda f: f.path) for at in range(0, f.size, step)]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        stem, letters = partition.path[:-4], partition.path[-4:]
        # the three files of a set carry the letter case of the first
        index_end, table_end = (".SHX", ".DBF") if letters.isupper() else (".shx", ".dbf")
        with files.open_input_file(stem + index_end) as index:
            index.seek(HEADER)
            words = np.frombuffer(index.read(), dtype=">i4").astype(np.int64)
        if words.size % 2:
            raise BadShapes(f"{stem}{index_end}: index ends inside a record")
        offsets, lengths = words[0::2] * 2, words[1::2] * 2
        mine = np.flatnonzero((offsets >= partition.first) & (offsets < partition.last))
        if not mine.size:
            return
        # records by the slice in which they begin, in the order of the index
        place = (offsets[mine] - partition.first) // self.slice_bytes
        order = np.argsort(place, kind="stable")
        slices = np.split(mine[order], np.flatnonzero(np.diff(place[order])) + 1)
        with files.open_input_file(partition.path) as shapes, files.open_input_file(stem + table_end) as table:
            text = _Attributes(table, self.names, self.encoding, f"{stem}{table_end}")
            for records in slices:
                held: list[list[np.ndarray] | None] = []
                rows: list[list] = []
                points = 0
                for i in records:
                    shapes.seek(int(offsets[i]) + 8)
                    content = shapes.read(int(lengths[i]))
                    if len(content) < lengths[i]:
                        raise BadShapes(f"{partition.path}: record {i + 1} ends early")
                    held.append(_rings(content, f"{partition.path}: record {i + 1}"))
                    rows.append(text.row(int(i)))
                    points += len(content) // 16
                    if points >= BATCH_POINTS:
                        yield _batch(self.names, rows, held)
                        held, rows, points = [], [], 0
                if rows:
                    yield _batch(self.names, rows, held)


class _Attributes:
    """Rows of an attribute table by number; blank values are null."""

    def __init__(self, file, names: Sequence[str], encoding: str, label: str):
        head = file.read(32)
        if len(head) < 32:
            raise BadShapes(f"{label}: no header")
        self.rows, self.start, self.width = struct.unpack("<IHH", head[4:12])
        self.file, self.encoding, self.label = file, encoding, label
        fields: dict[str, tuple[int, int]] = {}
        at = 1  # after the deletion mark
        described = file.read(self.start - 32)
        for k in range(0, len(described) - 31, 32):
            if described[k] == 0x0D:
                break
            name = described[k : k + 11].split(b"\0")[0].decode("ascii", "replace").strip().lower()
            fields.setdefault(name, (at, at + described[k + 16]))
            at += described[k + 16]
        missing = [n for n in names if n.lower() not in fields]
        if missing:
            raise BadShapes(f"{label}: no attribute {missing}, found {sorted(fields)}")
        self.spans = [fields[n.lower()] for n in names]

    def row(self, i: int) -> list[str | None]:
        if i >= self.rows:
            raise BadShapes(f"{self.label}: no row for record {i + 1}")
        self.file.seek(self.start + i * self.width)
        raw = self.file.read(self.width)
        return [raw[a:b].strip(b" \0").decode(self.encoding, "replace") or None for a, b in self.spans]


def _rings(content: bytes, label: str) -> list[np.ndarray] | None:
    """Points of each part of a polygon; none for a null shape. Heights and measures are left out."""
    kind = struct.unpack_from("<i", content)[0] if len(content) >= 4 else None
    if kind == NULL_SHAPE:
        return None
    if kind not in (POLYGON, POLYGON_Z, POLYGON_M):
        raise BadShapes(f"{label} is of type {kind}, not a polygon")
    if len(content) < 44:
        raise BadShapes(f"{label} is too short")
    parts, points = struct.unpack_from("<ii", content, 36)
    if parts < 0 or points < 0 or len(content) < 44 + 4 * parts + 16 * points:
        raise BadShapes(f"{label} is too short for its {parts} parts and {points} points")
    starts = np.frombuffer(content, "<i4", parts, 44)
    places = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    ends = np.append(starts[1:], points) if parts else starts
    if parts and (starts[0] < 0 or np.any(ends < starts)):
        raise BadShapes(f"{label} has parts out of order")
    return [places[a:b] for a, b in zip(starts, ends)]


def _batch(names: Sequence[str], rows: list[list], shapes: list[list[np.ndarray] | None]) -> pa.RecordBatch:
    rings = [r for shape in shapes if shape is not None for r in shape]
    places = np.concatenate(rings) if rings else np.empty((0, 2))
    flat = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["x", "y"])
    parts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), flat)
    # a null start marks a null list
    bounds = np.cumsum([0, *[len(s or []) for s in shapes]]).tolist()
    starts = [None if s is None else b for s, b in zip(shapes, bounds)] + [bounds[-1]]
    whole = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), parts).cast(RINGS)
    texts = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([*texts, whole], [*names, "rings"])


def read_shapes(
    spark: SparkSession, path: str, attributes: Sequence[str] = ATTRIBUTES, encoding: str = "utf-8", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Polygons of a shape file, or of all in a folder: the text ``attributes`` (found in any letter case) and ``rings``.

    Null shapes have null rings, blank attributes are null, numbers come as their text. Records marked deleted count, as they keep
    their shape. Files with other shapes, or shorter than they say, end the job with their name and the record's number.
    A task takes as many slices of ``slice_bytes`` as 4 MB hold, one at least.
    """
    spark.dataSource.register(ShapeSource)
    options = {"attributes": ",".join(attributes), "encoding": encoding, "slice_bytes": str(slice_bytes), "task_bytes": str(TASK_BYTES)}
    return spark.read.format(ShapeSource.name()).options(**options).load(path)


def write_shapes(df: DataFrame, path: str, attributes: Sequence[str] = ATTRIBUTES, file_bytes: int = FILE_BYTES) -> None:
    """Write text ``attributes`` and ``rings`` as sets of files of about ``file_bytes`` in the folder ``path``, one or more a task.

    A set is written under a hidden name and then moved, so that a lost attempt leaves nothing that is read. Null rings become null
    shapes. The format has no null points and ends a text at 254 bytes: either ends the job. Null and blank texts are the same.
    """
    texts = list(attributes)
    clash = [n for n in texts if len(n.encode()) > 10]
    if clash:
        raise ValueError(f"attribute names of over 10 bytes: {clash}")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        stem = f"part-{context.partitionId():06d}"
        made, out = 0, None
        for batch in batches:
            columns = [batch.column(t).to_pylist() for t in texts]
            for row, rings in zip(zip(*columns), _places(batch.column("rings"))):
                if out is None:
                    out = _Writer(files, base, f"{stem}-{made:03d}", f"_{context.taskAttemptId()}-{stem}-{made:03d}", texts)
                out.add(row, rings)
                if out.held >= file_bytes:
                    out.close()
                    made, out = made + 1, None
        if out is not None:
            out.close()
            made += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    # written first: attempts of one task then see the same rows
    stored = cut_lineage(df.select(*[F.col(t).cast("string").alias(t) for t in texts], "rings"))
    stored.mapInArrow(save, "files long").agg(F.sum("files")).collect()


def _places(column: pa.ListArray) -> Iterator[list[np.ndarray] | None]:
    """Points of each ring of each row; null rings are left out, null points and coordinates are NaN."""
    rings = column.values
    points = rings.values
    flat = np.stack([points.field(c).to_numpy(zero_copy_only=False).astype("<f8") for c in "xy"], axis=1)
    if points.null_count:
        flat[points.is_null().to_numpy(zero_copy_only=False)] = np.nan
    outer, inner = column.offsets.to_numpy(), rings.offsets.to_numpy()
    whole, present = column.is_valid().to_pylist(), rings.is_valid().to_numpy(zero_copy_only=False)
    for i, there in enumerate(whole):
        yield [flat[inner[k] : inner[k + 1]] for k in range(outer[i], outer[i + 1]) if present[k]] if there else None


class _Writer:
    """One set of files, kept until it ends, as the headers hold counts and bounds."""

    def __init__(self, files: fs.FileSystem, base: str, stem: str, hidden: str, names: Sequence[str]):
        self.files, self.names = files, names
        self.hidden, self.stem = f"{base}/{hidden}", f"{base}/{stem}"
        self.width = 1 + TEXT_BYTES * len(names)
        self.at = HEADER
        self.body, self.index, self.rows = [], [], []
        self.box = [np.inf, np.inf, -np.inf, -np.inf]

    @property
    def held(self) -> int:
        return self.at + self.width * len(self.rows)

    def add(self, texts: Sequence[str | None], rings: list[np.ndarray] | None) -> None:
        raw = [(t or "").encode("utf-8") for t in texts]
        long = [n for n, t in zip(self.names, raw) if len(t) > TEXT_BYTES]
        if long:
            raise ValueError(f"{long}: text of over {TEXT_BYTES} bytes")
        content = struct.pack("<i", NULL_SHAPE)
        if rings is not None:
            flat = np.concatenate(rings) if rings else np.empty((0, 2))
            if np.isnan(flat).any():
                raise ValueError(f"polygon of {texts} has a point without a coordinate")
            box = [*flat.min(axis=0), *flat.max(axis=0)] if len(flat) else [0.0] * 4
            if len(flat):
                self.box = [*np.minimum(self.box[:2], box[:2]), *np.maximum(self.box[2:], box[2:])]
            starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
            content = struct.pack("<i4dii", POLYGON, *box, len(rings), len(flat)) + starts.tobytes() + flat.tobytes()
        self.index.append(struct.pack(">ii", self.at // 2, len(content) // 2))
        self.body.append(struct.pack(">ii", len(self.index), len(content) // 2) + content)
        self.rows.append(raw)
        self.at += 8 + len(content)

    def close(self) -> None:
        box = self.box if self.box[0] <= self.box[2] else [0.0] * 4

        def header(size: int) -> bytes:
            return struct.pack(">i5ii", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", VERSION, POLYGON, *box, 0, 0, 0, 0)

        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(self.rows), 33 + 32 * len(self.names), self.width)
        fields = [struct.pack("<11sc4xBB14x", n.encode(), b"C", TEXT_BYTES, 0) for n in self.names]
        table = (b" " + b"".join(t.ljust(TEXT_BYTES) for t in row) for row in self.rows)
        parts = {
            "shx": [header(HEADER + INDEX_ROW * len(self.index)), *self.index],
            "dbf": chain([head, *fields, b"\r"], table, [b"\x1a"]),
            "cpg": [b"UTF-8"],
            "shp": [header(self.at), *self.body],
        }
        for end, pieces in parts.items():
            with self.files.open_output_stream(f"{self.hidden}.{end}") as out:
                for piece in pieces:
                    out.write(piece)
        # the polygons come last: a set is found by them
        for end in parts:
            self.files.move(f"{self.hidden}.{end}", f"{self.stem}.{end}")
