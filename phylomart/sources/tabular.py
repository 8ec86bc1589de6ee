"""Delimited text in and out."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from phylomart.runtime import cut_lineage
from phylomart.schemas import RANGE_SCHEMA
from phylomart.sources.shapes import read_shapes

# The columns of a per-species occurrence file.
SPECIES_CSV_COLUMNS = ("gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude")
# Folders that a task lists and files that it reads; a larger file is read in slices.
FILES_A_TASK = 4096
SLICE_BYTES = 16 * 1024 * 1024
# What Spark's reader trims before it drops a blank line.
BLANK = bytes(range(33))


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated text keyed by its header row; quotes are plain characters.

    Plain and gzip files, LF and CRLF line ends; short rows are padded with nulls. Columns are taken
    by header name, so a schema may list a subset in any order. Pass a schema for anything large:
    without one all columns are text.
    """
    reader = spark.read.options(sep="\t", header=True, quote="", enforceSchema=False, mode="PERMISSIVE")
    if schema is None:
        return reader.csv(path)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = reader.csv(path).columns  # header line only
    text = StructType()
    for name in found:
        text = text.add(name, StringType())
    rows = reader.schema(text).csv(path)
    return rows.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in found else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
    )


def read_csv_quoted(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Quoted CSV with doubled quotes and line breaks inside fields.

    Such a file is read by one task, so the rows are dealt out before any later work.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True)
    rows = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return rows.hint("rebalance")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and tab rows, one file per partition, no quoting."""
    plain = {"quote": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(sep="\t", header=True, **plain).csv(path)


def write_species_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder of CSV per species, named by the species with ``_`` for spaces.

    Species already present are skipped, or replaced with ``overwrite``. The rebalance hint groups a
    species' rows into few files and lets AQE split a species too large for one task. New species are written by the tasks
    themselves, a file under a hidden name that is then moved, so no driver moves a file per species and a lost attempt
    leaves nothing that is read. Replaced ones, and stores that Arrow cannot open, go through Spark's writer.
    """
    rows = df.select(F.translate("taxon_name", " ", "_").alias("species"), *SPECIES_CSV_COLUMNS)
    mode = "overwrite"
    if not overwrite:
        written = written_species(df.sparkSession, path)
        if written is not None:
            rows = rows.join(written, "species", "left_anti")
        mode = "append"
        if _opened(path) is not None:
            return _write_new_species(rows, path)
    (
        rows.hint("rebalance", "species")
        .write.mode(mode)
        .option("header", True)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("species")
        .csv(path)
    )


def _opened(path: str) -> tuple[fs.FileSystem, str] | None:
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _write_new_species(rows: DataFrame, path: str) -> None:
    run = uuid.uuid4().hex

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name, made = f"part-{task.partitionId():05d}-{run}.csv", 0
        lines = ((s, t) for batch in batches for s, t in zip(batch.column("species").to_pylist(), batch.column("line").to_pylist()))
        # null and empty names come one after the other and share a folder
        for name_of, own in groupby(lines, lambda row: species_folder(row[0])):
            folder = f"{base}/{name_of}"
            files.create_dir(folder)
            hidden = f"{folder}/_{task.taskAttemptId()}-{name}"
            with files.open_output_stream(hidden) as out:
                out.write(",".join(SPECIES_CSV_COLUMNS).encode() + b"\n")
                for _, line in own:
                    out.write(line.encode() + b"\n")
            files.move(hidden, f"{folder}/{name}")
            made += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    lines = rows.select("species", F.to_csv(F.struct(*SPECIES_CSV_COLUMNS)).alias("line"))
    # written first: attempts of one task then see the same rows; sorted, so that a task has one file open
    stored = cut_lineage(lines)
    stored.hint("rebalance", "species").sortWithinPartitions("species").mapInArrow(save, "files long").agg(F.sum("files")).collect()


def species_folder(species: str | None) -> str:
    """The folder of a species, escaped as Spark escapes partition values."""
    if not species:
        return "species=__HIVE_DEFAULT_PARTITION__"
    return "species=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", species)


def unescaped(name: str) -> str:
    """A folder's value without Spark's escapes, see :func:`species_folder`."""
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda c: chr(int(c[1], 16)), name)


def _entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether a folder, and bytes of what lies in ``folder``, one at a time where the store allows."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                within = entry.is_dir()
                yield entry.name, within, 0 if within else entry.stat().st_size
    else:
        for info in files.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _batches(rows: Iterator[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], list(names))


def _species_files(spark: SparkSession, path: str) -> DataFrame:
    """(species, file, bytes) of the files in the species folders under ``path``, listed by tasks of some thousand folders."""

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            files, base = fs.FileSystem.from_uri(path)
            found = ((name,) for name, within, _ in _entries(files, base) if within and name.startswith("species="))
            yield from _batches(found, ("folder",), (pa.string(),))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        found = (
            (unescaped(folder.removeprefix("species=")), f"{folder}/{name}", size)
            for batch in batches
            for folder in batch.column("folder").to_pylist()
            for name, within, size in _entries(files, f"{base}/{folder}")
            if not within and name.endswith(".csv") and name[0] not in "._"
        )
        yield from _batches(found, ("species", "file", "bytes"), (pa.string(), pa.string(), pa.int64()))

    # one folder is listed by one task, so the names alone come from there
    names = cut_lineage(spark.range(1, numPartitions=1).mapInArrow(folders, "folder string"))
    return cut_lineage(names.repartition(-(-names.count() // FILES_A_TASK) or 1).mapInArrow(listed, "species string, file string, bytes long"))


def written_species(spark: SparkSession, path: str) -> DataFrame | None:
    """Species with a written file, read from the folder names without opening the files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    if _opened(path) is not None:
        return _species_files(spark, path).select("species").distinct()
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    name = F.regexp_extract("path", r"/species=([^/]+)/", 1)
    return listing.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("species")).distinct()


def read_species_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of :func:`write_species_csv` with their ``species``, as Spark's reader gives them.

    That reader keeps each file on the driver and takes four small ones a task. Here tasks list the folders and a task reads thousands of files, a
    large one in slices. Stores that Arrow cannot open go through Spark's reader.
    """
    if _opened(path) is None:
        return spark.read.schema(f"{schema}, species string").option("header", True).csv(path)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        found = (
            (None if species == "__HIVE_DEFAULT_PARTITION__" else species, line)
            for batch in batches
            for species, file, at in zip(*[batch.column(c).to_pylist() for c in ("species", "file", "at")])
            for line in _lines_from(files, f"{base}/{file}", at)
        )
        yield from _batches(found, ("species", "line"), (pa.string(), pa.string()))

    found = _species_files(spark, path)
    sizes = found.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    tasks = max(1, -(-sizes["n"] // FILES_A_TASK), -(-(sizes["b"] or 0) // SLICE_BYTES))
    slices = found.filter("bytes > 0").select("species", "file", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(SLICE_BYTES))).alias("at"))
    texts = slices.repartition(tasks).mapInArrow(lines, "species string, line string")
    # a generator, so that a line is parsed once and not for each column
    return texts.select("species", F.inline(F.array(F.from_csv("line", schema)))).select(*StructType.fromDDL(schema).names, "species")


def _lines_from(files: fs.FileSystem, file: str, at: int) -> Iterator[str]:
    """The lines of a file that begin in the slice from ``at`` on, without the header and blank ones."""
    with files.open_input_file(file) as source:
        source.seek(max(0, at - 1))
        text = io.BufferedReader(source)
        # the line that begins in the slice before, or the header
        begun = max(0, at - 1) + len(text.readline())
        while begun < at + SLICE_BYTES and (row := text.readline()):
            begun += len(row)
            for line in row.splitlines():
                if line.strip(BLANK):
                    yield line.decode("utf-8", "replace")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Range records (binomial, legend, rings) from a shape file, parquet or JSON lines; several per species.

    For a folder of shape files see :func:`phylomart.sources.shapes.read_shapes`.
    """
    if re.search(r"\.shp$", path, re.IGNORECASE):
        return read_shapes(spark, path)
    if re.search(r"\.jsonl?(\.gz)?$", path):
        return spark.read.schema(RANGE_SCHEMA).json(path)
    return spark.read.schema(RANGE_SCHEMA).parquet(path)
