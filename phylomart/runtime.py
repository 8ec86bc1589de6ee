"""Session set-up, lineage cuts and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Up to this many bytes a frame whose row count was measured may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, app: str = "phylomart", **conf: str) -> SparkSession:
    """A session with the settings the plans rely on: AQE with skew-join splitting, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


# A join on a species, label or prefix may meet a key with a third of all rows. AQE splits such a
# partition; without the last setting it would not when a following aggregation reuses the join's
# partitioning.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # folders of very many species are listed by some hundred tasks, not by ten thousand that see a few each
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


# Before a join has run only file sizes tell of it, and rows may take thirty times their files. Larger sides are left to AQE,
# which broadcasts by the measured size of the rows.
FILE_BROADCAST_BYTES = 1024 * 1024

# Rows of keys and numbers take thirty times their shuffled or stored bytes when they are sorted or aggregated, so a task gets few of these: 64 and
# 128 MB of them, the defaults, come to gigabytes. The sizes only say how many small partitions or files one task takes together.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 * 1024 * 1024, "spark.sql.files.maxPartitionBytes": 16 * 1024 * 1024}


def _size(spark: SparkSession, key: str) -> int:
    """A setting of the session in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the plans rely on, in a session made elsewhere too."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit > FILE_BROADCAST_BYTES:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", f"{limit}b")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", f"{FILE_BROADCAST_BYTES}b")
    for key, most in TASK_BYTES.items():
        if _size(spark, key) > most:
            spark.conf.set(key, f"{most}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="phylomart-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result survives lost executors, later plans start from it with pruning and pushdown, and its
    file sizes let the planner choose joins by measured size. Tables lie in a folder named by the
    application, which may be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phylomart/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Mark ``df`` for broadcast when its counted rows prove it small; leave it alone otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lookup_side(df: DataFrame) -> DataFrame:
    """A per-key aggregate about to be joined back to rows whose keys may be skewed.

    AQE splits a skewed partition only where both sides of the join are plain shuffles. An aggregate
    by the join key is already partitioned by it and would suppress the split, so it is written
    first; one row per key, and its measured size decides on a broadcast.
    """
    return cut_lineage(df)


def null_safe(left: str, right: str, columns: Sequence[str]) -> Column:
    """Join condition ``left.c <=> right.c`` over all ``columns`` of two aliased frames."""
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a & b, pairs)


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position", stored: bool = False) -> DataFrame:
    """Number all rows 1..n in ``order_by`` order without a single-partition window.

    Rows are range-partitioned and sorted; the row's partition and its place in it are frozen in a
    written table, so the later per-partition offsets always belong to the same split. ``order_by``
    should end in a unique column: range partitioning cannot split equal keys. Range partitioning
    reads its input twice, to sample and to shuffle, so ``df`` is written first unless it is already
    ``stored``, that is a plain read of a table.
    """
    slot = "_slot"
    source = df if stored else cut_lineage(df)
    frozen = cut_lineage(
        source.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(slot, F.monotonically_increasing_id())
    )
    # monotonically_increasing_id = partition << 33 | place in the partition
    part, place = F.shiftright(slot, 33), F.col(slot).bitwiseAND((1 << 33) - 1)
    sizes = frozen.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition, so this window is as small as the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        frozen.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_before", slot)
    )


def running_sums(df: DataFrame, order_by: Sequence[str], sums: Sequence[str], stored: bool = False) -> DataFrame:
    """``df`` with each long column of ``sums`` replaced by its sum over all rows up to this one in ``order_by`` order.

    As in :func:`with_position`, rows are range-partitioned and sorted once; a task adds up its own rows, and one row per
    partition holds what came before. ``order_by`` should end in a unique column.
    """
    source = df if stored else cut_lineage(df)
    slotted = source.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_slot", F.monotonically_increasing_id())
    # a task adds up its sorted rows before they are written, so no row moves again for the sums
    summed = slotted.mapInArrow(_added_up(tuple(sums)), slotted.schema)
    frozen = cut_lineage(summed.withColumn("_part", F.shiftright("_slot", 33)))
    totals = frozen.groupBy("_part").agg(*[F.max_by(c, "_slot").alias(f"_{c}") for c in sums])
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    kept = [(F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else F.col(c) for c in df.columns]
    return frozen.join(F.broadcast(offsets), "_part").select(*kept)


def _added_up(sums: tuple[str, ...]):
    """Record batches of one task with each long column of ``sums`` replaced by its sum up to the row; a null adds nothing."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in held:
                    column = pc.add(pc.cumulative_sum(pc.fill_null(column, 0)), held[name])
                    held[name] = column[-1].as_py()
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return add


def ordinal_within(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], name: str = "position", stored: bool = False
) -> DataFrame:
    """Number rows 1..k inside each group; a group larger than one task is spread over several."""
    placed = with_position(df, [*group, *order_by], "_pos", stored)
    firsts = lookup_side(placed.groupBy(*group).agg(F.min("_pos").alias("_first")))
    joined = placed.alias("p").join(firsts.alias("f"), null_safe("p", "f", group))
    return joined.select("p.*", (F.col("_pos") - F.col("_first") + 1).alias(name)).drop("_pos")
