"""Incremental occurrence ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from phylomart.operators.cleaning import bool_word_to_int
from phylomart.operators.joins import insert_if_absent
from phylomart.plans.occurrences import STORED_COLUMNS, clean_occurrences
from phylomart.runtime import cut_lineage
from phylomart.schemas import TABLES

_STORED = StructType([f for f in TABLES["occurrences"].fields if f.name in STORED_COLUMNS]).add("event_month", StringType())


def stored_schema() -> StructType:
    """Schema of the ingest table: the stored columns and the month it is partitioned by."""
    return _STORED


def append_new(batch: DataFrame, table: str) -> None:
    """Append the batch's rows that are not yet stored.

    Equal rows share their event month, so only stored rows of the batch's months are compared; the table is
    partitioned by month, and dynamic pruning may skip the others. The batch is parsed once.
    """
    spark = batch.sparkSession
    rows = clean_occurrences(bool_word_to_int(batch, "has_geospatial_issues")).select(*STORED_COLUMNS)
    month = F.substring("event_date", 1, 7)
    rows = rows.withColumn("event_month", F.when(month.rlike("^[0-9]{4}-[0-9]{2}$"), month).otherwise("other"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(_STORED).parquet(table)
        rows = cut_lineage(rows)
        rows = insert_if_absent(rows, stored.join(rows.select("event_month").distinct(), "event_month", "left_semi").select(*rows.columns))
    else:
        rows = rows.dropDuplicates()
    rows.hint("rebalance", "event_month").write.mode("append").partitionBy("event_month").parquet(table)


def stream_occurrences(spark: SparkSession, in_dir: str, table: str, checkpoint: str, schema: StructType | str) -> StreamingQuery:
    """Read the new record files of ``in_dir`` and append their new rows to ``table``; replay adds nothing."""
    files = spark.readStream.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(in_dir)
    return (
        files.writeStream.foreachBatch(lambda batch, _: append_new(batch, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
