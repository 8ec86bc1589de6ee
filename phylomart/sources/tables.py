"""The mart's tables as parquet folders and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phylomart.schemas import TABLES


def register_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Read every table under ``base`` with its declared schema and register it as a view."""
    found = {}
    for name, schema in TABLES.items():
        table = spark.read.schema(schema).parquet(f"{base}/{name}")
        table.createOrReplaceTempView(name)
        found[name] = table
    return found


def write_tables(tables: dict[str, DataFrame], base: str, mode: str = "errorifexists") -> None:
    """Write tables under ``base`` in their declared column order and types.

    Branches are partitioned by tree, so a query on one tree reads that tree only.
    """
    for name, df in tables.items():
        fields = TABLES[name].fields
        rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in fields])
        writer = rows.write.mode(mode)
        if name == "branches":
            writer = writer.partitionBy("tree_id")
        writer.parquet(f"{base}/{name}")
