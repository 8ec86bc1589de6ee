"""Session settings and column helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylomart.runtime import configure

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows of an Arrow batch, so that a Python task holds a bounded piece of text at a time.
ARROW_ROWS = "1000"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the adaptive settings and batch size these operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    return F.translate(column, UPPER, UPPER.lower())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable can't be inlined again."""
    return F.transform(F.array(value), body)[0]
