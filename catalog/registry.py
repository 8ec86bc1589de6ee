"""Name to query function and oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import with_views
from phylomart.runtime import configure, shared_dir, with_position

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its oracle where SQL can express it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def in_order(df: DataFrame) -> DataFrame:
    """The rows of a sorted frame with their place as ``position``, so that a check sees the order."""
    return with_position(df.withColumn("_slot", F.monotonically_increasing_id()), ["_slot"], "position").drop("_slot")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
