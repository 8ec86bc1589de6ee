"""Plans under a key that holds most rows."""

import pytest
from pyspark.sql import functions as F

from phylomart.operators.joins import backfill_fk
from phylomart.operators.occurrences import min_records_gate, sample_n

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def tight(spark):
    """Thresholds small enough for a test table to count as skewed."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=40000):
    label = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("label "), F.col("id").cast("string")))
    return spark.range(0, n, 1, 8).select(F.col("id").alias("occurrence_id"), label.alias("label"), F.md5(F.col("id").cast("string")).alias("text"))


def test_a_hot_label_is_split_even_before_an_aggregation_on_it(tight):
    occ = hot_rows(tight)
    label_map = occ.select("label").distinct().withColumn("taxonvariant_id", F.xxhash64("label"))
    joined = backfill_fk(occ, label_map)
    assert "skew=true" in final_plan(joined)
    # the text keeps the hot partition large: the label alone would compress to nothing
    counted = joined.groupBy("label").agg(F.count("taxonvariant_id").alias("n"), F.max("text").alias("last"))
    assert "skew=true" in final_plan(counted)
    assert counted.filter("label = 'hot'").first().n == 20000


def test_gate_and_sample_keep_a_hot_group_whole(tight):
    occ = hot_rows(tight)
    assert min_records_gate(occ, "label", 10).count() == 20000
    kept = sample_n(occ, "label", 100, seed=1)
    assert kept.filter("label = 'hot'").count() == 100
    assert kept.count() == 20100
