import os

import duckdb

import catalog.traits  # noqa: F401
from catalog.registry import QUERIES

SMOKE = "/root/testdata/sf0.001"


def test_numbers_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Several parts have one name; their numbers once followed their order in the file."""
    for name in os.listdir(SMOKE):
        if name != "part.parquet":
            os.symlink(f"{SMOKE}/{name}", tmp_path / name)
    duckdb.connect().execute(f"copy (select * from '{SMOKE}/part.parquet' order by p_partkey desc) to '{tmp_path}/part.parquet' (format parquet)")
    got = [sorted(map(tuple, QUERIES["b18_to_numeric"](spark, d).collect()), key=str) for d in (SMOKE, str(tmp_path))]
    assert got[0] == got[1]
