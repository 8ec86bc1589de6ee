import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

# a quick cross-section; tools/check.py runs every query
SAMPLE = ["b10_filter_precision", "c6_taxon_fanout", "c10_accept_fuzzy", "d9_character_matrix", "d12_first_seen_ids", "e5_ranks_to_adjacency",
          "e9_resolve_polytomies", "f2_sample_n", "f3_gower_distance", "g9_triples_for_taxa", "g7_extract_occurrences"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, entry.SMOKE_DIR)
    ours = rows(df.columns, df.collect())
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{entry.SMOKE_DIR}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert ours == rows([d[0] for d in cur.description], cur.fetchall())
    assert sum(ours[1].values()) > 0


ALONE = ["d13_assign_keys", "e8_roots_and_orphans", "e11_patristic_distance", "c17_page_by_name", "e6_drop_tips"]


@pytest.mark.parametrize("name", ALONE)
def test_query_needs_no_views_of_others(spark, name):
    alone = spark.newSession()
    df = entry.queries()[name](alone, entry.SMOKE_DIR)
    small = df.count()
    assert small > 0
    # another scale factor in the same session reads its own tables
    assert entry.queries()[name](alone, "/root/testdata/sf0.01").count() > (0 if name == "c17_page_by_name" else small)


def test_no_query_reads_a_view_it_did_not_make():
    folder = os.path.join(os.path.dirname(entry.__file__), "catalog")
    for file in os.listdir(folder):
        if file.endswith(".py"):
            with open(os.path.join(folder, file)) as text:
                assert "spark.table(" not in text.read(), file


def test_flagship_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude"] and df.count() > 0
