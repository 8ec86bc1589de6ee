"""How often a plan evaluates the records it is given."""

import pytest
from pyspark.sql import functions as F

from phylomart.operators import occurrences as o
from phylomart.plans.occurrences import extract_occurrences

RINGS = "binomial string, legend string, rings array<array<struct<x:double,y:double>>>"
SQUARE = [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]


def counted(df, key):
    """``df`` with an accumulator of how many of its rows were evaluated."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    return df.withColumn(key, F.udf(look, "long").asNondeterministic()(key)), seen


def mart(make):
    return {
        "branches": make([(1, None, 1, "ORD", 11), (2, 1, 2, "Aa bb", 11), (3, 2, 3, "Aa bb cc", 11)], "node_id long, parent_id long, taxonvariant_id long, label string, tree_id long"),
        "taxonvariants": make([(1, "ORD", "ORDER", 1), (2, "Aa bb", "SPECIES", 2), (3, "Aa bb cc", "SUBSPECIES", 3), (4, "Alias", "SPECIES", 2)], "taxonvariant_id long, taxonvariant_name string, taxonvariant_level string, taxon_id long"),
        "taxa": make([(1, "ORD", "ORDER"), (2, "Aa bb", "SPECIES"), (3, "Aa bb cc", "SUBSPECIES")], "taxon_id long, taxon_name string, taxon_level string"),
        "occurrences": make([(i, i, "FOSSIL_SPECIMEN", "2001-01-01", 1.0 + i / 100, 2.25, f"{1.0 + i / 100:.2f}", "2.25", 2 + i % 3) for i in range(30)],
                            "occurrence_id long, gbif_id long, basis_of_record string, event_date string, decimal_latitude double, decimal_longitude double, latitude_text string, longitude_text string, taxonvariant_id long"),
    }


@pytest.mark.parametrize("sample", [1000, None])
def test_extraction_derives_the_records_once(make, sample):
    tables, roots = mart(make), make([("ORD",)], "label string")
    tables["occurrences"], seen = counted(tables["occurrences"], "taxonvariant_id")
    ranges = make([("Aa bb", "Extant", SQUARE)], RINGS)
    kept = extract_occurrences(tables, roots, ranges, sample=sample, thresh=9.0)
    assert sorted(r.occurrence_id for r in kept.collect()) == list(range(30))
    assert seen.value == 30


def test_range_rule_derives_the_records_once(make):
    rows = make([(i, "Aa bb", float(i), 1.0) for i in range(6)], "occurrence_id long, taxon_name string, decimal_latitude double, decimal_longitude double")
    rows, seen = counted(rows, "occurrence_id")
    names, ranges = make([("Aa bb", "Aa bb")], "taxon_name string, name string"), make([("Aa bb", "Extant", SQUARE)], RINGS)
    kept = o.filter_by_range(rows, ranges, names, 1)
    assert sorted(r.occurrence_id for r in kept.collect()) == [0, 1, 2]
    assert seen.value == 6


def test_bounded_gate_equals_the_plain_one(make):
    rows = make([(i, g) for i, g in enumerate(["a"] * 4 + ["b"] * 2 + [None] * 5)], "occurrence_id long, taxon_name string")
    plain, bounded = (sorted(r.occurrence_id for r in o.min_records_gate(rows, n=3, bounded=b).collect()) for b in (False, True))
    assert plain == bounded == [0, 1, 2, 3]
