import pytest

from phylomart.operators.graph import answer_rows, graph_literals, graph_objects, page_by_name, trait_edges
from phylomart.operators.stats import matrix_correlation
from phylomart.plans.triples import triples_for_taxa


def graph(make):
    traits = make([(1, 10, 2.5), (1, 11, None), (1, 12, None), (1, 13, 9.0)], "page_id long, trait_id long, measurement double")
    edge = "trait_id long, term_id long"
    terms = make([(1, "mass"), (2, "g"), (3, "diet"), (4, "grass")], "term_id long, name string")
    return trait_edges(traits, make([(10, 1), (11, 3), (12, 3)], edge), make([(10, 2)], edge), make([(11, 4), (12, 4)], edge), terms)


def test_edges_literals_and_distinct_objects(make):
    edges = graph(make)
    assert [tuple(r) for r in graph_literals(edges).collect()] == [(1, "mass", "g", 2.5)]
    assert [tuple(r) for r in graph_objects(edges).collect()] == [(1, "diet", "grass")]


def test_all_pages_of_a_name(make):
    pages = make([(1, "Aa"), (2, "Aa"), (3, "Bb")], "page_id long, canonical string")
    assert sorted(r.page_id for r in page_by_name(pages, make([("Aa",)], "canonical string")).collect()) == [1, 2]


def test_triples_of_binomial_descendants(make):
    pages = make([(5, "Fam"), (1, "Aa bb"), (2, "Aa")], "page_id long, canonical string")
    parents = make([(1, 2), (2, 5)], "child_page long, parent_page long")
    rows = triples_for_taxa(pages, parents, graph(make), make([("Fam",)], "canonical string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("Aa bb", "diet", "grass"), ("Aa bb", "mass (g)", "2.5")]


def test_stored_answers(make):
    rows = answer_rows(make([('{"data": [["a", "1"], ["b", null]]}',), ('{"data": []}',)], "body string"), "body")
    assert [list(r.cells) for r in rows.collect()] == [["a", "1"], ["b", None]]


def test_correlation_of_stored_matrices(make):
    one = make([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 3.0), (3, 4, None)], "a long, b long, distance double")
    two = make([(1, 2, 2.0), (1, 3, 4.0), (2, 3, 6.5), (3, 4, 1.0)], "a long, b long, distance double")
    got = matrix_correlation(one, two).first()
    assert got.n_pairs == 3 and got.r == pytest.approx(0.99794, abs=1e-4)
