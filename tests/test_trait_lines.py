import pytest

from phylomart.operators.traits import character_lines, character_matrix, matrix_lines

STATES = "taxon_name string, character_label string, character_value string, state_id long, extra int"
ROWS = [
    ("Aa b", "c1", "1.9", 1, 0), ("Aa b", "c1", "2.7", 2, 0), ("Aa b", "c4", "4", 3, 0), ("Bb", "c2", None, 4, 0), ("Bb", "c3", "x", 5, 0),
    ("Cc", "other", "9", 6, 0), ("Dd", None, "9", 7, 0), ("Bb", "c3", "x", 5, 0),
]


@pytest.mark.parametrize("kind", ["continuous", "discrete"])
def test_lines_are_those_of_the_matrix(make, kind):
    states = make(ROWS, STATES)
    kinds = dict.fromkeys(["c1", "c2", "c3", "c4", "c5"], kind)
    wide = matrix_lines(character_matrix(states, kinds)[kind == "discrete"])
    labels = make([(k,) for k in kinds] * 2, "character_label string")
    got = character_lines(states, labels, kind == "discrete").collect()
    assert sorted(r.line for r in got) == sorted(r.line for r in wide.collect()) and {r.n_cells for r in got} == {4}


def test_no_states_no_labels(make):
    labels = make([("c1",)], "character_label string")
    assert character_lines(make([], STATES), labels).count() == 0
    bare = character_lines(make(ROWS, STATES), make([], "character_label string")).collect()
    assert sorted((r.line, r.n_cells) for r in bare) == [("Aa_b", 0), ("Bb", 0), ("Cc", 0), ("Dd", 0)]


def test_many_characters_fill_lines_but_no_columns(make):
    rows = [(f"T{i % 3}", f"c{i:05d}", str(i), i, 0) for i in range(2500)]
    states = make(rows, STATES)
    got = {r.line.split(" ")[0]: r.line.split(" ")[1:] for r in character_lines(states, states).collect()}
    assert got == {f"T{t}": [str(i) if i % 3 == t else "?" for i in range(2500)] for t in range(3)}
    with pytest.raises(ValueError, match="more than 2000"):
        character_matrix(states, {r[1]: "continuous" for r in rows})
