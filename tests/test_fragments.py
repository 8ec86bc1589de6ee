import pytest
from pyspark.sql import functions as F

from phylomart.sources.fragments import fragment_rejects, parse_fragments
from phylomart.sources.newick import newick_fragments, newick_rejects, parse_newick

PIECES = "tree_name string, ordinal long, fragment string"
TREES = {
    "plain": ["(A:1,", "(B:2,C_c:", "3)D:0.5", ",E)", "R;"],
    "one piece": ["((A,B)x:1,'it''s (odd)':2e-1,(,))[a (comment]y;"],
    "tip": ["Lonely:2;"],
    "no end": ["(A,", "B)"],
    "empty tips": ["(,", "(,),A)", ";"],
    "token a piece": list("((a,b),(c,(d,e)))") + [":", "7", ";"],
    "comments": ["(A[x],[y]", "B:1[z])[w];"],
    "stem": ["(((A)b:1)c:2)d;"],
    "open": ["((A,B);"],
    "closed": ["(A,B", "));"],
    "length": ["(A:one,B);"],
    "two": ["A,", "B;"],
    "tail": ["(A,B);", "(C,D);"],
}
GOOD = ["plain", "one piece", "tip", "no end", "empty tips", "token a piece", "comments", "stem"]


def pieces(make, trees):
    return make([(name, 10 * i, text) for name, parts in trees.items() for i, text in enumerate(parts)], PIECES)


def nodes(df):
    return {(r.tree_name, r.node_id, r.parent_id, r.branch_length, r.label) for r in df.collect()}


def test_pieces_give_what_whole_texts_give(make):
    trees = {name: TREES[name] for name in GOOD}
    whole = make([(name, "".join(parts)) for name, parts in trees.items()], "tree_name string, newick string")
    got = parse_fragments(pieces(make, trees))
    assert nodes(got) == nodes(parse_newick(whole)) and got.count() == len(nodes(got))


def test_wrong_texts_are_rejected_and_the_others_kept(make):
    df = pieces(make, TREES)
    assert {r.tree_name: r.error for r in fragment_rejects(df).collect()} == {
        "open": "brackets are not balanced", "closed": "brackets are not balanced", "length": "a length is not a number",
        "two": "more than one root", "tail": "text after the end",
    }
    assert {r.tree_name for r in parse_fragments(df).collect()} == set(GOOD)
    texts = make([(name, "".join(parts)) for name, parts in TREES.items() if name != "tail"], "tree_name string, newick string")
    assert {r.tree_name for r in newick_rejects(texts).collect()} == {"open", "closed", "length", "two"}


def test_no_rows_nulls_and_other_columns(make):
    assert parse_fragments(make([], PIECES)).count() == 0 and fragment_rejects(make([], PIECES)).count() == 0
    rows = [("t", 1, "(A,", 0, "x"), ("t", 2, None, 0, "x"), ("t", 3, "B);", 0, "x"), (None, 1, "(", 0, "x"), ("t", None, ")", 0, "x"), ("u", 1, "", 0, "x")]
    got = parse_fragments(make(rows, f"{PIECES}, s int, label string"))
    assert nodes(got) == {("t", 1, None, None, ""), ("t", 2, 1, None, "A"), ("t", 3, 1, None, "B")}


@pytest.mark.parametrize("n", [3000])
def test_a_chain_and_a_star_of_many_pieces_come_back(make, n):
    chain = [(1, i, i - 1 if i > 1 else None, float(i), f"n{i}") for i in range(1, n + 1)]
    star = [(2, i, 1 if i > 1 else None, None, f"m{i}") for i in range(1, n + 1)]
    tree = make(chain + star, "tree_id long, node_id long, parent_id long, branch_length double, label string")
    back = parse_fragments(newick_fragments(tree).withColumn("tree_name", F.col("tree_id").cast("string"))).drop("parent_id").collect()
    assert {(r.tree_name, r.label) for r in back} == {(str(r[0]), r[4]) for r in chain + star} and len(back) == 2 * n
    assert all(r.node_id == int(r.label[1:]) for r in back)


def test_running_sums_move_rows_once(make):
    """Rows are moved by their order only: the sums of a partition asked for a second shuffle of all rows."""
    import re

    from phylomart.runtime import running_sums

    rows = make([(i * 37 % 101, (i * 37 % 101) % 7 - 3, str(i)) for i in range(101)], "k long, v long, text string")
    got = running_sums(rows, ["k"], ["v"])
    assert not re.search(r"windowspecdefinition\(_part#\d+L?, _slot", got._jdf.queryExecution().toString())
    assert [r.v for r in got.orderBy("k").collect()] == [sum(j % 7 - 3 for j in range(k + 1)) for k in range(101)]
