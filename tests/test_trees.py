import random

import pytest

from phylomart.operators import hierarchy as h
from phylomart.operators import trees as t
from phylomart.operators.traits import accepted_branch

TREE = "tree_id long, node_id long, parent_id long, branch_length double, label string"


def grow(seed, size, tree_id=1):
    """A random tree with chains and polytomies: child -> (parent, length)."""
    rng = random.Random(seed)
    parent = {0: (None, None)}
    for node in range(1, size):
        parent[node] = (rng.choice([node - 1, rng.randrange(node), rng.randrange(max(1, node // 4))]), float(rng.randint(1, 9)))
    return parent, [(tree_id, n, p, v, f"n{n}") for n, (p, v) in parent.items()]


def climb(parent, node):
    out = [node]
    while parent[out[-1]][0] is not None:
        out.append(parent[out[-1]][0])
    return out


def shape(df):
    return {r.node_id: (r.parent_id, r.branch_length) for r in df.collect()}


def plain_collapse(parent):
    kids = {}
    for n, (p, _) in parent.items():
        kids.setdefault(p, []).append(n)
    single = {n for n in parent if len(kids.get(n, [])) == 1}
    out = {}
    for n, (p, v) in parent.items():
        if n in single:
            continue
        while p in single:
            v, p = v + (parent[p][1] or 0), parent[p][0]
        out[n] = (p, v if p is not None else None)
    return out


def plain_induced(parent, tips):
    paths = [climb(parent, n)[::-1] for n in tips]
    head = 0
    while all(len(p) > head + 1 for p in paths) and len({p[head + 1] for p in paths}) == 1:
        head += 1
    nodes = {n for p in paths for n in p[head:]}
    top = paths[0][head]
    return {n: (None, None) if n == top else parent[n] for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_subtrees_against_plain_walks(make, seed):
    parent, rows = grow(seed, 80)
    tree = make(rows, TREE)
    tips = sorted(set(parent) - {p for p, _ in parent.values()})
    picked = random.Random(seed).sample(tips, 6)
    chosen = make([(1, n) for n in picked], "tree_id long, node_id long")
    assert shape(h.induced_subtree(tree, chosen)) == plain_induced(parent, picked)
    assert shape(h.collapse_unary(tree)) == plain_collapse(parent)
    dropped = make([(1, n) for n in tips if n not in picked], "tree_id long, node_id long")
    assert shape(h.drop_tips(tree, dropped)) == plain_collapse(plain_induced(parent, picked))


def test_single_tip_and_no_tip(make):
    parent, rows = grow(5, 20)
    tree = make(rows, TREE)
    one = h.induced_subtree(tree, make([(1, 19)], "tree_id long, node_id long"))
    assert shape(one) == {19: (None, None)}
    assert h.induced_subtree(tree, make([], "tree_id long, node_id long")).count() == 0


def test_depths_paths_and_distances_on_a_chain_and_a_tree(make):
    chain = [(2, n, n - 1 if n else None, 1.0 if n else None, f"c{n}") for n in range(70)]
    parent, rows = grow(3, 60)
    tree = make(rows + chain, TREE)
    depth = {(r.tree_id, r.node_id): (r.depth, r.level, r.is_tip) for r in h.root_to_tip(tree).collect()}
    assert depth[2, 69] == (69.0, 69, True) and depth[2, 0] == (0.0, 0, False)
    down = {n: sum(parent[m][1] or 0 for m in climb(parent, n)) for n in parent}
    assert all(depth[1, n][0] == pytest.approx(down[n]) for n in parent)

    def path(a, b):
        shared = set(climb(parent, a)) & set(climb(parent, b))
        return down[a] + down[b] - 2 * max(down[n] for n in shared)

    nodes = sorted(parent)
    pairs = [(1, a, b) for a in nodes[:12] for b in nodes[-12:]] + [(2, 0, 69)]
    got = {(r.tree_id, r.a, r.b): r.distance for r in t.patristic_distance(tree, make(pairs, "tree_id long, a long, b long")).collect()}
    assert got[2, 0, 69] == 69.0
    assert all(got[1, a, b] == pytest.approx(path(a, b)) for _, a, b in pairs[:-1])
    tips = sorted(set(parent) - {p for p, _ in parent.values()})
    means = {r.node_id: r.mean_distance for r in t.mean_patristic_distance(tree, make([(1, n) for n in tips], "tree_id long, node_id long")).collect()}
    for a in tips:
        assert means[a] == pytest.approx(sum(path(a, b) for b in tips if b != a) / (len(tips) - 1))


def test_distance_across_components_is_null(make):
    tree = make([(1, 1, None, None, ""), (1, 2, None, None, ""), (1, 3, 1, 1.0, ""), (1, 4, 2, 1.0, "")], TREE)
    got = t.patristic_distance(tree, make([(1, 3, 4), (1, 3, 3)], "tree_id long, a long, b long"))
    assert {(r.a, r.b): r.distance for r in got.collect()} == {(3, 4): None, (3, 3): 0.0}


def test_resolved_tree_bifurcates_and_keeps_distances(make):
    rows = [(1, 0, None, None, "")] + [(1, n, 0, float(n), f"t{n}") for n in range(1, 12)] + [(1, 20, 11, 1.0, "a"), (1, 21, 11, 2.0, "b"), (1, 22, 11, 3.0, "c")]
    tree = make(rows, TREE)
    resolved = t.resolve_polytomies(tree)
    kids = resolved.filter("parent_id is not null").groupBy("tree_id", "parent_id").count()
    assert kids.filter("count <> 2").count() == 0
    before = {r.node_id: r.depth for r in h.root_to_tip(tree).collect()}
    after = {r.node_id: r.depth for r in h.root_to_tip(resolved).collect()}
    assert all(after[n] == before[n] for n in before)


def test_contrasts_on_a_hand_computed_tree(make):
    # ((A:1,B:1):1,(C:2,D:1):0.5)
    rows = [(1, 1, None, None, ""), (1, 2, 1, 1.0, ""), (1, 3, 1, 0.5, ""), (1, 4, 2, 1.0, "A"), (1, 5, 2, 1.0, "B"), (1, 6, 3, 2.0, "C"), (1, 7, 3, 1.0, "D")]
    values = [(1, n, "x", v) for n, v in ((4, 2.0), (5, 4.0), (6, 1.0), (7, 7.0))]
    got = {r.node_id: (r.contrast, r.ancestor) for r in t.independent_contrasts(make(rows, TREE), make(values, "tree_id long, node_id long, trait string, value double")).collect()}
    assert got[2] == (-2.0, 3.0)
    assert got[3] == (-6.0, pytest.approx(5.0))  # (1*1 + 7*2) / 3
    v2, v3 = 1 + 1 * 1 / 2, 0.5 + 2 * 1 / 3
    assert got[1] == (pytest.approx(3.0 - 5.0), pytest.approx((3.0 * v3 + 5.0 * v2) / (v2 + v3)))


def test_contrasts_against_plain_recursion(make):
    parent, rows = grow(8, 70)
    tree = make(rows, TREE)
    rng = random.Random(9)
    tips = sorted(set(parent) - {p for p, _ in parent.values()})
    value = {(n, trait): float(rng.randint(0, 50)) for n in tips for trait in ("x", "y") if rng.random() < 0.9}
    got = {(r.node_id, r.trait): (r.contrast, r.ancestor) for r in t.independent_contrasts(tree, make([(1, n, k, v) for (n, k), v in value.items()], "tree_id long, node_id long, trait string, value double")).collect()}
    binary = {r.node_id: (r.parent_id, r.branch_length) for r in t.resolve_polytomies(h.collapse_unary(tree)).collect()}
    kids = {}
    for n in sorted(binary):
        kids.setdefault(binary[n][0], []).append(n)
    want = {}

    def visit(n, trait):
        length = binary[n][1] or 0.0
        if n not in kids:
            return (value[n, trait], length) if (n, trait) in value else None
        below = [v for v in (visit(c, trait) for c in kids[n]) if v]
        if len(below) < 2:
            return (below[0][0], below[0][1] + length) if below else None
        (x1, v1), (x2, v2) = below
        x = (x1 * v2 + x2 * v1) / (v1 + v2)
        want[n, trait] = (x1 - x2, x)
        return x, length + v1 * v2 / (v1 + v2)

    for trait in ("x", "y"):
        visit(next(n for n in binary if binary[n][0] is None), trait)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (pytest.approx(want[k][0]), pytest.approx(want[k][1]))


def test_zero_length_sisters_give_a_null_contrast_and_the_plain_mean(make):
    rows = [(1, 1, None, None, ""), (1, 2, 1, 0.0, "A"), (1, 3, 1, 0.0, "B")]
    values = [(1, 2, "x", 2.0), (1, 3, "x", 4.0)]
    row = t.independent_contrasts(make(rows, TREE), make(values, "tree_id long, node_id long, trait string, value double")).first()
    assert (row.contrast, row.ancestor) == (None, 3.0)


def test_descendants_stop_at_cycles(make):
    edges = make([(2, 1), (3, 2), (1, 3), (4, 3), (9, None)], "child_page long, parent_page long")
    got = {r.descendant for r in h.descendants(edges, make([(1,)], "root long")).collect()}
    assert got == {1, 2, 3, 4}
    assert h.descendants(edges, make([(9,)], "root long")).count() == 0
    twice = make([(2, 1), (2, 1)], "child_page long, parent_page long")
    assert [tuple(r) for r in h.descendants(twice, make([(1,), (1,)], "root long")).collect()] == [(1, 2)]


def test_trees_of_any_depth_and_cycles(make):
    n = 1200
    chain = make([(1, i, i - 1 if i else None, 1.0, f"n{i}") for i in range(n)], TREE)
    assert {(r.level, r.depth) for r in h.root_to_tip(chain).filter("is_tip").collect()} == {(n - 1, n - 1.0)}
    loop = make([(1, 1, 3, 1.0, "a"), (1, 2, 1, 1.0, "b"), (1, 3, 2, 1.0, "c")], TREE)
    with pytest.raises(ValueError, match="cycle"):
        h.root_to_tip(loop)
    with pytest.raises(ValueError, match="cycle"):
        h.collapse_unary(loop)
    levels = {1: "ORDER", 2: "GENUS", 3: "SPECIES"}
    branches = make([(1, 2, 1, 11), (2, 1, 2, 11), (3, 2, 3, 11)], "node_id long, parent_id long, taxonvariant_id long, tree_id long")
    variants = make([(i, f"v{i}", v, "accepted", i) for i, v in levels.items()], VARIANTS)
    taxa = make([(i, f"v{i}", v) for i, v in levels.items()], "taxon_id long, taxon_name string, taxon_level string")
    assert [(r.root_id, r.node_id) for r in h.expand_taxon(branches, variants, taxa, make([(1,)], "node_id long")).collect()] == [(1, 3)]
    assert h.expand_taxon(branches, variants, taxa, make([(99,)], "node_id long"), include_start=False).count() == 0


VARIANTS = "taxonvariant_id long, taxonvariant_name string, taxonvariant_level string, taxonvariant_status string, taxon_id long"


def taxonomy(make):
    # 1 ORDER - 2 GENUS - 3 SPECIES - 4 SUBSPECIES; 5 GENUS without children; 6 SPECIES straight below 1
    levels = {1: "ORDER", 2: "GENUS", 3: "SPECIES", 4: "SUBSPECIES", 5: "GENUS", 6: "SPECIES"}
    up = {1: None, 2: 1, 3: 2, 4: 3, 5: 1, 6: 1}
    branches = make([(n, p, n, 11) for n, p in up.items()], "node_id long, parent_id long, taxonvariant_id long, tree_id long")
    variants = make([(n, f"v{n}", v, "accepted", n) for n, v in levels.items()], VARIANTS)
    taxa = make([(n, f"v{n}", v) for n, v in levels.items()], "taxon_id long, taxon_name string, taxon_level string")
    return branches, variants, taxa


def test_expansion_stops_at_the_rank_and_drops_dead_ends(make):
    tables = taxonomy(make)
    roots = make([(1,), (3,)], "node_id long")
    got = sorted((r.root_id, r.node_id) for r in h.expand_taxon(*tables, roots).collect())
    assert got == [(1, 3), (1, 6), (3, 3)]
    below = sorted((r.root_id, r.node_id) for r in h.expand_taxon(*tables, roots, include_start=False).collect())
    assert below == [(1, 3), (1, 6)]


def test_with_subspecies(make):
    branches, variants, taxa = taxonomy(make)
    got = sorted((r.taxon_id, r.taxonvariant_id) for r in h.with_subspecies(taxa.filter("taxon_id in (3, 6)"), branches, variants).collect())
    assert got == [(3, 3), (3, 4), (6, 6)]


def test_accepted_branch_priority_and_ambiguity(make):
    variants = make([(1, "a", "", "accepted", 1), (2, "b", "", "synonym", 1), (3, "c", "", "synonym", 2), (4, "d", "", "synonym", 3), (5, "e", "", "synonym", 3)], VARIANTS)
    branches = make([(n * 10, n, n, 1.0, 12) for n in (1, 2, 3, 4, 5)], "branch_id long, node_id long, taxonvariant_id long, branch_length double, tree_id long")
    got = {r.taxon_id: r.node_id for r in accepted_branch(branches, variants, 12, ambiguous="drop").collect()}
    assert got == {1: 1, 2: 3}
    with pytest.raises(Exception, match="multiple branches for taxon 3"):
        accepted_branch(branches, variants, 12).collect()


def test_ultrametric(make):
    tree = make([(1, 0, None, None, ""), (1, 1, 0, 2.0, ""), (1, 2, 0, 1.0, ""), (1, 3, 2, 1.0, ""), (2, 0, None, None, ""), (2, 1, 0, 2.0, ""), (2, 2, 0, 1.0, "")], TREE)
    assert {r.tree_id: r.ultrametric for r in h.is_ultrametric(tree).collect()} == {1: True, 2: False}


def test_plans_have_no_python_and_no_cartesian(make):
    _, rows = grow(1, 30)
    plan = h.collapse_unary(make(rows, TREE))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
