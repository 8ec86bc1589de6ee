"""Deep trees: rounds that grow with the logarithm of the nodes, and the same rows as plain walks."""

import random

import pytest

from phylomart.operators import hierarchy as h
from phylomart.operators import tours
from phylomart.operators import trees as t

TREE = "tree_id long, node_id long, parent_id long, branch_length double, label string"
VALUES = "tree_id long, node_id long, trait string, value double"


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that the loops write."""
    written = []
    for module in (tours, t, h):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: written.append(1) or cut(df))
    return written


def caterpillar(n, tree_id=1):
    """n inner nodes in a chain, each with a leaf, and two leaves at the end."""
    rows = [(tree_id, i, i - 1 if i else None, 1.0 + i % 3 if i else None, "") for i in range(n)]
    return rows + [(tree_id, n + i, i, 1.0 + i % 5, f"t{i}") for i in range(n)] + [(tree_id, 2 * n, n - 1, 2.0, "last")]


def plain_contrasts(rows, value):
    kids, own = {}, {r[1]: r for r in rows}
    for r in rows:
        kids.setdefault(r[2], []).append(r[1])
    order, stack = [], [n for n, r in own.items() if r[2] is None]
    while stack:
        order.append(stack.pop())
        stack += kids.get(order[-1], [])
    got, out = {}, {}
    for n in reversed(order):
        length = own[n][3] or 0.0
        if n not in kids:
            got[n] = (value[n], length) if n in value else None
            continue
        below = [got[c] for c in sorted(kids[n]) if got[c]]
        if len(below) < 2:
            got[n] = (below[0][0], below[0][1] + length) if below else None
            continue
        (x1, v1), (x2, v2) = below
        flat = v1 + v2 == 0
        x = (x1 + x2) / 2 if flat else (x1 * v2 + x2 * v1) / (v1 + v2)
        out[n] = (None if flat else x1 - x2, x)
        got[n] = (x, length + (0 if flat else v1 * v2 / (v1 + v2)))
    return out


def contrasts(make, rows, value):
    found = t.independent_contrasts(make(rows, TREE), make([(1, n, "x", v) for n, v in value.items()], VALUES)).collect()
    return {r.node_id: (r.contrast, r.ancestor) for r in found}


def alike(got, want):
    assert set(got) == set(want)
    for n, (contrast, ancestor) in want.items():
        assert got[n][1] == pytest.approx(ancestor, rel=1e-9)
        assert got[n][0] is None if contrast is None else got[n][0] == pytest.approx(contrast, rel=1e-9, abs=1e-9)


def test_contrasts_of_a_long_chain(make, rounds):
    n = 5000
    rows = caterpillar(n)
    value = {n + i: float(i * 7 % 101) for i in range(n + 1)}
    alike(contrasts(make, rows, value), plain_contrasts(rows, value))
    assert len(rounds) < 40


def test_contrasts_sort_nothing_to_aggregate(make, monkeypatch):
    plans, cut = [], t.cut_lineage

    def look(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(t, "cut_lineage", look)
    rows = caterpillar(6)
    found = t.independent_contrasts(make(rows, TREE), make([(1, 6 + i, "x", float(i)) for i in range(7)], VALUES))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 6
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("seed", [1, 3])
def test_contrasts_with_zero_lengths_and_gaps(make, seed):
    """Binary trees whose lengths are mostly 0 and whose tips mostly lack a value: every case of the maps."""
    rng = random.Random(seed)
    rows, tips, node = [(1, 0, None, None, "")], [0], 0
    while len(rows) < 121:
        # the newest tips grow on, so that there are long chains
        up = tips.pop(rng.choice([-1, -1, -2, rng.randrange(len(tips))]) if len(tips) > 1 else 0)
        for _ in range(2):
            node += 1
            rows.append((1, node, up, rng.choice([0.0, 0.0, 1.0, 2.5]), ""))
            tips.append(node)
    value = {n: float(rng.randint(0, 9)) for n in tips if rng.random() < 0.6}
    alike(contrasts(make, rows, value), plain_contrasts(rows, value))


def test_no_values_and_no_tree(make):
    assert contrasts(make, caterpillar(5), {}) == {} == contrasts(make, [], {1: 1.0})


def test_distances_on_a_chain_of_100_000(spark, make, rounds):
    n = 100_000
    tree = spark.range(n).selectExpr("1L as tree_id", "id as node_id", "nullif(id, 0L) - 1 as parent_id", "1.0D as branch_length", "'' as label")
    pairs = [(1, a, b) for a, b in ((0, n - 1), (n - 1, 0), (5, 77_777), (50_000, 50_001), (40_000, 40_000), (99_990, 99_999))]
    got = {(r.a, r.b): r.distance for r in t.patristic_distance(tree, make(pairs, "tree_id long, a long, b long")).collect()}
    assert got == {(a, b): float(abs(a - b)) for _, a, b in pairs}
    assert len(rounds) < 50


def test_subtrees_of_a_long_chain(spark, make, rounds):
    n = 20_000
    tree = spark.range(n).selectExpr("1L as tree_id", "id as node_id", "nullif(id, 0L) - 1 as parent_id", "1.0D as branch_length", "'' as label")
    kept = h.induced_subtree(tree, make([(1, 9000), (1, n - 1)], "tree_id long, node_id long"))
    assert kept.agg({"node_id": "min"}).first()[0] == 9000 and kept.count() == n - 9000
    links = tree.selectExpr("node_id as child_page", "parent_id as parent_page")
    below = h.descendants(links, make([(100,), (15_000,), (n - 1,)], "root long")).groupBy("root").count().collect()
    assert {tuple(r) for r in below} == {(100, n - 101), (15_000, n - 15_001)}
    assert len(rounds) < 60


def walk(links, root):
    seen, at = set(), [root]
    while at:
        node = at.pop()
        for child in links.get(node, ()):
            if child not in seen:
                seen.add(child)
                at.append(child)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_in_a_graph_with_cycles_and_several_parents(make, seed):
    rng = random.Random(seed)
    pairs = [(n, rng.choice([n - 1, rng.randrange(60)])) for n in range(1, 60)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(8)]
    pairs += [(101, 100), (102, 101), (100, 102), (103, 102), (None, 5), (5, None)]
    links = {}
    for child, parent in pairs:
        if child is not None and parent is not None:
            links.setdefault(parent, []).append(child)
    roots = [0, 7, 20, 59, 100, 101, 999]
    got = h.descendants(make(pairs, "child_page long, parent_page long"), make([(r,) for r in roots], "root long")).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == {(r, d) for r in roots for d in walk(links, r)}


@pytest.mark.parametrize("include_start", [True, False])
def test_expansion_in_deep_and_circular_taxonomies(make, include_start):
    rng = random.Random(4)
    level = lambda n: "SPECIES" if n % 7 == 3 else "GENUS"
    up = {0: None} | {n: rng.choice([n - 1, n - 1, rng.randrange(n)]) for n in range(1, 150)} | {200: 202, 201: 200, 202: 201, 206: 202, 207: 206}
    branches = make([(n, p, n, 11) for n, p in up.items()], "node_id long, parent_id long, taxonvariant_id long, tree_id long")
    variants = make([(n, f"v{n}", level(n), "accepted", n) for n in up], "taxonvariant_id long, taxonvariant_name string, taxonvariant_level string, taxonvariant_status string, taxon_id long")
    taxa = make([(n, f"v{n}", level(n)) for n in up], "taxon_id long, taxon_name string, taxon_level string")
    kids = {}
    for n, p in up.items():
        kids.setdefault(p, []).append(n)
    want = set()
    roots = [0, 3, 10, 50, 120, 200, 201, 206]
    for root in roots:
        if include_start and level(root) == "SPECIES":
            want.add((root, root))
            continue
        seen, at = {root}, [root]
        while at:
            for child in kids.get(at.pop(), ()):
                if child not in seen:
                    seen.add(child)
                    if level(child) == "SPECIES":
                        want.add((root, child))
                    else:
                        at.append(child)
    found = h.expand_taxon(branches, variants, taxa, make([(r,) for r in roots], "node_id long"), include_start=include_start).collect()
    assert sorted((r.root_id, r.node_id) for r in found) == sorted(want)


def test_circles_are_reported(make):
    ring = make([(1, 1, 3, 1.0, ""), (1, 2, 1, 1.0, ""), (1, 3, 2, 1.0, ""), (2, 1, None, None, ""), (2, 2, 1, 1.0, "")], TREE)
    for ask in (lambda: tours.climb(tours.interior(ring)), lambda: h.induced_subtree(ring, make([(2, 2)], "tree_id long, node_id long"))):
        with pytest.raises(ValueError, match="cycle"):
            ask()
