import math
import random

import numpy as np
import pytest

from phylomart.operators.stats import path_lengths, permutation_correlations, permuted_labels, shared_path_table


def forest(rng, n):
    """Root-first paths and depths of n tips in two trees with uneven depths, some branches of no or negative length."""
    nodes = {0: ([0], [0.0]), 1: ([1], [0.0])}
    for k in range(2, n):
        path, depths = nodes[rng.choice(list(nodes)[-8:] + [0, 1])]
        nodes[k] = ([*path, k], [*depths, depths[-1] + rng.choice([0.0, 0.5, 1.25, 3.0, -0.25])])
    return {k: (path + [1000 + k], depths + [depths[-1] + 0.5]) for k, (path, depths) in nodes.items()}


def length(p, q):
    shared = 0
    while shared < min(len(p[0]), len(q[0])) and p[0][shared] == q[0][shared]:
        shared += 1
    return p[1][-1] + q[1][-1] - 2 * p[1][shared - 1] if shared else math.nan


def test_path_lengths_by_range_minimum():
    for n in (2, 3, 8, 9, 70):
        tips = sorted(forest(random.Random(n), n).values())
        common = [next((i for i, (x, y) in enumerate(zip(p[0], q[0])) if x != y), min(len(p[0]), len(q[0]))) for p, q in zip(tips, tips[1:])]
        depth = [p[1][c - 1] if c else math.nan for p, c in zip(tips, common)]
        table = shared_path_table([t[1][-1] for t in tips], common, depth)
        every = np.arange(n)
        want = [[0.0 if i == j else length(tips[i], tips[j]) for j in range(n)] for i in range(n)]
        np.testing.assert_allclose(path_lengths(every, every, *table), want)
    one = shared_path_table([2.0], [], [])
    assert path_lengths(np.array([0]), np.array([0]), *one).tolist() == [[0.0]]


@pytest.mark.parametrize("tile_rows,broadcast_bytes", [(7, 1 << 26), (1024, 1 << 26), (7, 0)])
def test_permutations_equal_brute_force(make, tile_rows, broadcast_bytes):
    rng = random.Random(6)
    tips = forest(rng, 40)
    traits = [(k, rng.random() if k % 5 else None, float(rng.randint(0, 5)) if k % 7 else None) for k in tips] + [(999, 1.0, 1.0)]
    items = make(traits, "item long, t1 double, t2 double")
    paths = make([(k, *p) for k, p in tips.items()] + [(998, [0], [0.0])], "item long, path array<long>, depths array<double>")
    got = {r.perm: r for r in permutation_correlations(items, "item", ["t1", "t2"], paths, 12, 3, tile_rows, broadcast_bytes).collect()}
    known = [t for t in traits if t[0] in tips]
    spans = [max(t[c] for t in known if t[c] is not None) - min(t[c] for t in known if t[c] is not None) for c in (1, 2)]
    moved = permuted_labels(make([(t[0],) for t in known], "item long"), "item", 12, 3).collect()
    for perm in range(13):
        place = {r.item: r.other for r in moved if r.perm == perm}
        xs, ys = [], []
        for i, p in enumerate(known):
            for q in known[:i]:
                gaps = [abs(p[c] - q[c]) / spans[c - 1] for c in (1, 2) if p[c] is not None and q[c] is not None]
                y = length(tips[place[p[0]]], tips[place[q[0]]])
                if gaps and not math.isnan(y):
                    xs.append(sum(gaps) / len(gaps))
                    ys.append(y)
        assert got[perm].n_pairs == len(xs)
        assert got[perm].r == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)
    assert len(got) == 13


def test_few_items(make):
    for n in (0, 1, 2):
        items = make([(i, float(i)) for i in range(n)], "item long, t double")
        paths = make([(i, [0, i + 1], [0.0, 1.0]) for i in range(n)], "item long, path array<long>, depths array<double>")
        rows = permutation_correlations(items, "item", ["t"], paths, 2).collect()
        assert [(r.r, r.n_pairs) for r in rows] == ([(None, n * (n - 1) // 2)] * 3 if n else [])


def test_sums_over_nodes_equal_tiles(make, monkeypatch):
    """In one tree no permutation forms pairs; patterns without a shared trait, chains and tips with the root's children included."""
    from phylomart.operators import stats

    rng = random.Random(9)
    tips = {k: ([-1, *p], [0.5, *[d + 0.5 for d in deep]]) for k, (p, deep) in forest(rng, 60).items()}
    traits = [(k, rng.random() if k % 3 else None, float(rng.randint(0, 5)) if k % 4 else None) for k in tips]
    items = make(traits, "item long, t1 double, t2 double")
    paths = make([(k, *p) for k, p in tips.items()], "item long, path array<long>, depths array<double>")
    want = {r.perm: r for r in permutation_correlations(items, "item", ["t1", "t2"], paths, 5, 3, 1024).collect()}
    monkeypatch.setattr(stats, "_moments_in_one_pass", None)
    monkeypatch.setattr(stats, "_moments_by_tiles", None)
    got = {r.perm: r for r in permutation_correlations(items, "item", ["t1", "t2"], paths, 5, 3, 7, 0).collect()}
    assert got.keys() == want.keys()
    for perm, r in want.items():
        assert got[perm].n_pairs == r.n_pairs and got[perm].r == pytest.approx(r.r, abs=1e-9)


def test_permutations_over_numbered_tips_equal_tiles(make, monkeypatch):
    """In one tree whose tips fit a broadcast, no label of a permutation is a row, and no pair is formed."""
    from phylomart.operators import stats

    rng = random.Random(12)
    tips = {k: ([-1, *p], [0.5, *[d + 0.5 for d in deep]]) for k, (p, deep) in forest(rng, 60).items()}
    # patterns without a shared trait, items without any, equal values
    traits = [(f"i{k}", rng.random() if k % 3 else None, float(rng.randint(0, 5)) if k % 4 else None, rng.random() if k % 5 == 0 else None) for k in tips]
    items = make(traits, "item string, t1 double, t2 double, t3 double")
    paths = make([(f"i{k}", *p) for k, p in tips.items()], "item string, path array<long>, depths array<double>")
    want = {r.perm: r for r in permutation_correlations(items, "item", ["t1", "t2", "t3"], paths, 6, 3, 1024).collect()}
    for other in ("_moments_in_one_pass", "_moments_by_tiles", "_moments_by_nodes", "_square_sum", "permuted_labels"):
        monkeypatch.setattr(stats, other, None)
    got = {r.perm: r for r in permutation_correlations(items, "item", ["t1", "t2", "t3"], paths, 6, 3, 7).collect()}
    assert got.keys() == want.keys()
    for perm, r in want.items():
        assert got[perm].n_pairs == r.n_pairs and got[perm].r == pytest.approx(r.r, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 130])
def test_concordant_products(n):
    from phylomart.operators.permuted import concordant

    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 9, n).astype(float), rng.random(n)
    p, weight = rng.integers(0, 2, n), np.array([[1.0, 0.25], [0.25, 0.0]])
    products = [(x[i] - x[j]) * (y[i] - y[j]) * weight[p[i], p[j]] for i in range(n) for j in range(i)]
    assert concordant(x, y, p, weight) == pytest.approx(sum(v for v in products if v > 0), abs=1e-9)
