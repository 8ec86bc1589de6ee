"""p-values against closed forms and tables; Gower distances over many traits and many patterns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylomart.functions.student import two_sided_p
from phylomart.operators import stats


def closed(t, n):
    """The finite sums for whole degrees of freedom, in plain Python."""
    angle, term, total = math.atan(abs(t) / math.sqrt(n)), 1.0, 0.0
    for k in range(n // 2):
        if k:
            term *= (2 * k - 1) / (2 * k) if n % 2 == 0 else 2 * k / (2 * k + 1)
        total += term * math.cos(angle) ** (2 * k)
    if n % 2 == 0:
        return 1 - math.sin(angle) * total
    return 1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)


def test_p_values(make):
    rows = [(t, n) for n in (1, 2, 3, 4, 5, 10, 31, 100, 1001, 20_000) for t in (0.0, 1e-6, 0.3, -1.0, 1.96, 2.5, -4.0)]
    got = make(rows, "t double, n long").select("t", "n", two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.p == pytest.approx(closed(r.t, r.n), abs=1e-9)


# The usual table of two-sided points.
@pytest.mark.parametrize(("t", "n", "p"), [(12.7062047364, 1, 0.05), (4.3026527297, 2, 0.05), (2.2281388520, 10, 0.05), (2.0422724563, 30, 0.05), (3.1692726726, 10, 0.01), (1.9839715185, 100, 0.05)])
def test_p_values_of_the_table(make, t, n, p):
    assert make([(t, n)], "t double, n long").select(two_sided_p(F.col("t"), F.col("n"))).first()[0] == pytest.approx(p, abs=1e-9)


def test_p_values_of_far_and_missing_t(make):
    rows = [(40.0, 10), (float("inf"), 3), (None, 3), (1.0, 0), (1.0, None)]
    got = [r[0] for r in make(rows, "t double, n long").select(two_sided_p(F.col("t"), F.col("n"))).collect()]
    assert 0 < got[0] < 1e-10 and got[1] == 0.0 and got[2:] == [None, None, None]
    # for two degrees of freedom a far tail is 1 / t**2 to first order
    assert make([(1e6, 2)], "t double, n long").select(two_sided_p(F.col("t"), F.col("n"))).first()[0] == pytest.approx(1e-12, rel=1e-6)


def plain_gower(rows, n_traits):
    spans = []
    for k in range(n_traits):
        known = [r[1 + k] for r in rows if r[1 + k] is not None]
        spans.append(max(known) - min(known) if known else 0)
    out = {}
    for a in rows:
        ds = []
        for b in rows:
            if a is not b:
                gaps = [abs(a[1 + k] - b[1 + k]) / spans[k] for k in range(n_traits) if spans[k] and a[1 + k] is not None and b[1 + k] is not None]
                ds.append(sum(gaps) / len(gaps) if gaps else None)
        known = [d for d in ds if d is not None]
        out[a[0]] = (len(known), len(ds) - len(known), sum(known), sum(known) / len(known) if known else None)
    return out


@pytest.mark.parametrize(("n_traits", "share", "kinds"), [(40, 0.1, None), (70, 0.05, None), (70, 0.3, 20), (5, 0.5, None), (1, 0.5, None)])
def test_gower_over_any_number_of_traits(make, n_traits, share, kinds):
    rng = random.Random(n_traits)
    shapes = [[rng.random() < share for _ in range(n_traits)] for _ in range(kinds or 90)]
    rows = [(i, *[float(rng.randint(0, 20)) if has else None for has in shapes[i % len(shapes)]]) for i in range(90)]
    names = [f"t{k}" for k in range(n_traits)]
    df = make(rows, "item long, " + ", ".join(f"{n} double" for n in names))
    got = {r.item: tuple(r)[1:] for r in stats.gower_distance(df, "item", names).collect()}
    want = plain_gower(rows, n_traits)
    assert set(got) == set(want)
    for i, (n, missing, total, mean) in want.items():
        assert got[i][:2] == (n, missing) and got[i][2] == pytest.approx(total, abs=1e-9)
        assert got[i][3] is None if mean is None else got[i][3] == pytest.approx(mean, abs=1e-9)


def test_both_gower_forms_agree(make, monkeypatch):
    rng = random.Random(8)
    rows = [(i, *[rng.random() if rng.random() < 0.6 else None for _ in range(5)]) for i in range(120)]
    names = [f"t{k}" for k in range(5)]
    df = make(rows, "item long, " + ", ".join(f"{n} double" for n in names))
    few = {r.item: tuple(r) for r in stats.gower_distance(df, "item", names).collect()}
    monkeypatch.setattr(stats, "PATTERNS", 0)
    many = {r.item: tuple(r) for r in stats.gower_distance(df, "item", names).collect()}
    assert set(few) == set(many)
    for i in few:
        assert few[i][1:3] == many[i][1:3] and few[i][3:] == pytest.approx(many[i][3:])


def test_gower_of_nothing(make):
    assert stats.gower_distance(make([], "item long, a double"), "item", ["a"]).count() == 0


def test_gower_by_subsets_forms_no_pairs(make, monkeypatch):
    """Items with few of many traits meet in the subsets of traits that they share; equal values, a trait without a range and items with no trait included."""
    rng = random.Random(21)
    names = [f"t{i}" for i in range(40)]
    rows = [(f"i{k}", *[rng.choice([float(rng.randint(0, 6)), rng.random()]) if rng.random() < 0.12 else None for _ in names[:-1]], 3.0 if k % 2 else None) for k in range(400)]
    rows += [("none", *[None] * 40), ("i0 again", *rows[0][1:])]
    df = make(rows, "item string, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(stats, "ROW_PAIRS", 1 << 40)
    want = {r.item: r for r in stats.gower_distance(df, "item", names).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(stats, "ROW_PAIRS", 0)
    monkeypatch.setattr(stats, "_gower_by_tiles", None)
    got = {r.item: r for r in stats.gower_distance(df, "item", names).collect()}
    assert got.keys() == want.keys() and got["none"].defined_pairs == 0 and got["none"].mean_distance is None
    for item, r in want.items():
        assert (got[item].defined_pairs, got[item].undefined_pairs) == (r.defined_pairs, r.undefined_pairs)
        assert got[item].total_distance == pytest.approx(r.total_distance, abs=1e-9)


@pytest.mark.parametrize("n, traits, share", [(1, 5, 0.5), (2, 5, 0.9), (300, 39, 0.22), (200, 9, 0.8)])
@pytest.mark.parametrize("rows, pairs", [(1 << 19, 2048), (64, 2048), (256, 0), (1 << 30, 0)])
def test_subset_sums_equal_pairs(monkeypatch, n, traits, share, rows, pairs):
    from phylomart.operators import subsets

    monkeypatch.setattr(subsets, "SUBSET_ROWS", rows)
    monkeypatch.setattr(subsets, "PAIR_LIST", pairs)
    rng = np.random.default_rng(n + traits)
    x, rest = np.sort(rng.integers(0, 40, n) / 40.0), (rng.random((n, traits)) < share) @ (1 << np.arange(traits))
    weight = 1 / (np.bitwise_count(rest[:, None] & rest[None, :]) + 1.0)
    np.fill_diagonal(weight, 0.0)
    found = [subsets.subset_sums(x, rest, part, 3) for part in range(3)]
    np.testing.assert_allclose(sum(f[0] for f in found), (weight * np.abs(x[:, None] - x[None, :])).sum(1), atol=1e-9)
    np.testing.assert_allclose(sum(f[1] for f in found), weight.sum(1), atol=1e-9)
