import numpy as np

from phylomart.operators.pairwise import TILE_CELLS, block_sums, gower_tile, row_sums, tile_pairs, tile_rows_for
from phylomart.runtime import cut_lineage


def test_tile_pairs_are_not_broadcast(spark):
    """The copies of a tile for all others grow with the square of the rows, so they must not pass through the driver."""
    rows = cut_lineage(spark.range(600).selectExpr("id", "cast(id % 7 as double) as x"))
    pairs = tile_pairs(rows, [], "id", ["x"], 20)
    assert pairs.count() == 30 * 31 // 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tile_sizes():
    assert tile_rows_for(10, 3) == 1024
    assert tile_rows_for(10**9, 3) == 16384
    assert tile_rows_for(10**9, 40) * 40 <= TILE_CELLS
    assert tile_rows_for(10**9, 10**7) == 1


def test_blocks_equal_the_whole():
    rng = np.random.default_rng(1)
    p, q = ([np.where(rng.random(n) < 0.3, np.nan, rng.random(n)) for _ in range(3)] for n in (1500, 1100))
    whole = row_sums(gower_tile(p, q), np.ones(1500), np.ones(1100), False)
    for got, want in zip(block_sums(gower_tile, p, q, np.ones(1500), np.ones(1100), False), whole):
        np.testing.assert_allclose(got, want)
    gaps = np.abs(np.stack(p, 1)[:, None, :] - np.stack(q, 1)[None, :, :])
    known = ~np.isnan(gaps)
    with np.errstate(invalid="ignore"):
        want = np.where(known.any(2), np.where(known, gaps, 0).sum(2) / known.sum(2), np.nan)
    np.testing.assert_allclose(gower_tile(p, q), want)
