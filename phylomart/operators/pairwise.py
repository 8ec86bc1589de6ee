"""All-pairs reductions without pair rows.

Rows of a group are dealt into tiles of bounded size. Two tiles meet in one row keyed by
(group, i, j), every such row is its own unit of work, and a numpy kernel reduces the tile pair to
one number per row of each tile. A group of a third of all rows therefore spreads over many tasks,
and no pair is ever emitted, shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from phylomart.functions.geo import EARTH_RADIUS_KM
from phylomart.runtime import lookup_side, null_safe

TILE_ROWS = 1024
# Distance tiles are dealt larger and cut into blocks of TILE_ROWS in the kernel: as a tile travels once to each other
# one, 16 times larger tiles move 16 times less.
DISTANCE_ROWS = 16 * TILE_ROWS
# Tiles of many features are dealt smaller, to this many cells.
TILE_CELLS = 640 * TILE_ROWS
# Tiles into which few rows are dealt, so that their pairs keep all tasks busy.
FEW_TILES = 24


def tile_rows_for(rows: int, features: int) -> int:
    """Rows a tile for ``rows`` rows of ``features`` numbers: large, as a tile travels once to each other one, but of bounded cells."""
    most = max(1, min(DISTANCE_ROWS, TILE_CELLS // max(1, features)))
    return min(most, max(min(TILE_ROWS, most), -(-rows // FEW_TILES)))


def tile_pairs(
    df: DataFrame, group: Sequence[str], id_col: str, features: Sequence[str], tile_rows: int = TILE_ROWS
) -> DataFrame:
    """One row per unordered pair of tiles (a tile with itself included).

    ``df`` is read more than once, so it should start from a checkpoint or a table.
    Columns: the group, ``i`` <= ``j``, and structs of arrays ``a`` (tile i) and ``b`` (tile j)
    holding ``id_col`` and ``features``. Row ids must be unique within the group; they decide the
    tile by hash, so tile sizes stay near ``tile_rows``.
    """
    group = list(group)
    columns = [id_col, *features]
    rows = df.select(*group, *columns)
    if group:
        counts = lookup_side(rows.groupBy(*group).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_tiles")))
        most = counts.agg(F.max("_tiles")).first()[0] or 1
    else:
        most = max(1, -(-rows.count() // tile_rows))
    packed = F.struct(*[F.col(f"_rows.{c}").alias(c) for c in columns])
    # collect_list is bounded here: a tile holds about tile_rows rows whatever the group's size
    gathered = F.collect_list(F.struct(*columns)).alias("_rows")
    if most == 1:
        tiles = rows.groupBy(*group).agg(gathered)
        zero = F.lit(0).cast("int")
        return tiles.select(*group, zero.alias("i"), zero.alias("j"), packed.alias("a"), packed.alias("b"))
    if group:
        sized = rows.alias("r").join(counts.alias("c"), null_safe("r", "c", group)).select("r.*", "_tiles")
    else:
        sized = rows.withColumn("_tiles", F.lit(most))
    dealt = sized.withColumn("_tile", F.pmod(F.xxhash64(id_col), F.col("_tiles")).cast("int"))
    many = dealt.groupBy(*group, "_tile", "_tiles").agg(gathered).select(*group, "_tile", "_tiles", packed.alias("_pack"))
    left = many.select(
        *group,
        F.col("_tile").alias("i"),
        F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("j"),
        F.col("_pack").alias("a"),
    )
    right = many.select(
        *group,
        F.explode(F.sequence(F.lit(0), "_tile")).alias("i"),
        F.col("_tile").alias("j"),
        F.col("_pack").alias("b"),
    )
    # a tile is small, its copies for all other tiles are not: judged by the tiles' size the copies would be broadcast
    return (
        left.hint("merge")
        .alias("l")
        .join(right.hint("merge").alias("m"), null_safe("l", "m", [*group, "i", "j"]))
        .select(*[F.col(f"l.{c}").alias(c) for c in [*group, "i", "j"]], "a", "b")
    )


def _matrix(columns: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


def great_circle_tile(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Distance matrix in km between two lists of points in degrees."""

    def unit(lat, lon):
        la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
        return np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)

    square = sum((p[:, None] - q[None, :]) ** 2 for p, q in zip(unit(lat1, lon1), unit(lat2, lon2)))
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(square) / 2))


def gower_tile(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Gower distances between rows of range-scaled traits; NaN where no trait is shared."""
    left, right = _matrix(a), _matrix(b)
    has_left, has_right = ~np.isnan(left), ~np.isnan(right)
    total = np.zeros((left.shape[0], right.shape[0]))
    shared = has_left.astype(np.float32) @ has_right.astype(np.float32).T
    for t in range(left.shape[1]):
        i, j = np.flatnonzero(has_left[:, t]), np.flatnonzero(has_right[:, t])
        gap = np.abs(left[i, t][:, None] - right[j, t][None, :])
        if gap.size == total.size:
            total += gap
        elif gap.size:
            total[np.ix_(i, j)] += gap
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shared > 0, total / shared, np.nan)


def patristic_tile(a_path, a_depth, b_path, b_depth) -> np.ndarray:
    """Tip-to-tip path lengths from root-first node paths and depths; NaN across trees."""
    n, m = len(a_path), len(b_path)
    levels = max([len(p) for p in a_path] + [len(p) for p in b_path] + [1])

    def padded(paths, depths, fill):
        ids = np.full((len(paths), levels), fill, dtype=np.int64)
        deep = np.zeros((len(paths), levels))
        for r, (p, d) in enumerate(zip(paths, depths)):
            ids[r, : len(p)] = p
            deep[r, : len(d)] = d
        return ids, deep, np.array([d[-1] if len(d) else 0.0 for d in depths])

    low = np.iinfo(np.int64).min
    ids_a, deep_a, end_a = padded(a_path, a_depth, low)
    ids_b, _, end_b = padded(b_path, b_depth, low + 1)
    common = np.full((n, m), np.nan)
    for level in range(levels):
        same = ids_a[:, level][:, None] == ids_b[:, level][None, :]
        common = np.where(same, deep_a[:, level][:, None], common)
    return end_a[:, None] + end_b[None, :] - 2 * common


PAIR_SUMS = StructType(
    [StructField(name, ArrayType(DoubleType())) for name in ("total_a", "n_a", "total_b", "n_b")]
)


def row_sums(distance: np.ndarray, weight_a, weight_b, itself: bool) -> tuple:
    known = ~np.isnan(distance)
    filled = np.where(known, distance, 0.0)
    wa, wb = np.asarray(weight_a, float), np.asarray(weight_b, float)
    to_a = (filled @ wb, known.astype(float) @ wb)
    if itself:
        none = np.empty(0)
        return (*to_a, none, none)
    return (*to_a, wa @ filled, wa @ known.astype(float))


@F.pandas_udf(PAIR_SUMS)
def _great_circle_sums(a: pd.DataFrame, b: pd.DataFrame, itself: pd.Series) -> pd.DataFrame:
    sides = zip(zip(a["lat"], a["lon"], a["weight"]), zip(b["lat"], b["lon"], b["weight"]), itself)
    out = [block_sums(lambda p, q: great_circle_tile(*p, *q), p[:2], q[:2], p[2], q[2], bool(same)) for p, q, same in sides]
    return pd.DataFrame(out, columns=["total_a", "n_a", "total_b", "n_b"])


def block_sums(distances: Callable, p: Sequence[np.ndarray], q: Sequence[np.ndarray], weight_a, weight_b, itself: bool) -> tuple:
    """:func:`row_sums` of the ``distances`` of two tiles, a block of each at a time."""
    total_a, n_a = np.zeros(len(weight_a)), np.zeros(len(weight_a))
    total_b, n_b = (np.zeros(0 if itself else len(weight_b)) for _ in range(2))
    for i in range(0, len(weight_a), TILE_ROWS):
        for j in range(0, len(weight_b), TILE_ROWS):
            at, to = slice(i, i + TILE_ROWS), slice(j, j + TILE_ROWS)
            distance = distances([c[at] for c in p], [c[to] for c in q])
            sums = row_sums(distance, weight_a[at], weight_b[to], itself)
            total_a[at] += sums[0]
            n_a[at] += sums[1]
            if not itself:
                total_b[to] += sums[2]
                n_b[to] += sums[3]
    return total_a, n_a, total_b, n_b


def gather_sums(pairs: DataFrame, group: Sequence[str], id_col: str, sums: Column) -> DataFrame:
    """Add the partial sums of every tile pair up to one (total, n) per row id."""
    done = pairs.select(*group, F.col(f"a.{id_col}").alias("_ids_a"), F.col(f"b.{id_col}").alias("_ids_b"), sums.alias("_s"))
    zipped = [
        F.transform(
            F.arrays_zip(F.col(f"_ids_{s}").alias("id"), F.col(f"_s.total_{s}").alias("total"), F.col(f"_s.n_{s}").alias("n")),
            lambda z: F.struct(z["id"].alias("id"), z["total"].alias("total"), z["n"].alias("n")),
        )
        for s in "ab"
    ]
    flat = done.select(*group, F.explode(F.concat(*zipped)).alias("_z")).filter("_z.total is not null")
    return flat.groupBy(*group, F.col("_z.id").alias(id_col)).agg(
        F.sum("_z.total").alias("total"), F.sum("_z.n").alias("n")
    )


def great_circle_sums(points: DataFrame, group: Sequence[str], tile_rows: int = DISTANCE_ROWS) -> DataFrame:
    """Per distinct point of a group: summed distance to all rows of the group.

    ``points`` has the group columns, ``point``, ``lat``, ``lon`` and ``weight`` (rows at that point).
    """
    pairs = tile_pairs(points, group, "point", ["lat", "lon", "weight"], tile_rows)
    sums = _great_circle_sums("a", "b", F.col("i") == F.col("j"))
    return gather_sums(pairs, group, "point", sums)
