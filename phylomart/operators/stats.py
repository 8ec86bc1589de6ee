"""Distances, correlation tests and regression frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from phylomart.functions.student import two_sided_p
from phylomart.operators.pairwise import (
    PAIR_SUMS,
    TILE_ROWS,
    block_sums,
    gather_sums,
    gower_tile,
    patristic_tile,
    tile_pairs,
    tile_rows_for,
)
from phylomart.operators.permuted import Level, Permuted, Tips, drawn_order, joined, level
from phylomart.operators.subsets import subset_sums
from phylomart.runtime import BROADCAST_BYTES, cut_lineage, lookup_side, measured, null_safe, with_position

# Patterns of present traits up to which distances come from prefix sums, and those that one pass sums up.
PATTERNS = 64
PATTERNS_A_PASS = 8
MASK_BITS = 60
# Pairs in tiles that cost as much as an item's row for a subset of its traits, and items with one trait that one task takes.
ROW_PAIRS = 2
TRAIT_ITEMS = 1 << 21
# Tiles of items beyond which permutations are reduced by sums over the nodes of the tree; below, pairs cost less than its rounds.
NODE_TILES = 8


def regress_origin(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares through the origin: slope, standard error, t, R squared, df and the two-sided p-value in one aggregate.

    Without degrees of freedom, or with a null t, the p-value is null.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
    )
    slope = F.try_divide("sxy", "sxx")
    residual = F.col("syy") - slope * F.col("sxy")
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 1), F.col("sxx")))
    fit = sums.select(
        slope.alias("slope"),
        error.alias("std_error"),
        F.try_divide(slope, error).alias("t_value"),
        F.try_divide(slope * F.col("sxy"), F.col("syy")).alias("r_squared"),
        (F.col("n") - 1).alias("df"),
    )
    return fit.select("*", two_sided_p(F.col("t_value"), F.col("df")).alias("p_value"))


def scaled_traits(wide: DataFrame, item: str, traits: Sequence[str]) -> DataFrame:
    """Traits divided by their range; missing values and traits without a range become NaN."""
    spans = wide.agg(*[(F.max(t) - F.min(t)).cast("double").alias(t) for t in traits]).first()
    columns: list[Column] = []
    for t in traits:
        span = spans[t]
        scaled = F.col(t).cast("double") / F.lit(span) if span else F.lit(None).cast("double")
        columns.append(F.coalesce(scaled, F.lit(float("nan"))).alias(t))
    return wide.select(item, *columns)


def gower_distance(wide: DataFrame, item: str, traits: Sequence[str]) -> DataFrame:
    """Gower distances of every item to all others, reduced per item.

    Returns (item, defined_pairs, undefined_pairs, total_distance, mean_distance). A pair's distance
    is the mean over shared traits of the range-scaled gap, undefined when no trait is shared.

    Any number of traits may be given. Items with the same traits present share a pattern, and the divisor of a pair depends on
    the two patterns alone. With few patterns no pair is formed, see :func:`_gower_by_patterns`. With more than
    ``PATTERNS``, no pair is formed either where items have few traits each, so that their subsets of traits are counted to be fewer than the
    pairs, see :func:`_gower_by_subsets`; otherwise pairs are reduced tile by tile. Items must be distinct.
    """
    traits = list(traits)
    # read for the ranges and for the rows
    scaled = scaled_traits(cut_lineage(wide.select(item, *traits)), item, traits)
    words = [traits[i : i + MASK_BITS] for i in range(0, len(traits), MASK_BITS)]
    bits = [[F.when(F.isnan(t), 0).otherwise(1 << i).cast("long") for i, t in enumerate(word)] for word in words]
    masks = [F.aggregate(F.array(*word), F.lit(0).cast("long"), lambda x, b: x + b) for word in bits]
    scaled = cut_lineage(scaled.withColumn("_has", F.array(*masks) if masks else F.array().cast("array<bigint>")))
    patterns = lookup_side(scaled.groupBy("_has").agg(F.count("*").alias("n")))
    items = scaled.agg(F.count("*").alias("n")).first()["n"]
    if patterns.count() <= PATTERNS:
        sums = _gower_by_patterns(scaled, item, traits, patterns)
    elif _few_subsets(scaled, traits, items):
        sums = _gower_by_subsets(scaled, item, traits)
    else:
        sums = _gower_by_tiles(scaled, item, traits)
    total = F.when(F.col("n") > 0, F.greatest("total", F.lit(0.0))).otherwise(0.0)
    return sums.select(
        item,
        F.col("n").alias("defined_pairs"),
        (F.lit(items - 1) - F.col("n")).cast("long").alias("undefined_pairs"),
        total.alias("total_distance"),
        F.when(F.col("n") > 0, total / F.col("n")).alias("mean_distance"),
    )


def _few_subsets(scaled: DataFrame, traits: Sequence[str], items: int) -> bool:
    """Whether the subsets of traits that items have cost less than the pairs, and the items with one trait fit a task."""
    if len(traits) > MASK_BITS:
        return False
    size = F.bit_count(F.col("_has")[0]).cast("double")
    with_trait = [F.count_if(~F.isnan(t)) for t in traits]
    found = scaled.agg(F.sum(size * F.pow(F.lit(2.0), size - 1)).alias("rows"), F.greatest(*with_trait, F.lit(0)).alias("most")).first()
    return found["rows"] * ROW_PAIRS <= items * items / 2 and found["most"] <= TRAIT_ITEMS


def _gower_by_subsets(scaled: DataFrame, item: str, traits: Sequence[str]) -> DataFrame:
    """(item, n, total) over all other items, from running sums over the items that have a subset of the traits, see :mod:`phylomart.operators.subsets`.

    A unit of work is a trait with a part of the subsets of the others.
    """
    parts = max(1, min(16, -(-10 * scaled.sparkSession.sparkContext.defaultParallelism // len(traits))))
    values = scaled.select(F.col(item).alias("_item"), F.col("_has")[0].alias("_mask"), F.posexplode(F.array(*traits)).alias("_trait", "_x")).filter(~F.isnan("_x"))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    # each unit has a task of its own
    units = values.select("*", each).repartitionById(len(traits) * parts, F.col("_trait") * parts + F.col("_part"))

    def reduce_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(some) if (some := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        trait, part = rows["_trait"][0].as_py(), rows["_part"][0].as_py()
        x = rows["_x"].to_numpy()
        order = np.argsort(x, kind="stable")
        total, met = subset_sums(x[order], rows["_mask"].to_numpy()[order] & ~(1 << trait), part, parts)
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        sums = pa.table({"_item": rows["_item"], "_total": total[at], "_met": met[at]})
        yield from sums.to_batches(max_chunksize=65_536)

    schema = StructType([StructField("_item", scaled.schema[item].dataType), StructField("_total", DoubleType()), StructField("_met", DoubleType())])
    sums = units.mapInArrow(reduce_unit, schema).groupBy("_item").agg(F.sum("_total").alias("total"), F.round(F.sum("_met")).cast("long").alias("n"))
    # an item without a trait meets nobody
    return scaled.select(item).join(sums, F.col(item) == F.col("_item"), "left").select(item, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def _gower_by_tiles(scaled: DataFrame, item: str, traits: Sequence[str]) -> DataFrame:
    """(item, n, total) over all other items, each pair of tiles a unit of work."""

    @F.pandas_udf(PAIR_SUMS)
    def reduce_tile(a: pd.DataFrame, b: pd.DataFrame, itself: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, same in zip(zip(*[a[c] for c in traits]), zip(*[b[c] for c in traits]), itself):
            out.append(block_sums(gower_tile, p, q, np.ones(len(p[0])), np.ones(len(q[0])), bool(same)))
        return pd.DataFrame(out, columns=["total_a", "n_a", "total_b", "n_b"])

    pairs = tile_pairs(scaled, [], item, traits, tile_rows_for(scaled.count(), len(traits)))
    sums = gather_sums(pairs, [], item, reduce_tile("a", "b", F.col("i") == F.col("j")))
    # an item with a trait has met itself
    own = F.when(F.exists("_has", lambda m: m != 0), 1).otherwise(0)
    joined = scaled.select(item, own.alias("_own")).join(sums, item, "left")
    return joined.select(item, (F.coalesce("n", F.lit(0.0)).cast("long") - F.col("_own")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def _shared(pattern: Sequence[int]) -> Column:
    """How many traits of ``pattern`` the row's own pattern has."""
    return sum((F.bit_count(F.col("_has")[k].bitwiseAND(F.lit(mask).cast("long"))) for k, mask in enumerate(pattern)), F.lit(0))


def _gower_by_patterns(scaled: DataFrame, item: str, traits: Sequence[str], patterns: DataFrame) -> DataFrame:
    """(item, n, total) over all other items, from prefix sums.

    In the order of a trait's values, the gaps of an item to all items of a pattern follow from their count and sum below it. Both are
    prefix sums over range partitions, for a few patterns a pass.
    """
    # at most PATTERNS rows
    sizes = {tuple(r["_has"]): r["n"] for r in patterns.collect()}
    values = scaled.select(item, "_has", F.posexplode(F.array(*traits)).alias("_trait", "_x")).filter(~F.isnan("_x"))
    order = ["_trait", "_x", item]
    slots = values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    slots = cut_lineage(slots).withColumn("_part", F.shiftright("_slot", 33))
    upto = Window.partitionBy("_part", "_trait").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_trait").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_trait")
    known, passes = list(sizes), []
    for start in range(0, len(known), PATTERNS_A_PASS):
        some = known[start : start + PATTERNS_A_PASS]

        def sums_of(over=lambda c: c, some=some) -> list[Column]:
            out = []
            for i, p in enumerate(some):
                own = F.col("_has") == F.array(*[F.lit(m).cast("long") for m in p])
                out += [over(F.sum(F.when(own, 1).otherwise(0))).alias(f"_n{i}"), over(F.sum(F.when(own, F.col("_x")).otherwise(0.0))).alias(f"_s{i}")]
            return out

        # one row per partition and trait
        parts = slots.groupBy("_part", "_trait").agg(*sums_of())
        columns = [c for i in range(len(some)) for c in (f"_n{i}", f"_s{i}")]
        offsets = cut_lineage(
            parts.select(
                "_part",
                "_trait",
                *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns],
                *[F.sum(c).over(every).alias(f"{c}_all") for c in columns],
            )
        )
        running = slots.select(item, "_part", "_trait", "_x", "_has", *sums_of(lambda c: c.over(upto)))
        joined = running.join(measured(offsets, offsets.count(), 512), ["_part", "_trait"])
        gaps = F.lit(0.0)
        for i, p in enumerate(some):
            below_n, below_s = F.col(f"_n{i}") + F.col(f"_n{i}_before"), F.col(f"_s{i}") + F.col(f"_s{i}_before")
            gap = F.col("_x") * (2 * below_n - F.col(f"_n{i}_all")) + F.col(f"_s{i}_all") - 2 * below_s
            gaps = gaps + F.when(_shared(p) > 0, gap / _shared(p)).otherwise(0.0)
        passes.append(joined.select(item, gaps.alias("_gap")))
    none = scaled.select(item, F.lit(0.0).alias("_gap")).limit(0)
    gathered = none
    for one in passes:
        gathered = gathered.unionByName(cut_lineage(one.groupBy(item).agg(F.sum("_gap").alias("_gap"))))
    totals = gathered.groupBy(item).agg(F.sum("_gap").alias("total"))
    met = F.lit(0).cast("long")
    for p, size in sizes.items():
        met = met + F.when(_shared(p) > 0, F.lit(size)).otherwise(0)
    # an item with a trait meets itself
    own = F.when(F.exists("_has", lambda m: m != 0), 1).otherwise(0)
    return scaled.select(item, (met - own).alias("n")).join(totals, item, "left")


def complete_cases(dist: DataFrame) -> DataFrame:
    """Items none of whose pairwise distances is undefined, from :func:`gower_distance`."""
    return dist.filter(F.col("undefined_pairs") == 0)


def permuted_labels(items: DataFrame, item: str, permutations: int, seed: int = 0) -> DataFrame:
    """(perm, item, other): for each permutation a seeded one-to-one relabelling; perm 0 is identity.

    The item in place r takes the label of the item whose md5 draw has rank r. Ranks come from one
    distributed numbering of all permutations at once.
    """
    base = cut_lineage(with_position(items.select(item), [item], "_place", stored=True))
    n = base.count()
    perms = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    drawn = base.select(F.col(item).alias("other"), perms) if permutations else None
    identity = base.select(F.lit(0).alias("perm"), item, F.col(item).alias("other"))
    if drawn is None:
        return identity
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("other").cast("string")))
    ranked = with_position(drawn.withColumn("_draw", key), ["perm", "_draw", "other"], "_rank", stored=True)
    placed = ranked.withColumn("_place", F.col("_rank") - (F.col("perm") - 1) * n).select("perm", "_place", "other")
    return identity.unionByName(placed.join(base, "_place").select("perm", item, "other"))


def mantel_test(
    items: DataFrame,
    item: str,
    traits: Sequence[str],
    paths: DataFrame,
    permutations: int = 99,
    seed: int = 0,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Correlation of Gower trait distances with path lengths in a tree, with a permutation p-value.

    ``items`` holds ``item`` and the traits; ``paths`` holds ``item`` with the root-first ``path``
    and ``depths`` of its tip. In a permutation items keep their traits and take another item's place in the tree.
    See :func:`permutation_correlations`. Returns (r, p_value, permutations, n_pairs).
    """
    rows = permutation_correlations(items, item, traits, paths, permutations, seed, tile_rows)
    observed = F.max(F.when(F.col("perm") == 0, F.col("r")))
    beaten = rows.agg(observed.alias("r"), F.max(F.when(F.col("perm") == 0, F.col("n_pairs"))).alias("n_pairs"))
    seen = rows.filter("perm > 0").select(F.col("r").alias("_r"))
    best = beaten.first()
    count = F.sum(F.when(F.col("_r") >= F.lit(best["r"]) - 1e-12, 1).otherwise(0))
    return seen.agg(F.coalesce(count, F.lit(0)).alias("_c")).select(
        F.lit(best["r"]).cast("double").alias("r"),
        ((F.col("_c") + 1) / (permutations + 1)).alias("p_value"),
        F.lit(permutations).cast("long").alias("permutations"),
        F.lit(best["n_pairs"]).cast("long").alias("n_pairs"),
    )


MOMENTS = ["n", "x", "y", "xx", "yy", "xy"]


def permutation_correlations(
    items: DataFrame,
    item: str,
    traits: Sequence[str],
    paths: DataFrame,
    permutations: int,
    seed: int = 0,
    tile_rows: int = TILE_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(perm, r, n_pairs) for the observed labelling (perm 0) and every permutation.

    All permutations are reduced in one pass over the pairs of tiles: a tile pair's trait distances are worked out once, and the
    places that items take in the tree are looked up by number. The places and a range-minimum table of the tree, some
    12 bytes for each item and permutation, are broadcast where the counted items prove them within ``broadcast_bytes`` (52,000 items
    at 99 permutations). Beyond that each permutation deals its own tiles with the paths in them.

    More than ``NODE_TILES`` tiles of items in one tree with few patterns of present traits need no pairs for a permutation: where the counted items and nodes prove
    an array of all tips within ``broadcast_bytes``, a permutation is a unit of work over it, see :func:`_moments_by_permutation`, otherwise see :func:`_moments_by_nodes`.
    """
    traits = list(traits)
    both = cut_lineage(items.select(item, *traits).join(paths.select(item), item, "left_semi"))
    tips = paths.select(item, "path", "depths").join(both.select(item), item, "left_semi")
    scaled = scaled_traits(both, item, traits)
    n = both.count()
    fits = 0 < n * (12 * (permutations + 1) + 4 * n.bit_length() + 24) <= broadcast_bytes
    moments, held = _moments_in_one_pass if fits else _moments_by_tiles, None
    if n > NODE_TILES * tile_rows and len(traits) <= MASK_BITS and tips.select(F.element_at("path", 1)).distinct().limit(2).count() == 1:
        bits = F.array(*[F.when(F.isnan(t), 0).otherwise(1 << k).cast("long") for k, t in enumerate(traits)])
        scaled = cut_lineage(scaled.withColumn("_has", F.aggregate(bits, F.lit(0).cast("long"), lambda x, b: x + b)))
        if scaled.select("_has").distinct().limit(PATTERNS_A_PASS + 1).count() <= PATTERNS_A_PASS:
            moments, tips = _moments_by_nodes, cut_lineage(tips)
            held = _numbered_tips(scaled, tips, item, traits, n, broadcast_bytes)
    if held is None:
        rows = moments(scaled, tips, permuted_labels(both, item, permutations, seed), item, traits, permutations, tile_rows)
    else:
        rows = _moments_by_permutation(both.sparkSession, held, permutations, seed)
    total = rows.groupBy("perm").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    c = {m: F.col(m) for m in MOMENTS}
    top = c["n"] * c["xy"] - c["x"] * c["y"]
    bottom = F.sqrt((c["n"] * c["xx"] - c["x"] * c["x"]) * (c["n"] * c["yy"] - c["y"] * c["y"]))
    return cut_lineage(total.select("perm", F.try_divide(top, bottom).alias("r"), c["n"].cast("long").alias("n_pairs")))


def _sums(x: np.ndarray, y: np.ndarray, same: bool) -> tuple:
    """Moments over the pairs of two distance blocks that both define, each pair of a tile with itself once."""
    use = ~(np.isnan(x) | np.isnan(y))
    if same:
        use &= np.triu(np.ones_like(use), 1)
    x, y = x[use], y[use]
    return float(x.size), x.sum(), y.sum(), x @ x, y @ y, x @ y


def _moments_by_tiles(scaled, tips, labels, item, traits, permutations, tile_rows) -> DataFrame:
    rows = labels.join(scaled, item).join(tips.select(F.col(item).alias("other"), "path", "depths"), "other")
    columns = [*traits, "path", "depths"]
    pairs = tile_pairs(cut_lineage(rows.drop("other")), ["perm"], item, columns, tile_rows)

    @F.pandas_udf(StructType([StructField(m, DoubleType()) for m in MOMENTS]))
    def reduce_tile(a: pd.DataFrame, b: pd.DataFrame, itself: pd.Series) -> pd.DataFrame:
        sides = zip(zip(*[a[c] for c in columns]), zip(*[b[c] for c in columns]), itself)
        out = [_sums(gower_tile(p[:-2], q[:-2]), patristic_tile(p[-2], p[-1], q[-2], q[-1]), same) for p, q, same in sides]
        return pd.DataFrame(out, columns=MOMENTS)

    return pairs.select("perm", reduce_tile("a", "b", F.col("i") == F.col("j")).alias("m")).select("perm", "m.*")


def _moments_in_one_pass(scaled, tips, labels, item, traits, permutations, tile_rows) -> DataFrame:
    # tips in the order of their paths: what two of them share is the least that neighbours between them share
    ordered = cut_lineage(with_position(tips, ["path", item], "_at"))
    following = ordered.select((F.col("_at") - 1).alias("_at"), F.col("path").alias("_next"))
    differs = F.array_position(F.zip_with("path", "_next", lambda p, q: p.eqNullSafe(q)), False)
    shared = F.when(differs == 0, F.size("path")).otherwise(differs - 1).cast("int")
    tree = (
        ordered.join(following, "_at", "left")
        .select("_at", F.element_at("depths", -1).alias("end"), shared.alias("shared"), F.get("depths", shared - 1).alias("depth"))
        .toPandas()
        .sort_values("_at")
    )
    at = ordered.select(item, F.col("_at").cast("int").alias("_at"))
    taken = labels.join(at.withColumnRenamed("_at", "_from"), item).join(at.select(F.col(item).alias("other"), F.col("_at").alias("_to")), "other")
    moves = taken.select("perm", "_from", "_to").toPandas()
    place = np.zeros((permutations + 1, len(tree)), dtype=np.int32)
    place[moves["perm"], moves["_from"] - 1] = moves["_to"] - 1
    context = scaled.sparkSession.sparkContext
    held = context.broadcast((place, *shared_path_table(tree["end"], tree["shared"][:-1], tree["depth"][:-1])))
    rows = cut_lineage(scaled.join(at, item).drop(item))
    tiles = -(-len(tree) // tile_rows)
    pairs = tile_pairs(rows, [], "_at", traits, tile_rows).repartition(min(tiles * (tiles + 1) // 2, 10_000), "i", "j")

    @F.pandas_udf(StructType([StructField(m, ArrayType(DoubleType())) for m in MOMENTS]))
    def reduce_tile(a: pd.DataFrame, b: pd.DataFrame, itself: pd.Series) -> pd.DataFrame:
        places, *table = held.value
        out = []
        for p, q, same in zip(zip(a["_at"], *[a[t] for t in traits]), zip(b["_at"], *[b[t] for t in traits]), itself):
            x = gower_tile(p[1:], q[1:])
            sums = [_sums(x, path_lengths(taken[p[0] - 1], taken[q[0] - 1], *table), same) for taken in places]
            out.append([np.array(m) for m in zip(*sums)])
        return pd.DataFrame(out, columns=MOMENTS)

    sums = pairs.select(reduce_tile("a", "b", F.col("i") == F.col("j")).alias("m"))
    zipped = F.arrays_zip(*[F.col(f"m.{m}").alias(m) for m in MOMENTS])
    return sums.select(F.posexplode(zipped).alias("perm", "m")).select("perm", *[F.col(f"m.{m}").alias(m) for m in MOMENTS])


def _numbered_tips(scaled, tips, item, traits, n, broadcast_bytes) -> Tips | None:
    """All tips of one tree as arrays, or None where the counted tips and nodes do not prove them within ``broadcast_bytes``."""
    steps = tips.select(F.col("depths").alias("_all"), F.posexplode(F.arrays_zip("path", "depths")).alias("pos", "v"))
    above = F.when(F.col("pos") > 0, F.get("_all", F.col("pos") - 1)).otherwise(0.0)
    steps = steps.select("pos", F.col("v.path").alias("node"), F.col("v.depths").alias("deep"), above.alias("above"))
    nodes = steps.groupBy("pos", "node").agg(F.count("*").alias("tips"), F.max("deep").alias("deep"), F.max("above").alias("above"))
    nodes = cut_lineage(nodes.filter("tips > 1"))
    parting = nodes.filter(F.col("tips") < n)
    # one row, whatever the depth of the tree
    size = parting.agg(F.count_distinct("pos").alias("levels"), F.count("*").alias("nodes")).first()
    if n * (24 + 8 * len(traits) + 8 * size["levels"]) + 28 * size["nodes"] > broadcast_bytes:
        return None
    at = sorted(r["pos"] for r in parting.select("pos").distinct().collect())
    values = tips.select(item, F.element_at("depths", -1).alias("_end"), *[F.get("path", F.lit(k)).alias(f"_at{k}") for k in at])
    text = F.col(item).cast("string").cast("binary").alias("_text")
    rows = scaled.join(values, item).sort(item).select(text, "_end", *[F.col(t).alias(f"_x{k}") for k, t in enumerate(traits)], *[f"_at{k}" for k in at]).toArrow()
    found = parting.select("pos", "node", "deep", "above").toArrow()
    own = {c: found[c].to_numpy() for c in found.column_names}
    levels = []
    for k in at:
        here, node = own["pos"] == k, rows[f"_at{k}"]
        levels.append(level(node.fill_null(0).to_numpy(), node.is_null().to_numpy(), *[own[c][here] for c in ("node", "deep", "above")]))
    d, deep, up = F.col("deep") - F.col("above"), F.col("deep"), F.col("above")
    top = nodes.filter(F.col("tips") == n).agg(F.sum(d).alias("d"), F.sum(deep * deep - up * up).alias("dd")).first()
    return Tips(
        rows["_text"].combine_chunks(),
        [rows[f"_x{k}"].to_numpy() for k in range(len(traits))],
        rows["_end"].to_numpy(),
        joined(levels),
        (top["d"] or 0.0, top["dd"] or 0.0),
    )


def _moments_by_permutation(spark, tips: Tips, permutations, seed) -> DataFrame:
    """Moments of tips of one tree, a permutation a unit of work; a unit with two traits gives their part of the squared trait distances to all permutations."""
    # plain arrays: workers that lack the package load a broadcast before the function that brings it
    held = spark.sparkContext.broadcast((tips.text, tips.traits, tips.end, [(one.node, one.d, one.dd) for one in tips.levels], tips.top))
    pairs = [(t, u) for t in range(len(tips.traits)) for u in range(t + 1)]
    units = permutations + 1 + len(pairs)

    def reduce_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, x, end, levels, top = held.value
        some = Permuted(Tips(text, x, end, [Level(*one) for one in levels], top))
        gaps = some.gap_totals()
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                if unit > permutations:
                    row = [None, 0.0, 0.0, 0.0, some.squares(*pairs[unit - permutations - 1]), 0.0, 0.0]
                else:
                    n, sx, sy, yy, xy = some.moments(drawn_order(text, seed, unit), gaps)
                    row = [unit, n, sx, sy, 0.0, yy, xy]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.float64()] * len(MOMENTS)])], ["perm", *MOMENTS])

    schema = ", ".join(["perm int", *[f"{m} double" for m in MOMENTS]])
    tasks = min(units, 3 * spark.sparkContext.defaultParallelism)
    found = cut_lineage(spark.range(0, units, 1, 1).repartition(tasks).mapInArrow(reduce_units, schema))
    squares = found.filter("perm is null").agg(F.sum("xx")).first()[0] or 0.0
    return found.filter("perm is not null").withColumn("xx", F.lit(squares))


def _moments_by_nodes(scaled, tips, labels, item, traits, permutations, tile_rows) -> DataFrame:
    """Moments of tips of one tree from sums over the tips below each node.

    The depth that two tips share is the sum of the branch lengths above both, so a moment with it is a sum over nodes of sums over the pairs below them.
    Those of trait gaps are running sums in the order of a trait, by range partitions, for each pattern of present traits. Only
    the squares of trait distances, which no permutation changes, are reduced tile by tile, once.
    """
    known = [r["_has"] for r in scaled.select("_has").distinct().collect() if r["_has"]]
    weight = [[1 / (p & q).bit_count() if p & q else 0.0 for q in known] for p in known]
    at = F.posexplode(F.arrays_zip("path", "depths"))
    steps = tips.select(item, F.col("depths").alias("_all"), at.alias("pos", "v"))
    above = F.when(F.col("pos") > 0, F.get("_all", F.col("pos") - 1)).otherwise(0.0)
    steps = cut_lineage(steps.select(F.col(item).alias("other"), F.element_at("_all", -1).alias("e"), F.col("v.path").alias("node"), F.col("v.depths").alias("deep"), above.alias("above")))
    nodes = steps.groupBy("node").agg(F.count("*").alias("tips"), F.min("other").alias("low"), F.max("deep").alias("deep"), F.max("above").alias("above")).filter("tips > 1")
    # nodes with the same tips below them, a chain, count as one
    name = Window.partitionBy("low", "tips")
    nodes = cut_lineage(nodes.withColumn("set", F.min("node").over(name)))
    sets = nodes.groupBy("set").agg(F.max("tips").alias("tips"), F.sum(F.col("deep") - F.col("above")).alias("d"), F.sum(F.col("deep") * F.col("deep") - F.col("above") * F.col("above")).alias("dd"))
    members = cut_lineage(steps.join(nodes.select("node", "set"), "node").select("other", "e", "set").distinct())
    own = F.array_position(F.array(*[F.lit(m).cast("long") for m in known]), F.col("_has")).cast("int").alias("p")
    rows = labels.join(scaled.filter("_has > 0"), item).join(members, "other").select("perm", "set", item, "e", own, *traits)
    rows = cut_lineage(rows)

    # counts and sums of depths by pattern give the moments without traits
    mine = [F.col("p") == k + 1 for k in range(len(known))]
    e = F.col("e")
    sums = [F.sum(F.when(m, value).otherwise(0.0)).alias(f"{c}{k}") for k, m in enumerate(mine) for c, value in (("c", F.lit(1.0)), ("e", e), ("q", e * e))]
    ends = rows.groupBy("perm", "set").agg(*sums)
    n, one, two = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i, p in enumerate(known):
        c, s, q = (F.col(f"{x}{i}") for x in "ceq")
        n, one, two = n + c * (c - 1) / 2, one + (c - 1) * s, two + (c - 2) * q + s * s
        for j in range(i):
            if p & known[j]:
                c2, s2, q2 = (F.col(f"{x}{j}") for x in "ceq")
                n, one, two = n + c * c2, one + c2 * s + c * s2, two + c2 * q + c * q2 + 2 * s * s2
    ends = ends.select("perm", "set", n.alias("n"), one.alias("e1"), two.alias("e2"))

    group = ["perm", "set", "trait"]
    values = rows.select("perm", "set", item, "e", "p", F.posexplode(F.array(*traits)).alias("trait", "x")).filter(~F.isnan("x"))
    order = [*group, "x", item]
    slots = cut_lineage(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id()).drop(item))
    slots = slots.withColumn("_part", F.shiftright("_slot", 33))
    parts = {f"{c}{k}": F.sum(F.when(m, value).otherwise(0.0)) for k, m in enumerate(mine) for c, value in (("c", F.lit(1.0)), ("a", F.col("x")), ("s", e), ("as", e * F.col("x")))}
    upto = Window.partitionBy("_part", *group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = slots.groupBy("_part", *group).agg(*[v.alias(k) for k, v in parts.items()])
    # only the first group of a partition began before it
    offsets = by_part.select("_part", *group, *[F.sum(k).over(before).alias(f"_{k}") for k in parts]).filter("_c0 is not null")
    offsets = cut_lineage(offsets)
    running = slots.select("_part", *group, "x", "e", "p", *[v.over(upto).alias(k) for k, v in parts.items()])
    joined = running.join(F.broadcast(offsets), ["_part", *group], "left")
    gap, with_e = F.lit(0.0), F.lit(0.0)
    for k in range(len(known)):
        c, a, s, both = (F.col(f"{x}{k}") + F.coalesce(f"_{x}{k}", F.lit(0.0)) for x in ("c", "a", "s", "as"))
        w = F.element_at(F.array(*[F.lit(weight[p][k]) for p in range(len(known))]), F.col("p"))
        below = F.col("x") * c - a
        gap, with_e = gap + w * below, with_e + w * (below * e + F.col("x") * s - both)
    gaps = joined.groupBy("perm", "set").agg(F.sum(gap).alias("x"), F.sum(with_e).alias("xe"))

    squares = _square_sum(scaled.filter("_has > 0").drop("_has"), item, traits)
    top = F.when(F.col("tips") == sets.agg(F.max("tips")).first()[0], 1.0).otherwise(0.0)
    d, dd = F.col("d"), F.col("dd")
    placed = ends.join(gaps, ["perm", "set"], "left").join(sets, "set").withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("xe", F.coalesce("xe", F.lit(0.0)))
    return placed.groupBy("perm").agg(
        F.sum(top * F.col("n")).alias("n"),
        F.sum(top * F.col("x")).alias("x"),
        F.sum(top * F.col("e1") - 2 * d * F.col("n")).alias("y"),
        F.lit(squares).alias("xx"),
        F.sum(top * F.col("e2") - 4 * d * F.col("e1") + 4 * dd * F.col("n")).alias("yy"),
        F.sum(top * F.col("xe") - 2 * d * F.col("x")).alias("xy"),
    )


def _square_sum(scaled: DataFrame, item: str, traits: Sequence[str]) -> float:
    """The sum of the squared Gower distances over all pairs."""

    @F.pandas_udf(DoubleType())
    def reduce_tile(a: pd.DataFrame, b: pd.DataFrame, itself: pd.Series) -> pd.Series:
        out = []
        for p, q, same in zip(zip(*[a[t] for t in traits]), zip(*[b[t] for t in traits]), itself):
            total = 0.0
            for i in range(0, len(p[0]), TILE_ROWS):
                for j in range(0, len(q[0]), TILE_ROWS):
                    found = np.nan_to_num(gower_tile([c[i : i + TILE_ROWS] for c in p], [c[j : j + TILE_ROWS] for c in q])).ravel()
                    total += float(found @ found)
            out.append(total / 2 if same else total)
        return pd.Series(out)

    rows = cut_lineage(scaled)
    pairs = tile_pairs(rows, [], item, traits, tile_rows_for(rows.count(), len(traits)))
    return pairs.select(reduce_tile("a", "b", F.col("i") == F.col("j")).alias("s")).agg(F.sum("s")).first()[0] or 0.0


def shared_path_table(end: Sequence[float], shared: Sequence[int], depth: Sequence[float]) -> tuple[np.ndarray, ...]:
    """A range-minimum table over tips in path order, for :func:`path_lengths`.

    ``end`` has the depth of each tip; ``shared`` and ``depth`` how many nodes it shares with the next one and the depth of the last of them. Tips are ranked
    by ``shared``, and row k of the table has for each the least rank among the 2**k from it on. Equal ``shared`` within such a range mean
    the same node, so any order of them does.
    """
    order = np.argsort(np.asarray(shared, dtype=float), kind="stable")
    last = np.empty(len(order), dtype=np.int32)
    last[order] = np.arange(len(order), dtype=np.int32)
    table = np.zeros((max(1, len(order).bit_length()), max(1, len(order))), dtype=np.int32)
    for k, row in enumerate(table):
        row[: len(last)] = last
        last = np.minimum(last[: -(1 << k)], last[1 << k :])
    by_rank = np.asarray(depth, dtype=float)[order] if len(order) else np.array([np.nan])
    return np.asarray(end, dtype=float), by_rank, table


def path_lengths(a: np.ndarray, b: np.ndarray, end: np.ndarray, by_rank: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Path lengths between the tips at places ``a`` and ``b`` of the table; NaN across trees, and 0 from a tip to itself."""
    width = table.shape[1]
    a, b = np.asarray(a, dtype=np.int64)[:, None], np.asarray(b, dtype=np.int64)[None, :]
    low, gap = np.minimum(a, b), np.abs(a - b)
    # the highest power of two in each distance
    power = (np.frexp(np.maximum(np.arange(width + 1), 1))[1] - 1).astype(np.int64)[gap]
    row = power * width
    flat = table.ravel()
    rank = np.minimum(flat[row + np.minimum(low, width - 1)], flat[row + np.maximum(low + gap - (1 << power), 0)])
    return np.where(gap == 0, 0.0, end[a] + end[b] - 2 * by_rank[rank])


def matrix_correlation(d1: DataFrame, d2: DataFrame, keys: Sequence[str] = ("a", "b"), value: str = "distance") -> DataFrame:
    """Correlation of two stored distance tables over the pairs both define."""
    left = d1.select(*keys, F.col(value).alias("_x")).filter("_x is not null").alias("l")
    right = d2.select(*keys, F.col(value).alias("_y")).filter("_y is not null").alias("r")
    return left.join(right, null_safe("l", "r", list(keys))).agg(
        F.corr("_x", "_y").alias("r"), F.count("*").alias("n_pairs")
    )


def model_frame(wide: DataFrame, tips: DataFrame, response: str, key: str = "label") -> DataFrame:
    """Rows matched to tree tips: key, ``response`` and the other columns as a ``predictors`` array."""
    predictors = [c for c in wide.columns if c not in (key, response)]
    matched = wide.join(tips.select(key).distinct(), key, "left_semi")
    return matched.select(
        key, F.col(response).alias("response"), F.array(*[F.col(c).cast("double") for c in predictors]).alias("predictors")
    )
