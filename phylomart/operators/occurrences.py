"""Occurrence filters. Every rule works on all species at once, with the species as a key column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylomart.operators.pairwise import DISTANCE_ROWS, great_circle_sums
from phylomart.operators.ranges import MAX_EDGES, places_inside, range_cover
from phylomart.runtime import cut_lineage, lookup_side, measured


def distinct_labels(df: DataFrame, col: str = "label") -> DataFrame:
    """Distinct values of ``col`` in order."""
    return df.select(col).distinct().orderBy(col)


def distinct_coordinates(
    occ: DataFrame, group: str = "taxon_name", lat: str = "decimal_latitude", lon: str = "decimal_longitude"
) -> DataFrame:
    """One record per place and species: the one with the lowest occurrence_id.

    A partial ``min`` before the shuffle leaves one row per place and task, so a place that holds a
    third of all records is no hot spot.
    """
    keys = [group, lat, lon]
    rest = [c for c in occ.columns if c not in keys and c != "occurrence_id"]
    first = occ.groupBy(*keys).agg(F.min(F.struct("occurrence_id", *rest)).alias("_first"))
    return first.select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in occ.columns])


def min_records_gate(df: DataFrame, group: str = "taxon_name", n: int = 10, bounded: bool = False) -> DataFrame:
    """Keep groups of at least ``n`` rows: pre-aggregated counts, then a semi-join.

    Where no group is larger than a sample (``bounded``) the rows are counted by a window, so ``df`` is evaluated once only.
    """
    if bounded:
        counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
        return counted.filter((F.col("_n") >= n) & F.col(group).isNotNull()).drop("_n")
    enough = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n)
    return df.join(lookup_side(enough.select(group)), group, "left_semi")


def sample_n(df: DataFrame, group: str = "taxon_name", n: int = 1000, seed: int = 0, id_col: str = "occurrence_id") -> DataFrame:
    """At most ``n`` rows of each group, uniform without replacement and repeatable.

    Rows are ordered by a seeded md5 of their id and the n lowest of a group stay. Group sizes are
    counted first (one narrow pass); with them each row sees, before any shuffle, whether its draw
    is low enough to matter: the cut-off lets ten standard deviations more than n rows through, so
    little more than the sample itself is shuffled, whatever a group's size. Should a group come out
    short all the same, the job fails instead of returning a smaller sample.
    """
    sizes = cut_lineage(df.groupBy(group).agg(F.count("*").alias("_size")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    # 52 leading bits of the draw as a number in [0, 1)
    unit = F.conv(F.substring("_draw", 1, 13), 16, 10).cast("double") / float(1 << 52)
    share = F.lit(n + 10 * math.sqrt(n) + 100) / F.col("_size")
    low = (
        df.join(measured(sizes, sizes.count()), group)
        .withColumn("_draw", draw)
        .filter((F.col("_size") <= n) | (unit < share))
    )
    whole = Window.partitionBy(group)
    ranked = low.withColumn("_rank", F.row_number().over(whole.orderBy("_draw", id_col))).withColumn(
        "_low", F.count("*").over(whole)
    )
    enough = F.col("_low") >= F.least(F.col("_size"), F.lit(n))
    keep = F.when(enough, F.col("_rank") <= n).otherwise(F.raise_error(F.lit("sample cut-off too low")))
    return ranked.filter(keep).drop("_rank", "_low", "_size", "_draw").select(*df.columns)


def latitude_summary(df: DataFrame, group: str = "taxon_name", lat: str = "decimal_latitude") -> DataFrame:
    """Per taxon: mean absolute latitude and latitudinal range."""
    return df.groupBy(group).agg(
        F.avg(F.abs(lat)).alias("average_absolute_latitude"), (F.max(lat) - F.min(lat)).alias("latitudinal_range")
    )


def _points(occ: DataFrame, group: str, lat: str, lon: str) -> DataFrame:
    places = occ.groupBy(group, lat, lon).agg(F.count("*").cast("double").alias("weight"))
    place = F.concat_ws("|", F.col(lat).cast("string"), F.col(lon).cast("string"))
    return places.select(group, place.alias("point"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), "weight")


def _mean_distances(occ: DataFrame, group: str, lat: str, lon: str, tile_rows: int) -> DataFrame:
    """(group, point, lat, lon, weight, partners, total_km, mean_km) per distinct place."""
    points = cut_lineage(_points(occ, group, lat, lon))
    sums = great_circle_sums(points, [group], tile_rows)
    joined = points.join(sums, [group, "point"])
    partners = F.col("n") - 1
    return joined.select(
        group,
        "point",
        "lat",
        "lon",
        "weight",
        partners.cast("long").alias("partners"),
        F.col("total").alias("total_km"),
        F.when(partners > 0, F.col("total") / partners).alias("mean_km"),
    )


def pairwise_within_group(
    df: DataFrame,
    group: str = "taxon_name",
    lat: str = "decimal_latitude",
    lon: str = "decimal_longitude",
    tile_rows: int = DISTANCE_ROWS,
) -> DataFrame:
    """Every row against all others of its group: partners, total_km and mean_km per row.

    The n(n-1) pairs are reduced tile by tile; see :mod:`phylomart.operators.pairwise`.
    """
    means = _mean_distances(df, group, lat, lon, tile_rows).select(
        group, F.col("lat").alias(lat), F.col("lon").alias(lon), "partners", "total_km", "mean_km"
    )
    return df.join(means, [group, lat, lon])


def filter_outliers(
    occ: DataFrame,
    group: str = "taxon_name",
    thresh: float = math.inf,
    lat: str = "decimal_latitude",
    lon: str = "decimal_longitude",
    tile_rows: int = DISTANCE_ROWS,
) -> DataFrame:
    """Keep records whose mean distance to the others is within ``thresh`` sample deviations of the mean.

    Groups of a single record have no distance and stay whole.
    """
    if math.isinf(thresh):
        return occ
    means = cut_lineage(_mean_distances(occ, group, lat, lon, tile_rows))
    n, w, m = F.sum("weight"), F.col("weight"), F.col("mean_km")
    centre = means.groupBy(group).agg(n.alias("_n"), (F.sum(w * m) / n).alias("_centre"))
    placed = means.join(lookup_side(centre), group).withColumn("_off", m - F.col("_centre"))
    spread = placed.groupBy(group).agg(
        F.sqrt(F.try_divide(F.sum(w * F.col("_off") * F.col("_off")), F.max("_n") - 1)).alias("_sd")
    )
    inside = placed.join(lookup_side(spread), group).filter(
        m.isNull() | (F.abs("_off") <= F.col("_sd") * F.lit(float(thresh)) + F.lit(1e-9))
    )
    kept = inside.select(group, F.col("lat").alias(lat), F.col("lon").alias(lon))
    return occ.join(kept, [group, lat, lon], "left_semi")


def filter_by_range(
    occ: DataFrame,
    ranges: DataFrame,
    names: DataFrame,
    min_kept: int = 10,
    group: str = "taxon_name",
    lat: str = "decimal_latitude",
    lon: str = "decimal_longitude",
    max_edges: int = MAX_EDGES,
    stored: bool = False,
) -> DataFrame:
    """Keep occurrences inside any range polygon of their species.

    Places meet polygons through cells that divide where edges are many (:mod:`phylomart.operators.ranges`): a place is tested
    against the edges of its own cell only, and no ring is copied.

    ``ranges`` (binomial, legend, rings), ``names`` (``group``, name) lists the names each species
    goes by. Reintroduced ranges do not count. A species without a polygon, or left with fewer than
    ``min_kept`` records, keeps all its records. ``occ`` is read three times, so it is written first unless it is already ``stored``.
    """
    occ = occ if stored else cut_lineage(occ)
    shapes = (
        ranges.filter(~F.col("legend").eqNullSafe("Reintroduced"))
        .join(names.select(group, F.col("name").alias("binomial")).distinct(), "binomial")
        .select(group, "rings")
    )
    places = occ.groupBy(group, F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"))
    # used twice below, and the ray cast is the costly step
    inside = cut_lineage(places_inside(places, range_cover(shapes, [group], max_edges), group))
    # species filtered for good: enough records inside; the others keep every record
    counts = inside.groupBy(group).agg(F.sum("n").alias("_n"))
    filtered = lookup_side(counts.filter(F.col("_n") >= min_kept).select(group))
    within = inside.join(filtered, group, "left_semi").select(group, F.col("lat").alias(lat), F.col("lon").alias(lon))
    kept = occ.join(within, [group, lat, lon], "left_semi")
    return kept.unionByName(occ.join(filtered, group, "left_anti"))
