import math
import random

import pytest

from phylomart.operators import occurrences as o
from phylomart.operators.stats import complete_cases, gower_distance, mantel_test, model_frame, permuted_labels, regress_origin
from phylomart.plans.occurrences import extract_occurrences
from phylomart.sources.tabular import write_tsv
from phylomart.streaming.occurrences import stored_schema, stream_occurrences

OCC = "occurrence_id long, taxon_name string, decimal_latitude double, decimal_longitude double"


def km(a, b):
    (la1, lo1), (la2, lo2) = [[math.radians(v) for v in p] for p in (a, b)]
    x = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def scatter(n, seed=1, groups=("hot", "hot", "cold")):
    rng = random.Random(seed)
    return [(i, rng.choice(groups), rng.randint(-800, 800) / 10, rng.randint(-1700, 1700) / 10) for i in range(n)]


@pytest.mark.parametrize("tile_rows", [7, 1024])
def test_pairwise_and_outliers_equal_brute_force_across_tiles(make, tile_rows):
    rows = scatter(120) + [(500, "hot", 1.0, 1.0), (501, "hot", 1.0, 1.0), (600, "alone", 3.0, 3.0)]
    df = make(rows, OCC)
    mean = {}
    for i, g, la, lo in rows:
        ds = [km((la, lo), (x, y)) for j, h, x, y in rows if h == g and j != i]
        mean[i] = (len(ds), sum(ds) / len(ds) if ds else None)
    got = {r.occurrence_id: (r.partners, r.mean_km) for r in o.pairwise_within_group(df, tile_rows=tile_rows).collect()}
    assert set(got) == set(mean)
    for i, (n, m) in mean.items():
        assert got[i] == (n, None if m is None else pytest.approx(m))
    keep = set()
    for g in ("hot", "cold", "alone"):
        ids = [i for i, h, _, _ in rows if h == g]
        ms = [mean[i][1] for i in ids]
        if len(ids) == 1:
            keep |= set(ids)
            continue
        centre = sum(ms) / len(ms)
        sd = math.sqrt(sum((m - centre) ** 2 for m in ms) / (len(ms) - 1))
        keep |= {i for i in ids if abs(mean[i][1] - centre) <= 1.2 * sd}
    assert {r.occurrence_id for r in o.filter_outliers(df, thresh=1.2, tile_rows=tile_rows).collect()} == keep
    assert o.filter_outliers(df).count() == len(rows)


def test_sample_is_exact_repeatable_and_whole_for_small_groups(make):
    df = make([(i, "hot" if i < 900 else "small", 0.0, 0.0) for i in range(905)], OCC)
    first = {r.occurrence_id for r in o.sample_n(df, n=50, seed=3).collect()}
    assert first == {r.occurrence_id for r in o.sample_n(df.repartition(5), n=50, seed=3).collect()}
    assert len([i for i in first if i < 900]) == 50 and len([i for i in first if i >= 900]) == 5
    assert first != {r.occurrence_id for r in o.sample_n(df, n=50, seed=4).collect()}


def test_distinct_coordinates_keep_the_first_and_gate_counts(make):
    df = make([(3, "a", 1.0, 1.0), (1, "a", 1.0, 1.0), (2, "a", 1.0, 2.0), (4, "b", 1.0, 1.0)], OCC)
    assert sorted(r.occurrence_id for r in o.distinct_coordinates(df).collect()) == [1, 2, 4]
    assert sorted(r.occurrence_id for r in o.min_records_gate(df, n=3).collect()) == [1, 2, 3]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_range_rules(make):
    rows = [(i, "a", 0.5, 0.5 + i / 100) for i in range(4)] + [(10, "a", 5.0, 5.0), (11, "a", 2.5, 2.5)]
    rows += [(20, "few", 0.5, 0.5), (21, "few", 9.0, 9.0), (30, "none", 9.0, 9.0), (40, "re", 9.0, 9.0)]
    ranges = [("a", "Extant", [box(0.0, 0.0, 3.0, 3.0), box(2.0, 2.0, 2.8, 2.8)]), ("a alias", "Extant", [box(4.0, 4.0, 6.0, 6.0)]),
              ("few", "Extant", [box(0.0, 0.0, 1.0, 1.0)]), ("re", "Reintroduced", [box(0.0, 0.0, 1.0, 1.0)])]
    names = [("a", "a"), ("a", "a alias"), ("few", "few"), ("none", "none"), ("re", "re")]
    kept = o.filter_by_range(make(rows, OCC), make(ranges, "binomial string, legend string, rings array<array<struct<x:double,y:double>>>"),
                             make(names, "taxon_name string, name string"), min_kept=3)
    # 11 lies in the hole; 'few' has too few inside and keeps all; no or only reintroduced polygons keep all
    assert sorted(r.occurrence_id for r in kept.collect()) == [0, 1, 2, 3, 10, 20, 21, 30, 40]


def gower(rows, i, j):
    spans = [max(v) - min(v) if v else 0 for v in ([r[t] for r in rows if r[t] is not None] for t in (1, 2, 3))]
    gaps = [abs(rows[i][t] - rows[j][t]) / spans[t - 1] for t in (1, 2, 3) if spans[t - 1] and rows[i][t] is not None and rows[j][t] is not None]
    return sum(gaps) / len(gaps) if gaps else None


def test_gower_and_complete_cases(make):
    rng = random.Random(2)
    rows = [(i, rng.random() if i % 5 else None, float(rng.randint(0, 9)) if i % 5 != 1 else None, 4.0 if i % 2 else None) for i in range(30)]
    dist = gower_distance(make(rows, "item long, t1 double, t2 double, t3 double"), "item", ["t1", "t2", "t3"])
    got = {r.item: r for r in dist.collect()}
    complete = set()
    for i in range(30):
        ds = [gower(rows, i, j) for j in range(30) if j != i]
        known = [d for d in ds if d is not None]
        assert (got[i].defined_pairs, got[i].undefined_pairs) == (len(known), 29 - len(known))
        assert got[i].mean_distance == pytest.approx(sum(known) / len(known))
        complete |= {i} if len(known) == 29 else set()
    assert {r.item for r in complete_cases(dist).collect()} == complete and 0 < len(complete) < 30


def test_permutations_are_one_to_one(make):
    rows = permuted_labels(make([(i,) for i in range(17)], "item long"), "item", 4, seed=1).collect()
    for perm in range(5):
        pairs = {r.item: r.other for r in rows if r.perm == perm}
        assert sorted(pairs) == sorted(pairs.values()) == list(range(17))
    assert all(r.item == r.other for r in rows if r.perm == 0)
    assert any(r.item != r.other for r in rows if r.perm == 1)


@pytest.mark.parametrize("tile_rows", [5, 1024])
def test_mantel_correlation(make, tile_rows):
    rng = random.Random(4)
    groups = [rng.randrange(3) for _ in range(14)]
    traits = [(i, g + rng.random(), 1.0) for i, g in enumerate(groups)]
    paths = [(i, [0, 100 + g, i + 1], [0.0, 2.0, 3.0]) for i, g in enumerate(groups)]
    got = mantel_test(make(traits, "item long, t1 double, t2 double"), "item", ["t1", "t2"], make(paths, "item long, path array<long>, depths array<double>"), 19, 0, tile_rows).first()
    span = max(t[1] for t in traits) - min(t[1] for t in traits)
    xs, ys = [], []
    for i in range(14):
        for j in range(i):
            xs.append(abs(traits[i][1] - traits[j][1]) / span)
            ys.append(2.0 if groups[i] == groups[j] else 6.0)
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    r = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    assert got.r == pytest.approx(r) and got.n_pairs == 91 and got.p_value == pytest.approx(0.05)


def test_regression_and_model_frame(make):
    df = make([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 1.0)], "x double, y double")
    fit = regress_origin(df, "x", "y").first()
    slope = (2 + 8.2 + 17.7) / 14
    rss = sum((y - slope * x) ** 2 for x, y in ((1, 2), (2, 4.1), (3, 5.9)))
    assert fit.slope == pytest.approx(slope) and fit.df == 2 and fit.std_error == pytest.approx(math.sqrt(rss / 2 / 14))
    wide = make([("a", 1.0, 2.0, 3.0), ("b", 0.0, 1.0, 1.0)], "label string, y double, x1 double, x2 double")
    assert [tuple(r) for r in model_frame(wide, make([("a",), ("z",)], "label string"), "y").collect()] == [("a", 1.0, [2.0, 3.0])]


RAW = ["gbif_id", "occurrence_type", "basis_of_record", "event_date", "decimal_latitude", "decimal_longitude", "dataset_key", "has_geospatial_issues", "label"]


def test_two_overlapping_batches_equal_one(spark, tmp_path):
    schema = ", ".join(f"{c} string" for c in RAW)
    rows = [(str(i), "Event", "UNKNOWN" if i == 3 else "FOSSIL_SPECIMEN", "" if i == 4 else f"200{i}-01-02", "1.50", "2.25", "d", "true" if i == 5 else "false", "Aa") for i in range(9)]
    rows.append(("99", "Event", "FOSSIL_SPECIMEN", "soon", "1.50", "2.25", "d", "false", "Aa"))

    def run(name, batches):
        for part in batches:
            write_tsv(spark.createDataFrame(part, schema), f"{tmp_path}/{name}/in", mode="append")
            stream_occurrences(spark, f"{tmp_path}/{name}/in", f"{tmp_path}/{name}/t", f"{tmp_path}/{name}/c", schema).awaitTermination()
        stored = spark.read.schema(stored_schema()).parquet(f"{tmp_path}/{name}/t")
        return sorted((r.gbif_id, r.event_date, r.latitude_text) for r in stored.collect())

    whole = run("one", [rows])
    assert [k for k, _, _ in whole] == [0, 1, 2, 6, 7, 8, 99]
    assert run("two", [rows[:6], rows[2:], rows]) == whole


def test_extraction_end_to_end(make):
    tables = {
        "branches": make([(1, None, 1, "ORD", 11), (2, 1, 2, "Aa bb", 11), (3, 2, 3, "Aa bb cc", 11)], "node_id long, parent_id long, taxonvariant_id long, label string, tree_id long"),
        "taxonvariants": make([(1, "ORD", "ORDER", "accepted", 1), (2, "Aa bb", "SPECIES", "accepted", 2), (3, "Aa bb cc", "SUBSPECIES", "accepted", 3), (4, "Alias", "SPECIES", "synonym", 2)],
                              "taxonvariant_id long, taxonvariant_name string, taxonvariant_level string, taxonvariant_status string, taxon_id long"),
        "taxa": make([(1, "ORD", "ORDER"), (2, "Aa bb", "SPECIES"), (3, "Aa bb cc", "SUBSPECIES")], "taxon_id long, taxon_name string, taxon_level string"),
        "occurrences": make([(i, i, "FOSSIL_SPECIMEN" if i != 7 else "LIVING_SPECIMEN", "2001-01-01", 1.0 + i / 100, 2.25, f"{1.0 + i / 100:.2f}", "2.25", 2 + i % 3) for i in range(12)],
                            "occurrence_id long, gbif_id long, basis_of_record string, event_date string, decimal_latitude double, decimal_longitude double, latitude_text string, longitude_text string, taxonvariant_id long"),
    }
    roots = make([("ORD",)], "label string")
    assert extract_occurrences(tables, roots, min_records=10).count() == 11
    # record 7 is a living specimen of variant 3; without subspecies variant 3 (1, 4, 7, 10) is out, eight stay
    assert extract_occurrences(tables, roots, subspecies=False, min_records=10).count() == 0
    assert extract_occurrences(tables, roots, subspecies=False, min_records=8).count() == 8
    assert extract_occurrences(tables, roots, sample=5, min_records=1).count() <= 5
    assert extract_occurrences(tables, roots, min_records=10, finished=make([("Aa_bb",)], "species string")).count() == 0
