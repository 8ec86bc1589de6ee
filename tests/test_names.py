import random
import string

from pyspark.sql import functions as F

from phylomart.operators.joins import insert_if_absent, with_parent
from phylomart.operators.keys import assign_keys, first_seen_ids
from phylomart.operators.names import acceptable, attach_candidates, fuzzy_match, lookup_rejects, resolve_backbone, resolve_names
from phylomart.operators.hierarchy import ranks_to_adjacency
from phylomart.plans.taxonomy import extract_synonyms
from phylomart.runtime import ordinal_within, with_position

VARIANTS = "taxonvariant_id long, taxonvariant_name string, taxonvariant_level string, taxonvariant_status string, taxon_id long"
TAXA = "taxon_id long, taxon_name string, taxon_level string, msw_id long, gbif_taxon_key long"
NAMES = "tsn long, completename string"
LINKS = "tsn long, tsn_accepted long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_equals_brute_force(make):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(3, 7)))
    taxa = [(i, word()) for i in range(60)]
    labels = sorted({word() for _ in range(60)})
    got = {r.label: (r.edit_distance, r.taxon_id) for r in fuzzy_match(
        make([(x,) for x in labels], "label string"), make(taxa, "taxon_id long, taxon_name string"), min_score=0.0).collect()}
    want = {}
    for label in labels:
        near = [(edits(label, name), i) for i, name in taxa if edits(label, name) <= 1]
        if near:
            want[label] = min(near)
    assert got == want


def test_fuzzy_score_and_supplied_candidates(make):
    taxa = make([(1, "abc"), (2, "abcdefgh")], "taxon_id long, taxon_name string")
    labels = make([("abd",), ("abcdefgx",)], "label string")
    assert [(r.label, r.taxon_id) for r in fuzzy_match(labels, taxa).collect()] == [("abcdefgx", 2)]
    cands = make([(1, 0.8, "Fuzzy match by canonical form", 1), (2, 0.7, "Exact match by canonical form", 0), (3, 0.9, "Exact string match", 0),
                  (4, 0.9, "Fuzzy match by canonical form", 2)], "k int, score double, match_value string, edit_distance int")
    assert [r.k for r in acceptable(cands).collect()] == [1]


def backbone(make, labels, variants, taxa, names, links):
    return resolve_backbone(make([(x,) for x in labels], "label string"), make(names, NAMES), make(links, LINKS), make(variants, VARIANTS), make(taxa, TAXA))


def test_backbone_creates_once_and_is_idempotent(make):
    names = [(1, "Aa"), (2, "Old Aa"), (3, "Bb"), (4, "Old Bb")]
    links = [(2, 1), (4, 3)]
    found = backbone(make, ["Old Aa", "Aa", "Old Bb", "Nobody"], [], [], names, links)
    made = {r.taxonvariant_name: (r.taxonvariant_id, r.taxonvariant_status) for r in found.variants.collect()}
    assert made == {"Aa": (1, "accepted"), "Old Bb": (2, "synonym")}
    mapped = {r.label: r.taxonvariant_id for r in found.label_map.collect()}
    assert mapped == {"Aa": 1, "Old Aa": 1, "Old Bb": 2}
    assert [r.label for r in found.rejected.collect()] == ["Nobody"]
    taxa = [tuple(r) for r in found.taxa.orderBy("taxon_id").collect()]
    assert [(t[1], t[4]) for t in taxa] == [("Aa", 1), ("Bb", 3)]
    again = backbone(make, ["Old Aa", "Aa", "Old Bb"], [tuple(r) for r in found.variants.select(*[c.split()[0] for c in VARIANTS.split(", ")]).collect()], taxa, names, links)
    assert again.variants.count() == 0 and again.taxa.count() == 2
    assert {r.label: r.taxonvariant_id for r in again.label_map.collect()} == mapped


def test_homonyms_take_the_lowest_tsn(make):
    found = backbone(make, ["Aa"], [(7, "Cc", "SPECIES", "accepted", 3)], [(3, "Cc", "SPECIES", 3, None)], [(1, "Aa"), (2, "Aa"), (5, "Cc")], [(1, 5)])
    assert found.label_map.first().taxonvariant_id == 7


def test_cascade_local_link_chain_fuzzy_and_ambiguous(make):
    variants = [(1, "Aaaaa", "SPECIES", "accepted", 1), (2, "Twice", "SPECIES", "accepted", 2), (3, "Twice", "SPECIES", "synonym", 1)]
    taxa = [(1, "Aaaaa", "SPECIES", 1, None), (2, "Twice", "SPECIES", 2, None)]
    names = [(1, "Aaaaa"), (10, "Older"), (11, "Oldest")]
    links = [(10, 1), (11, 10)]
    labels = ["Aaaaa", "Older", "Oldest", "Aaaba", "Twice", "nothing like it"]
    found = resolve_names(make([(x,) for x in labels], "label string"), make(variants, VARIANTS), make(taxa, TAXA), make(names, NAMES), make(links, LINKS))
    got = {r.label: r.rule for r in found.label_map.collect()}
    assert got == {"Aaaaa": "local", "Older": "link", "Oldest": "link", "Aaaba": "fuzzy", "Twice": "fuzzy", "nothing like it": None}
    made = {r.taxonvariant_name: r.taxon_id for r in found.variants.collect()}
    assert made == {"Older": 1, "Oldest": 1, "Aaaba": 1, "Twice": 2}


def test_links_are_followed_to_their_end(make):
    variants, taxa = make([(1, "Aaaaa", "SPECIES", "accepted", 7)], VARIANTS), make([(7, "Aaaaa", "SPECIES", 1, None)], TAXA)
    names = make([(i, f"Name{'x' * 3 * i}") for i in range(1, 9)] + [(99, "Aaaaa"), (50, "Loop one"), (51, "Loop other")], NAMES)
    links = make([(1, 99), *[(i, i - 1) for i in range(2, 9)], (50, 51), (51, 50)], LINKS)
    found = resolve_names(names.selectExpr("completename as label"), variants, taxa, names, links)
    rules = {r.label: r.rule for r in found.label_map.collect()}
    assert [rules[f"Name{'x' * 3 * i}"] for i in range(1, 9)] == ["link"] * 8
    assert rules["Loop one"] is None and rules["Loop other"] is None and rules["Aaaaa"] == "local"
    assert {r.taxon_id for r in found.variants.collect()} == {7}


def test_long_chains_and_ids_with_several_names(make):
    variants, taxa = make([(1, "Aaaaa", "SPECIES", "accepted", 7)], VARIANTS), make([(7, "Aaaaa", "SPECIES", 1, None)], TAXA)
    label = "Chained name {:05d} of a long list".format
    names = make([(i, label(i)) for i in range(1, 600)] + [(7, "Zz other name of seven"), (9999, "Aaaaa")], NAMES)
    links = make([(1, 9999), *[(i, i - 1) for i in range(2, 600)]], LINKS)
    found = resolve_names(names.selectExpr("completename as label").filter("label like 'Chained%'"), variants, taxa, names, links)
    assert {(r.rule, r["count"]) for r in found.label_map.groupBy("rule").count().collect()} == {("link", 599)}
    assert found.variants.select("taxonvariant_id").distinct().count() == 599


CANDIDATES = "label string, local_id long, score double, match_value string, edit_distance int"


def test_supplied_candidates_attach_by_either_key(make):
    taxa = make([(1, "Aa", "SPECIES", 10, 100), (2, "Bb", "GENUS", 20, 200), (3, "Bb", "SPECIES", 20, None)], TAXA)
    exact, fuzzy = "Exact match by canonical form", "Fuzzy match by canonical form"
    rows = [("low", 10, 0.7, exact, 0), ("kind", 10, 0.9, "Exact string match", 0), ("far", 10, 0.9, fuzzy, 2), ("gone", 77, 0.9, exact, 0), (None, 10, 0.9, exact, 0),
            ("null", None, 0.9, exact, 0), ("best", 20, 0.8, exact, 0), ("best", 10, 0.95, fuzzy, 1), ("tie", 20, 0.75, exact, 0), ("tie", 20, 0.75, exact, 0)]
    got = attach_candidates(make(rows, CANDIDATES), taxa, "msw_id").collect()
    assert {(r.taxonvariant_name, r.taxon_id, r.taxonvariant_level, r.score) for r in got} == {("best", 1, "SPECIES", 0.95), ("tie", 2, "GENUS", 0.75)} and len(got) == 2
    assert attach_candidates(make(rows, CANDIDATES), taxa).count() == 0
    found = resolve_names(make([("best",), ("tie",), ("low",)], "label string"), make([], VARIANTS), taxa, make([], NAMES), make([], LINKS), candidates=make(rows, CANDIDATES), id_col="msw_id")
    assert {r.label: r.rule for r in found.label_map.collect()} == {"best": "fuzzy", "tie": "fuzzy", "low": None}


def test_lookup_rejects(make):
    rows = make([(1, 5), (2, 6)], "k int, taxon_key long")
    assert [r.k for r in lookup_rejects(rows, make([(5, "Aa")], NAMES)).collect()] == [2]


def test_insert_if_absent_treats_nulls_as_equal(make):
    schema = "a int, b string"
    new = make([(1, None), (1, None), (2, "x"), (3, "y")], schema)
    stored = make([(1, None), (2, "z")], schema)
    assert sorted(tuple(r) for r in insert_if_absent(new, stored).collect()) == [(2, "x"), (3, "y")]


def test_with_parent_keeps_children_without_one(make):
    child = make([(1, 5, "a"), (2, None, "b"), (3, 9, "c")], "k int, taxon_id long, name string")
    parent = make([(5, "p")], "taxon_id long, name string")
    got = {r.k: r.parent_name for r in with_parent(child, parent, "taxon_id").collect()}
    assert got == {1: "p", 2: None, 3: None}


def test_positions_are_dense_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    rows = with_position(df, ["v"]).collect()
    assert all(r.position == r.v + 1 for r in rows) and len(rows) == 5000
    hot = df.select(F.when(F.col("v") < 4000, "hot").when(F.col("v") < 4001, F.lit(None)).otherwise("cold").alias("g"), "v")
    placed = ordinal_within(hot, ["g"], ["v"]).collect()
    assert {(r.g, r.position - 1) for r in placed} == {("hot", i) for i in range(4000)} | {(None, 0)} | {("cold", i) for i in range(999)}


def test_assign_keys_and_first_seen(make):
    new = make([("b",), ("a",)], "name string")
    assert [tuple(r) for r in assign_keys(new, make([(41,)], "id long"), "id", ["name"]).orderBy("id").collect()] == [(42, "a"), (43, "b")]
    assert assign_keys(new, make([], "id long"), "id", ["name"]).agg(F.min("id")).first()[0] == 1
    triples = make([(1, "z", "mass"), (2, "a", "tail"), (3, "a", "mass"), (4, "z", "eyes")], "line long, taxon string, charname string")
    assert {r.charname: r.char_id for r in first_seen_ids(triples).collect()} == {"tail": 1, "mass": 2, "eyes": 3}


def test_synonym_styles(make):
    rows = [(1, "<i>alpha</i> and <i>beta</i>.", "SPECIES"), (2, "Alpha, Beta.", "GENUS"), (3, "Delta of authors", "SUBSPECIES"), (4, "lower", "SPECIES"), (5, None, "SPECIES"), (6, "Gamma, Delta, .", "GENUS")]
    df = make([(*r, "Bos", "taurus", "indicus") for r in rows], "line int, synonyms string, taxon_level string, genus string, species string, subspecies string")
    got = sorted((r.line, r.synonym_name) for r in extract_synonyms(df).collect())
    assert got == [(1, "Bos alpha"), (2, "Alpha"), (2, "Beta"), (3, "Bos taurus Delta"), (6, "Delta"), (6, "Gamma")]


def test_rank_rows_parents(make):
    rows = [(1, "10", "A", "", ""), (2, "11", "A", "B", ""), (3, "12", "A", "C", "D"), (4, "13", "A", "C", "E"), (5, "14", "A", "B", ""), (6, "15", "Z", "Y", "X")]
    got = {r.id: r.parent_id for r in ranks_to_adjacency(make(rows, "line int, id string, r1 string, r2 string, r3 string"), ["r1", "r2", "r3"]).collect()}
    # row 12 introduces two prefixes at once; 14 repeats the path of 11; 15 starts a new tree
    assert got == {"10": None, "11": "10", "12": "10", "13": "12", "14": "11", "15": None}
