import gzip
import random

import pytest
from pyspark.sql import functions as F

from phylomart.sources.newick import _nodes, newick_fragments, newick_rejects, nexus_trees, parse_newick, write_newick
from phylomart.sources import tabular
from phylomart.sources.tabular import read_ranges, read_species_csv, read_tsv, write_species_csv, written_species


def tree_rows(spark, text):
    df = parse_newick(spark.createDataFrame([("t", text)], "tree_name string, newick string"))
    return [(r.node_id, r.parent_id, r.branch_length, r.label) for r in df.orderBy("node_id").collect()]


def test_tsv_short_rows_quotes_and_gzip(spark, tmp_path):
    text = 'a\tb\tc\n1\tx"y\t2\n3\tz\n'
    (tmp_path / "t.tsv").write_text(text)
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as out:
        out.write(text.replace("\n", "\r\n"))
    for name in ("t.tsv", "t.tsv.gz"):
        rows = read_tsv(spark, str(tmp_path / name), "a long, c long, b string, missing string").orderBy("a").collect()
        assert [tuple(r) for r in rows] == [(1, 2, 'x"y', None), (3, None, "z", None)]


def test_newick_lengths_names_and_quotes(spark):
    rows = tree_rows(spark, "((A_b:1,'C d''e':2.5)inner:0.5,D:1e-2)root;")
    assert rows == [(1, None, None, "root"), (2, 1, 0.5, "inner"), (3, 2, 1.0, "A b"), (4, 2, 2.5, "C d'e"), (5, 1, 0.01, "D")]


def test_newick_without_lengths_single_tip_polytomy_and_comments(spark):
    assert tree_rows(spark, "A;") == [(1, None, None, "A")]
    assert [r[3] for r in tree_rows(spark, "(A,B,[note]C,(,));")] == ["", "A", "B", "C", "", "", ""]
    assert tree_rows(spark, "(A:0,B);")[1] == (2, 1, 0.0, "A")


def test_newick_thousand_deep_chain():
    depth = 1000
    parents, labels, lengths = _nodes("(" * depth + "tip:1" + ")" * depth + ";")
    assert len(parents) == depth + 1 and parents[-1] == depth - 1 and labels[-1] == "tip" and lengths[-1] == 1.0


def test_texts_that_are_no_trees_are_rejected(spark):
    texts = {"good": "(A:1,B:2)r;", "open": "((A,B);", "closed": "(A,B));", "length": "(A:x,B);", "two": "A,B;", "none": None, "deep": "(" * 500 + "t" + ")" * 500 + ";"}
    df = spark.createDataFrame(list(texts.items()), "tree_name string, newick string")
    assert {r.tree_name for r in newick_rejects(df).collect()} == {"open", "closed", "length", "two"}
    assert {r.tree_name: r["count"] for r in parse_newick(df).groupBy("tree_name").count().collect()} == {"good": 3, "deep": 501}


def test_fragments_join_to_the_whole_text(spark):
    rng = random.Random(5)
    rows = [(t, n, rng.randrange(1, n) if n > 1 else None, float(n) if n > 1 else None, f"n '{n}" if n % 3 else None) for t in (1, 2) for n in range(1, 80)]
    rows.append((3, 1, None, None, "alone"))
    tree = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, branch_length double, label string")
    whole = {(r.tree_id, r.root_id): r.newick for r in write_newick(tree).collect()}
    parts: dict = {}
    for r in sorted(newick_fragments(tree).collect(), key=lambda r: r.ordinal):
        parts[r.tree_id, r.root_id] = parts.get((r.tree_id, r.root_id), "") + r.fragment
    assert parts == whole and len(whole) == 3


def test_nexus_tree_lines(spark):
    lines = ["#NEXUS", "begin trees;", "tree 'best' = (A:1,B:2);", "  tree low = [&R] (A,B);", "end;"]
    found = nexus_trees(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r.tree_name for r in found} == {"best", "low"} and found[0].newick == "(A:1,B:2);"


def test_newick_round_trip_keeps_the_adjacency(spark):
    rng = random.Random(3)
    rows = [(1, 0, None, None, "root")]
    for node in range(1, 60):
        rows.append((1, node, rng.randrange(node), float(rng.randint(1, 9)), f"n {node}"))
    tree = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, branch_length double, label string")
    back = parse_newick(write_newick(tree, cut_every=3).withColumn("tree_name", F.lit("x")))
    names = {r.node_id: r.label for r in back.collect()}
    got = {(r.label, names.get(r.parent_id), r.branch_length) for r in back.collect()}
    labels = {n: label for _, n, _, _, label in rows}
    assert got == {(label, labels.get(p), b) for _, _, p, b, label in rows}


def test_species_files_are_skipped_or_replaced(spark, tmp_path):
    path = f"{tmp_path}/out"
    schema = "gbif_id long, taxon_name string, decimal_latitude double, decimal_longitude double"
    first = spark.createDataFrame([(1, "Aa bb", 1.0, 2.0)], schema)
    both = spark.createDataFrame([(9, "Aa bb", 1.0, 2.0), (2, "Cc dd", 1.0, 2.0)], schema)
    read = lambda: sorted((r.gbif_id, r.species) for r in spark.read.option("header", True).csv(path, schema=schema + ", species string").collect())
    write_species_csv(first, path)
    write_species_csv(both, path)
    assert read() == [(1, "Aa_bb"), (2, "Cc_dd")]
    write_species_csv(both.filter("gbif_id = 9"), path, overwrite=True)
    assert read() == [(2, "Cc_dd"), (9, "Aa_bb")]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_read_ranges(spark, tmp_path, kind):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([("Aa bb", "Extant", [ring])], "binomial string, legend string, rings array<array<struct<x:double,y:double>>>")
    path = f"{tmp_path}/r.{kind}"
    getattr(df.write, kind)(path)
    assert read_ranges(spark, path).first().rings[0][1].x == 1.0


def test_new_species_are_written_by_tasks_as_sparks_writer_would(spark, tmp_path):
    """No job moves a folder per species on the driver, and names, quotes and numbers come out as from Spark's writer."""
    schema = "gbif_id long, taxon_name string, decimal_latitude double, decimal_longitude double"
    names = ["Aa bb", 'q"u,o', "a/b=c:d%[x]", "ümlaut", "", None, "it's #1"]
    rows = [(i, n, 1e-7 * i, None if i % 3 else -1e9 - i) for i in range(40) for n in [names[i % len(names)]]]
    df = spark.createDataFrame(rows, schema)
    write_species_csv(df, f"{tmp_path}/ours")
    columns = ["gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude"]
    df.select(F.translate("taxon_name", " ", "_").alias("species"), *columns).write.option("header", True).partitionBy("species").csv(f"{tmp_path}/sparks")
    folders = [sorted(p.name for p in (tmp_path / d).iterdir() if p.is_dir()) for d in ("ours", "sparks")]
    assert folders[0] == folders[1]
    # a task commits by one move a file under the folder itself; Spark's writer leaves its job marker
    assert not (tmp_path / "ours" / "_SUCCESS").exists()
    for folder in folders[0]:
        texts = [sorted(line for f in (tmp_path / d / folder).glob("part-*.csv") for line in f.read_text().splitlines()[1:]) for d in ("ours", "sparks")]
        assert texts[0] == texts[1]
    back = spark.read.option("header", True).csv(f"{tmp_path}/ours", schema=schema + ", species string")
    assert back.count() == 40 and back.select("species").distinct().count() == 6


def test_species_files_are_listed_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Thousands of files a task, where Spark's reader takes four; the rows are those of Spark's reader."""
    schema = "gbif_id long, taxon_name string, decimal_latitude double, decimal_longitude double"
    names = ["Aa bb", 'q"u,o', "a/b=c:d%[x]", "a+b%20", "ümlaut", "", None, "it's #1", *[f"sp {i}" for i in range(60)]]
    df = spark.createDataFrame([(i, names[i % len(names)], 1e-7 * i, None if i % 3 else -1e9 - i) for i in range(140)], schema)
    path = f"{tmp_path}/out"
    write_species_csv(df, path)
    (tmp_path / "out" / "species=Aa_bb" / "_hidden.csv").write_text("none\n1,x,1,1\n")
    (tmp_path / "out" / "species=Cc").mkdir()
    (tmp_path / "out" / "species=sp_1" / "more.csv").write_text("header\r\n7,sp 1,,2.5\r\n \n\r\n8,\"\",bad,-0.0\n9,short\n10,last,1,1")
    want = spark.read.schema(schema + ", species string").option("header", True).csv(path)
    rows = lambda found: sorted(map(repr, found.collect()))
    expected = rows(want)
    for size in (1 << 24, 90):
        monkeypatch.setattr(tabular, "SLICE_BYTES", size)
        back = read_species_csv(spark, path, schema)
        assert back.columns == want.columns and rows(back) == expected
    monkeypatch.undo()
    assert read_species_csv(spark, path, schema).rdd.getNumPartitions() == 1
    assert {r.species for r in written_species(spark, path).collect()} == {(n or "__HIVE_DEFAULT_PARTITION__").replace(" ", "_") for n in names}
