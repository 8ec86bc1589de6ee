from pyspark.sql import functions as F

from phylomart.operators import cleaning as c


def keys(df, col="k"):
    return sorted(r[col] for r in df.collect())


def test_zero_coordinate_counts_as_missing_unless_told_otherwise(make):
    df = make([(1, "0"), (2, "0.0"), (3, ""), (4, None), (5, "5.1")], "k int, lat string")
    assert keys(c.require_fields(df, ["lat"])) == [2, 5]
    assert keys(c.require_fields(df, ["lat"], zero_is_missing=False)) == [1, 2, 5]


def test_bool_word_is_case_sensitive_and_null_is_false(make):
    df = make([(1, "true"), (2, "TRUE"), (3, None), (4, "false")], "k int, flag string")
    assert {r.k: r.flag for r in c.bool_word_to_int(df, "flag").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_require_zero_takes_null_and_words_as_zero(make):
    df = make([(1, "0"), (2, "1"), (3, None), (4, "abc"), (5, "0.0")], "k int, flag string")
    assert keys(c.require_zero(df, "flag")) == [1, 3, 4, 5]


def test_exclude_regex_keeps_null(make):
    df = make([(1, "UNKNOWN"), (2, None), (3, "x UNKNOWN y"), (4, "FOSSIL")], "k int, basis string")
    assert keys(c.exclude_regex(df, "basis", "UNKNOWN")) == [2, 4]


def test_basis_list_replaces_the_default(make):
    df = make([(1, "FOSSIL_SPECIMEN"), (2, "LIVING_SPECIMEN"), (3, None)], "k int, basis_of_record string")
    assert keys(c.filter_basis(df)) == [1]
    assert keys(c.filter_basis(df, ["LIVING_SPECIMEN"])) == [2]


def test_malformed_dates_drop_only_with_a_bound(make):
    df = make([(1, "1999-05-01T00:00:00"), (2, "1999-05"), (3, None), (4, "1989-01-01")], "k int, event_date string")
    assert keys(c.filter_dates(df)) == [1, 2, 3, 4]
    assert keys(c.filter_dates(df, mindate="1990-01-01")) == [1]
    assert keys(c.filter_dates(df, maxdate="1999-05-01")) == [1, 4]


def test_precision_is_judged_on_the_source_text(make):
    rows = [(1, "12.34", "-1.20"), (2, "12.3", "1.23"), (3, "1.0E-5", "1.23"), (4, "5", "1.23"), (5, "1.234", "1.234")]
    df = make(rows, "k int, latitude_text string, longitude_text string")
    assert keys(c.filter_precision(df)) == [1, 5]
    assert keys(c.filter_precision(df, 3)) == [5]
    assert keys(c.filter_precision(df, 0)) == [1, 2, 3, 4, 5]


def test_keep_observed(make):
    values = ["-999", "-999.00", "1;2", "", "n/a", "3.5", "1d", None, "-999;1", "1e3"]
    df = make(list(enumerate(values)), "k int, v string")
    assert keys(c.keep_observed(df, "v")) == [2, 5, 8, 9]


def test_labels_by_rank(make):
    rows = [(1, "SPECIES", "Bos", "taurus", None, "x"), (2, "Subspecies", "Bos", "taurus", "indicus", "x"), (3, "ORDER", None, None, None, "PRIMATES")]
    df = make(rows, "k int, taxon_level string, genus string, species string, subspecies string, own_name string")
    got = {r.k: r.label for r in c.make_label(df).collect()}
    assert got == {1: "Bos taurus", 2: "Bos taurus indicus", 3: "PRIMATES"}


def test_to_numeric_truncates_toward_zero_and_nulls_bad_text(make):
    df = make([(1, "2.9"), (2, "-2.9"), (3, "x"), (4, None)], "k int, v string")
    got = {r.k: r.v for r in c.to_numeric(df, ["v"], integer=True).collect()}
    assert got == {1: 2, 2: -2, 3: None, 4: None}


def test_synonym_links_need_a_status_and_a_target(make):
    rows = [("1", "A", "Mammalia", "accepted", ""), ("2", "B", "Mammalia", "synonym", "1"), ("3", "C", "Mammalia", "doubtful", ""),
            ("4", "D", "Aves", "synonym", "1"), ("5", "E", None, "synonym", "1"), ("6", "F", "Mammalia", "synonym", "x")]
    df = make(rows, "taxonID string, canonicalName string, class string, taxonomicStatus string, acceptedNameUsageID string")
    assert keys(c.class_names(df), "tsn") == [1, 2, 3, 6]
    assert {(r.tsn, r.tsn_accepted) for r in c.synonym_links(df).collect()} == {(2, 1), (6, None)}


def test_normalise_and_units(make):
    df = make([("a_b c", "mass", "g")], "label string, predicate string, units string")
    assert c.normalise_label(df, "label").first().label == "a b c"
    assert c.normalise_label(df, "label", reverse=True).first().label == "a_b_c"
    assert c.label_with_units(df, name="full").first().full == "mass (g)"


def test_drop_zero_rows_and_binomials(make):
    df = make([(1, 0.0, 1.0, "Aa"), (2, 1.0, 1.0, "Aa bb"), (3, 2.0, 0.0, "Aa\tbb")], "k int, x double, y double, name string")
    assert keys(c.drop_zero_rows(df, ["x", "y"])) == [2]
    assert keys(c.binomials_only(df, "name")) == [2, 3]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("k"), F.lit("FOSSIL_SPECIMEN").alias("basis_of_record"), F.lit(1).alias("wide")).write.parquet(f"{tmp_path}/t")
    plan = c.filter_basis(spark.read.parquet(f"{tmp_path}/t")).select("k")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(basis_of_record" in plan and "wide" not in plan.split("ReadSchema")[-1]
