from phylomart.operators.names import fuzzy_match
from phylomart.runtime import FILE_BROADCAST_BYTES, configure


def test_only_measured_sizes_broadcast_large_sides(spark):
    """Sizes of files mislead: nine hundred thousand names in a file of nine megabytes went through the driver."""
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    configure(configure(other))
    assert other._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == FILE_BROADCAST_BYTES
    assert other.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == f"{10 << 20}b"
    # a session that allows less keeps its limits
    for low in ("256k", "-1"):
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", low)
        configure(other)
        assert other.conf.get("spark.sql.autoBroadcastJoinThreshold") == low


def test_fuzzy_names_at_the_edges_of_length(make):
    labels = make([("abcde",), ("xbcde",), ("a",), ("",), ("abcdefgh",), (None,)], "label string")
    taxa = make([(1, "abcd"), (2, "abcdef"), (3, "abcdx"), (4, "b"), (5, "abc"), (6, "abcdefghij"), (7, None), (8, "xbcdef")], "taxon_id long, taxon_name string")
    got = {(r.label, r.taxon_id, r.edit_distance) for r in fuzzy_match(labels, taxa, 1, 0.0).collect()}
    assert got == {("abcde", 1, 1), ("xbcde", 8, 1), ("a", 4, 1), ("", 4, 1)}


def test_a_task_takes_few_bytes_of_narrow_rows(spark):
    """Rows of keys take thirty times their shuffled bytes, and AQE gave a task up to 64 MB of them."""
    other = spark.newSession()
    defaults = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB", "spark.sql.files.maxPartitionBytes": "128MB"}
    for key, value in defaults.items():
        other.conf.set(key, value)
    configure(configure(other))
    assert [other.conf.get(key) for key in defaults] == [f"{8 << 20}b", f"{16 << 20}b"]
    # a session that asks for less keeps its sizes
    for key in defaults:
        other.conf.set(key, "1m")
    configure(other)
    assert [other.conf.get(key) for key in defaults] == ["1m", "1m"]
