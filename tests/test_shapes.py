import glob
import os
import random
import struct

import pytest
from pyspark.errors import PySparkException

from phylomart.operators.occurrences import filter_by_range
from phylomart.sources.shapes import ShapeReader, read_shapes, write_shapes
from phylomart.sources.tabular import read_ranges

SCHEMA = "binomial string, legend string, rings array<array<struct<x:double,y:double>>>"


def box(x, y, side=1.0):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


def plain(df):
    rows = [(r.binomial, r.legend, None if r.rings is None else [[tuple(p) for p in ring] for ring in r.rings]) for r in df.collect()]
    return sorted(rows, key=repr)


def by_hand(folder, rows, kind=5, upper=False, fields=(("ID_NO", b"N", 6), ("BINOMIAL", b"C", 40), ("LEGEND", b"C", 30))):
    """A set of files put together from the published format, apart from the library's writer."""
    os.makedirs(folder, exist_ok=True)
    stem = os.path.join(folder, "ranges")
    body, index, at = b"", b"", 50
    for n, (_, _, _, rings) in enumerate(rows, 1):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        content = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts)
        content += b"".join(struct.pack("<2d", *p) for p in points)
        if kind == 15:
            content += struct.pack(f"<{2 + len(points)}d", *[7.0] * (2 + len(points)))
        index += struct.pack(">2i", at, len(content) // 2)
        body += struct.pack(">2i", n, len(content) // 2) + content
        at += 4 + len(content) // 2
    head = struct.pack(">i20xi", 9994, at) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    width = 1 + sum(f[2] for f in fields)
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), width)
    table += b"".join(struct.pack("<11sc4xBB14x", f[0].encode(), f[1], f[2], 0) for f in fields) + b"\r"
    for row in rows:
        table += b" " + b"".join((v.rjust if f[1] == b"N" else v.ljust)(f[2]) for v, f in zip([str(c).encode("latin-1") for c in row[:3]], fields))
    for end, data in {"shp": head + body, "shx": head + index, "dbf": table + b"\x1a"}.items():
        with open(f"{stem}.{end.upper() if upper else end}", "wb") as out:
            out.write(data)
    return f"{stem}.{'SHP' if upper else 'shp'}"


@pytest.mark.parametrize("file_bytes", [2_000, 1 << 26])
def test_written_polygons_come_back(make, spark, tmp_path, file_bytes):
    rng = random.Random(1)
    rows = [(f"Genus spécies {i}", "Extant" if i % 3 else None, [box(rng.uniform(-170, 170), rng.uniform(-80, 80)) for _ in range(i % 4)]) for i in range(60)]
    rows += [(None, "x", None), ("null ring", "", [None, box(1.0, 2.0)]), rows[1], rows[1]]
    path = str(tmp_path / "out")
    write_shapes(make(rows, SCHEMA).repartition(3), path, file_bytes=file_bytes)
    want = [(b, leg or None, None if r is None else [ring for ring in r if ring is not None]) for b, leg, r in rows]
    for slice_bytes in (300, 1 << 25):
        assert plain(read_shapes(spark, path, slice_bytes=slice_bytes)) == sorted(want, key=repr)
    assert (len(glob.glob(f"{path}/*.shp")) > 10) == (file_bytes == 2_000)
    assert not glob.glob(f"{path}/_*")


@pytest.mark.parametrize("kind,upper", [(5, False), (15, True)])
def test_files_made_elsewhere(spark, tmp_path, kind, upper):
    rows = [(i, f"Felis n{i}", "Reintroduced" if i == 2 else "Extant (resident)", [box(float(i), 0.0), box(float(i), 5.0)][: 1 + i % 2]) for i in range(9)]
    path = by_hand(str(tmp_path), rows, kind, upper)
    assert plain(read_ranges(spark, path)) == sorted([r[1:] for r in rows], key=repr)
    numbered = read_shapes(spark, path, ["id_no", "Binomial"]).collect()
    assert sorted((r.id_no, r.Binomial) for r in numbered) == [(str(i), f"Felis n{i}") for i in range(9)]


def test_letters_of_other_encodings(spark, tmp_path):
    path = by_hand(str(tmp_path), [(1, "Añejo", "x", [box(0.0, 0.0)])])
    assert read_shapes(spark, path, encoding="latin-1").first().binomial == "Añejo"


def test_slices_hold_each_record_once(tmp_path):
    path = by_hand(str(tmp_path), [(i, f"s{i}", "x", [box(float(i), 0.0)] * (1 + i % 5)) for i in range(200)])
    reader = ShapeReader({"path": path, "slice_bytes": "1000"})
    slices = reader.partitions()
    names = [b.column(0).to_pylist() for s in slices for b in reader.read(s)]
    assert len(slices) > 20 and sum(names, []) == [f"s{i}" for i in range(200)]
    assert max(map(len, names)) < 12


def test_small_slices_share_a_task(spark, tmp_path):
    path = by_hand(str(tmp_path), [(i, f"s{i}", "x", [box(float(i), 0.0)] * (1 + i % 5)) for i in range(200)])
    assert read_shapes(spark, path, slice_bytes=1000).rdd.getNumPartitions() == 1
    reader = ShapeReader({"path": path, "slice_bytes": "1000", "task_bytes": "20500"})
    tasks = reader.partitions()
    assert [t.last - t.first for t in tasks] == [20_000] * len(tasks) and len(tasks) < 5
    names = [b.column(0).to_pylist() for t in tasks for b in reader.read(t)]
    assert sum(names, []) == [f"s{i}" for i in range(200)]
    # a batch is still what one slice holds
    assert len(names) > 20 and max(map(len, names)) < 12


def test_bad_files_name_the_record(spark, tmp_path):
    rows = [(i, f"s{i}", "x", [box(float(i), 0.0)]) for i in range(3)]
    with pytest.raises(PySparkException, match="record 1 is of type 3, not a polygon"):
        read_shapes(spark, by_hand(str(tmp_path / "lines"), rows, kind=3)).collect()
    cut = by_hand(str(tmp_path / "cut"), rows)
    with open(cut, "rb+") as file:
        file.truncate(os.path.getsize(cut) - 10)
    with pytest.raises(PySparkException, match="record 3 ends early"):
        read_shapes(spark, cut).collect()
    with pytest.raises(PySparkException, match="no attribute"):
        read_shapes(spark, by_hand(str(tmp_path / "names"), rows), ["range_id"]).collect()
    empty = by_hand(str(tmp_path / "empty"), [])
    assert read_shapes(spark, empty).count() == 0


def test_what_the_format_cannot_hold_ends_the_job(make, tmp_path):
    for rows in ([("x" * 255, "y", [box(0.0, 0.0)])], [("a", "y", [[(0.0, None), (1.0, 1.0)]])], [("a", "y", [[None]])]):
        with pytest.raises(PySparkException):
            write_shapes(make(rows, SCHEMA), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        write_shapes(make([], "much_too_long_name string, rings array<array<struct<x:double,y:double>>>"), str(tmp_path / "bad"), ["much_too_long_name"])


def test_occurrences_filtered_by_a_shape_file(make, spark, tmp_path):
    path = by_hand(str(tmp_path), [(1, "a", "Extant", [box(0.0, 0.0, 4.0), box(1.0, 1.0, 2.0)]), (2, "a", "Reintroduced", [box(50.0, 50.0)])])
    places = [(0.5, 0.5), (3.5, 0.5), (2.0, 2.0), (50.5, 50.5)]
    occ = make([(i, "a", la, lo) for i, (la, lo) in enumerate(places)], "occurrence_id long, taxon_name string, decimal_latitude double, decimal_longitude double")
    kept = filter_by_range(occ, read_ranges(spark, path), make([("a", "a")], "taxon_name string, name string"), min_kept=2)
    assert sorted(r.occurrence_id for r in kept.collect()) == [0, 1]
