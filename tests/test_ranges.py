import math
import random

import pytest

from phylomart.operators.ranges import places_inside, range_cover

SHAPES = "g string, rings array<array<struct<x:double,y:double>>>"
PLACES = "g string, lat double, lon double, n long"


def inside(x, y, rings):
    """Even-odd rule over all edges."""
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0):
                odd = not odd
    return odd


def star(rng, cx, cy, radius, corners):
    turn = [2 * math.pi * i / corners for i in range(corners)]
    ring = [(cx + radius * rng.uniform(0.3, 1) * math.cos(t), cy + radius * rng.uniform(0.3, 1) * math.sin(t)) for t in turn]
    return ring + ring[:1]


def found(make, places, shapes, max_edges):
    cover = range_cover(make(shapes, SHAPES), ["g"], max_edges)
    rows = places_inside(make(places, PLACES), cover, "g").collect()
    return cover, sorted((r.g, r.lat, r.lon) for r in rows)


@pytest.mark.parametrize("max_edges", [4, 64])
def test_cover_equals_ray_cast(make, max_edges):
    rng = random.Random(3)
    shapes = [
        ("a", [star(rng, 10, 20, 40, 150), star(rng, 10, 20, 8, 30)]),
        ("a", [star(rng, 60, -10, 1.5, 40)]),
        ("b", [star(rng, -100, 0, 60, 90)]),
    ]
    places = [(g, rng.uniform(-60, 70), rng.uniform(-170, 120), 1) for g in "ab" for _ in range(700)]
    places += [("a", rng.uniform(-11.5, -8.5), rng.uniform(58.5, 61.5), 1) for _ in range(200)]
    cover, got = found(make, places, shapes, max_edges)
    assert got == sorted((g, la, lo) for g, la, lo, _ in places if any(inside(lo, la, r) for s, r in shapes if s == g))
    assert max(len(r.edges) for r in cover.collect()) <= max_edges
    if max_edges == 4:
        assert cover.select("level").distinct().count() > 3
        assert cover.filter("size(edges) = 0").count() > 0


@pytest.mark.parametrize("max_edges", [1, 4, 64])
def test_corners_and_borders_on_the_grid_follow_the_half_open_rule(make, max_edges):
    # corners, edges and places on whole numbers, where cell borders lie too; a spiral of steps with level and upright edges
    ring = [(0, 0), (16, 0), (16, 16), (4, 16), (4, 8), (8, 8), (8, 12), (12, 12), (12, 4), (0, 4), (0, 0)]
    slanted = [(-16, -16), (-8, 0), (0, -16), (-8, -8), (-16, -16)]
    shapes = [("a", [[(float(x), float(y)) for x, y in r] for r in (ring, slanted)])]
    places = [("a", float(y), float(x), 1) for x in range(-18, 19) for y in range(-18, 19)]
    _, got = found(make, places, shapes, max_edges)
    assert got == sorted((g, la, lo) for g, la, lo, _ in places if inside(lo, la, shapes[0][1]))


def test_odd_rings_and_places(make):
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    shapes = [
        ("open", [square]),
        ("gap", [[*square, (None, 2.0), (float("nan"), 2.0), (1.0, 1.0)]]),
        ("none", []), ("none", None), ("none", [[]]), ("none", [[(2.0, 2.0)]]), ("none", [[(2.0, 2.0)] * 4]),
        (None, [square]),
        ("twice", [square]), ("twice", [square]),
        ("cancelled", [square, square]),
    ]
    names = ["open", "gap", "none", None, "twice", "cancelled"]
    places = [(g, la, lo, 1) for g in names for la, lo in [(2.0, 2.0), (5.0, 5.0), (None, 2.0), (2.0, None)]]
    _, got = found(make, places, shapes, 2)
    assert got == [("gap", 2.0, 2.0), ("open", 2.0, 2.0), ("twice", 2.0, 2.0)]
    assert found(make, places, [], 2)[1] == []
    assert found(make, [], shapes, 2)[1] == []


def test_polygons_over_the_date_line(make):
    east = [(170.0, -20.0), (190.0, -20.0), (190.0, -10.0), (170.0, -10.0), (170.0, -20.0)]
    west = [(-190.0, 10.0), (-170.0, 10.0), (-170.0, 20.0), (-190.0, 20.0), (-190.0, 10.0)]
    places = [("a", -15.0, lon, 1) for lon in (175.0, -175.0, 165.0, -165.0)] + [("a", 15.0, lon, 1) for lon in (175.0, -175.0, 165.0)]
    _, got = found(make, places, [("a", [east]), ("a", [west])], 64)
    assert got == [("a", -15.0, -175.0), ("a", -15.0, 175.0), ("a", 15.0, -175.0), ("a", 15.0, 175.0)]


def test_an_edge_is_kept_only_where_it_passes(make):
    ring = [(100 * math.cos(2 * math.pi * i / 5000), 50 * math.sin(2 * math.pi * i / 5000)) for i in range(5000)]
    cover = range_cover(make([("a", [ring])], SHAPES), ["g"], 64)
    held = cover.selectExpr("sum(size(edges))", "max(size(edges))", "count(*)").first()
    assert 5000 <= held[0] < 6500 and held[1] <= 64 and held[2] < 800
