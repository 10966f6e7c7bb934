"""Polygons with many corners over many cells, and clusters whose cells hold very many points."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from heliograph.operators import geo


def star(corners, cx, cy, out, within):
    """A ring of that many corners whose radius goes up and down."""
    at = [2 * math.pi * k / corners for k in range(corners)]
    return [{"x": cx + r * math.cos(a), "y": cy + r * math.sin(a)} for k, a in enumerate(at) for r in [out if k % 2 else within + (out - within) * (k % 7) / 8]]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
    return odd


def test_large_polygon_in_many_cells(spark):
    """10,000 corners over some 500 cells: each point's cell has few of the edges, and the result is that of all of them."""
    large = [star(10_000, 10.0, 20.0, 11.0, 10.0), star(300, 10.0, 20.0, 3.0, 2.0)]
    flat = [[{"x": float(x), "y": float(y)} for x, y in ((30, 0), (34, 0), (34, 4), (32, 4), (32, 2), (30, 2))]]
    shapes = spark.createDataFrame([("A", [large]), ("B", [flat]), ("A", [[[{"x": 50.0, "y": 50.0}, {"x": 51.0, "y": 50.0}, {"x": 50.5, "y": 51.0}]]])], f"code string, geom {geo.SHAPE}")
    cells = geo.clipped_cells(shapes, 1.0)
    got = cells.filter("code = 'A'").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("most"), F.count_if((F.size("edges") == 0) & (F.col("base") == 1)).alias("full"), F.max(F.size("flips")).alias("flips")).first()
    assert 300 < got.n < 600 and got.most < 1000 and got.full > 200 and got.flips <= 200
    rnd = random.Random(4)
    points = [(k, rnd.uniform(-2, 22), rnd.uniform(8, 32)) for k in range(1500)] + [(2000 + k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in range(29, 36) for y in range(-1, 6))] + [(3000, 50.5, 50.2), (3001, 50.0, 50.9)]
    found = {r.id: r.code for r in geo.containing(spark.createDataFrame(points, "id long, lon double, lat double"), shapes).collect()}
    for k, x, y in points:
        want = "A" if inside(x, y, large) or k == 3000 else "B" if inside(x, y, flat) else None
        assert found.get(k) == want, (k, x, y)


def test_nearest_shape_by_its_edges(spark):
    """Countries of points outside all shapes, against all edges: within 100 km, nearest in degrees."""
    rnd = random.Random(6)
    rings = {f"S{k}": [star(60, x, y, 2.0, 1.5)] for k, (x, y) in enumerate(((0, 0), (5, 1), (3, 60), (8, 61), (20, 78)))}
    shapes = spark.createDataFrame([(c, [r]) for c, r in rings.items()], f"code string, geom {geo.SHAPE}")
    points = [(k, rnd.uniform(-4, 30), rnd.choice([rnd.uniform(-4, 5), rnd.uniform(56, 65), rnd.uniform(74, 82)])) for k in range(400)]

    def edge(px, py, a, b, by):
        ax, bx, x = a["x"] * by, b["x"] * by, px * by
        dx, dy = bx - ax, b["y"] - a["y"]
        s = min(max(((x - ax) * dx + (py - a["y"]) * dy) / (dx * dx + dy * dy), 0), 1)
        return math.hypot(x - ax - s * dx, py - a["y"] - s * dy)

    def country(x, y):
        if held := [c for c, r in rings.items() if inside(x, y, r)]:
            return min(held)
        near = []
        for c, (r,) in rings.items():
            edges = list(zip(r, [*r[1:], r[0]], strict=True))
            if min(edge(x, y, a, b, math.cos(math.radians(y))) for a, b in edges) * geo.KM_PER_DEGREE <= 100:
                near.append((min(edge(x, y, a, b, 1.0) for a, b in edges), c))
        return min(near)[1] if near else ""

    got = {r.id: r.country for r in geo.reverse_geocode(spark.createDataFrame(points, "id long, lon double, lat double"), shapes).collect()}
    assert got == {k: country(x, y) for k, x, y in points} and len(set(got.values())) > 4


def test_fill_country_asks_for_blank_ones_only(spark):
    box = [[[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]]]
    rows = spark.createDataFrame([(1, 0.5, 0.5, ""), (2, 0.5, 0.5, "ZZ"), (3, 50.0, 50.0, None), (4, 0.2, 0.2, None)], "id long, lon double, lat double, country string")
    got = {r.id: r.country for r in geo.fill_country(rows, spark.createDataFrame([("AA", box)], f"code string, geom {geo.SHAPE}")).collect()}
    assert got == {1: "AA", 2: "ZZ", 3: "", 4: "AA"}


def groups(points, eps):
    """Clusters by a grid of cells of side eps, each compared with its neighbours point by point."""
    cells = {}
    for k, (i, x, y) in enumerate(points):
        cells.setdefault((math.floor(x / eps), math.floor(y / eps)), []).append(k)
    root = list(range(len(points)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    xy = np.array([p[1:] for p in points])
    for (cx, cy), own in cells.items():
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for k in own:
                    other = np.array(cells.get((cx + dx, cy + dy), []), dtype=int)
                    for o in other[np.hypot(*(xy[other] - xy[k]).T) <= eps]:
                        a, b = find(k), find(int(o))
                        root[max(a, b)] = min(a, b)
    return {points[k][0]: points[find(k)][0] for k in range(len(points))}


def test_dense_cells_are_halved(spark, monkeypatch):
    """Clumps near and just beyond each other, with so low a bound that every pair of cells is halved again and again."""
    rnd = random.Random(7)
    eps = 0.01
    middles = [(0.0, 0.0), (0.0099, 0.0), (0.0201, 0.0), (0.05, 0.05), (0.0599, 0.0501), (0.071, 0.071)]
    points = [(k, x + rnd.gauss(0, 0.0003), y + rnd.gauss(0, 0.0003)) for k, (x, y) in enumerate(rnd.choice(middles) for _ in range(900))]
    monkeypatch.setattr(geo, "MOST_PAIRS", 4)
    got = dict(map(tuple, geo.density_clusters(spark.createDataFrame(points, "id long, x double, y double"), eps).collect()))
    assert got == groups(points, eps) and len(set(got.values())) >= 2


def test_a_hundred_thousand_points_in_four_cells(spark):
    """Two halves a hair more than eps apart: all pairs of two cells would be over six hundred million."""
    eps, n = 0.01, 50_000
    side = eps / math.sqrt(2)
    halves = spark.range(2 * n).select("id", F.rand(3).alias("u"), F.rand(4).alias("v"), (F.col("id") % 2).alias("half"))
    # The halves end at x = 0 and begin at x = eps and a little; of each, the points fill the cell that ends there.
    x = F.when(F.col("half") == 0, -F.col("u") * side * 0.99).otherwise(F.lit(eps * 1.0001) + F.col("u") * side * 0.4)
    points = halves.select("id", x.alias("x"), (F.col("v") * side * 1.9 + 0.0001).alias("y"))
    got = geo.density_clusters(points, eps).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sorted((r.cluster, r.n) for r in got) == [(0, n), (1, n)]
