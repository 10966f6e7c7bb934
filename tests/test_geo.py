import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from heliograph.operators import geo

T = datetime(2026, 9, 20, 12)


def ring(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def shapes(spark):
    fr = [ring((-1.5, 43), (7, 43), (7, 49.3), (-1.5, 49.3))]
    hole = [ring((20, 0), (30, 0), (30, 10), (20, 10)), ring((24, 4), (26, 4), (26, 6), (24, 6))]
    edge = [ring((178, -18), (180, -18), (180, -16), (178, -16))]
    return spark.createDataFrame([("FR", [fr]), ("HO", [hole]), ("FJ", [edge])], f"code string, geom {geo.SHAPE}")


def test_reverse_geocode(spark):
    p = spark.createDataFrame([(1, 2.35, 48.85), (2, -1.0, 49.6), (3, -40.0, 30.0), (4, 25.0, 5.0), (5, 21.0, 1.0), (6, -179.9, -17.0)], "id long, lon double, lat double")
    got = {r.id: r.country for r in geo.reverse_geocode(p, shapes(spark)).collect()}
    assert got[1] == "FR" and got[2] == "FR" and got[3] == "" and got[5] == "HO"
    assert got[4] == ""  # in the hole, more than 100 km from its edge


def test_density_clusters_against_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(0, 0.3) if i % 3 else 0.1 + rnd.uniform(0, 0.004), rnd.uniform(0, 0.3) if i % 3 else 0.1) for i in range(240)]
    eps = 0.012
    root = list(range(len(pts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, b in pts:
        for j, c, d in pts[:i]:
            if math.hypot(a - c, b - d) <= eps:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    got = dict(map(tuple, geo.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), eps).collect()))
    assert got == {i: find(i) for i, *_ in pts}


def test_fires(spark):
    ddl = "id long, lon double, lat double, acq_at timestamp, frp double, confidence string, fire_id long"
    first = spark.createDataFrame([(1, 10.0, 40.0, T, 1.0, "high", None), (2, 10.0, 40.0045, T, 2.0, "low", None), (3, 10.0, 40.045, T, 3.0, "low", None)], ddl)
    none = spark.createDataFrame([], f"fire_id long, hull {geo.HULL}, last_seen timestamp")
    every, fires = geo.track_fires(first.limit(0), first.drop("fire_id"), none)
    assert fires.count() == 2
    later = spark.createDataFrame([(4, 10.0, 39.9937, T + timedelta(hours=24), 1.0, "low", None)], ddl)
    every, touched = geo.track_fires(every, later.drop("fire_id"), fires.select("fire_id", "hull", "last_seen"))
    r = touched.collect()
    assert len(r) == 1 and r[0].detections == 3 and r[0].fire_id == 1 and r[0].high_conf == 1
    e = geo.fire_events(touched, F.lit(T + timedelta(hours=30))).collect()
    assert [x.external_id for x in e] == ["firms:1"] and json.loads(e[0].props)["detections"] == 3
    assert geo.fire_events(touched, F.lit(T + timedelta(hours=24 + 97))).count() == 0
    _, none_touched = geo.track_fires(every, later.drop("fire_id").limit(0), fires.select("fire_id", "hull", "last_seen"))
    assert none_touched.count() == 0


def test_nearest_against_brute_force(spark):
    rnd = random.Random(8)
    points = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(40)] + [(98, 179.9, 0.0), (99, 10.0, 89.9)]
    places = [(i, rnd.uniform(-180, 180), rnd.uniform(-80, 80)) for i in range(60)] + [(i, 10 + i / 1000, 40.0) for i in range(60, 70)] + [(70, -179.9, 0.0)]
    km = lambda a, b: 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    ddl = "id long, lon double, lat double"
    got = geo.nearest(spark.createDataFrame(points, ddl), spark.createDataFrame(places, ddl), 3).collect()
    assert len(got) == 3 * len(points)
    found = {(r.id, r.n): r.place_id for r in got}
    for p in points:
        assert [found[p[0], n] for n in (1, 2, 3)] == [q[0] for q in sorted(places, key=lambda q: (km(p, q), q[0]))[:3]]
    assert geo.nearest(spark.createDataFrame(points, ddl), spark.createDataFrame(places[:2], ddl), 3).count() == 2 * len(points)


def test_hull_and_inner_point(spark):
    p = spark.createDataFrame([("a", float(x), float(y)) for x in range(5) for y in range(5)] + [("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in geo.hulls(p, "g").collect()}
    assert len(got["a"].hull) == 4 and got["b"].area_km2 == 0
    assert abs(got["a"].area_km2 / (4 * 111.195) ** 2 - 1) < 0.01
    u = [ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))]
    q = spark.createDataFrame([(1, [u])], f"id long, s {geo.SHAPE}").select(geo.inner_point(F.col("s")).alias("p"), F.col("s")[0].alias("r"))
    assert q.select(geo.inside(F.col("p.x"), F.col("p.y"), geo.edges_of(F.col("r")))).first()[0]
    small, large = [ring((0, 0), (1, 0), (1.2, 0.5), (1, 1), (0.5, 1.2), (0, 1))], [ring((50, 50), (60, 50), (55, 60))]
    x = spark.createDataFrame([(1, [small, large])], f"id long, s {geo.SHAPE}").select(geo.inner_point(F.col("s")).alias("p")).first().p.x
    assert 50 < x < 60


def test_alerts_are_placed(spark):
    box = [[ring((0, 0), (1, 0), (1, 1), (0, 1))]]
    a = spark.createDataFrame([("x", box, []), ("y", None, ["z1"]), ("z", None, ["none"]), ("w", None, ["z1", "z2"])], f"external_id string, geom {geo.SHAPE}, zones array<string>")
    large = [[ring((20, 0), (29, 0), (29, 9), (20, 9))]]
    z = spark.createDataFrame([("z1", box), ("z2", large), ("z3", None)], f"url string, geom {geo.SHAPE}")
    got = {r.external_id: r for r in geo.place_alerts(a, z).collect()}
    assert set(got) == {"x", "y", "w"} and all(0 < got[i].lon < 1 and 0 < got[i].lat < 1 for i in "xy")
    assert 20 < got["w"].lon < 29  # the union of its zones, not the first
