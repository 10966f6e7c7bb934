"""Places on a plane: points in polygons, nearest polygons, density clusters, hulls and fires that grow.

Spatial joins are equalities on grid cells, then exact tests as column expressions over a polygon's edges. A polygon is an array of
rings of (x, y) structs, the first one outer; a shape is an array of polygons.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from heliograph.functions import planar, sphere_km
from heliograph.shared import checkpointed

KM_PER_DEGREE = 111.195
SHAPE = "array<array<array<struct<x: double, y: double>>>>"


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def around(c: Column, size: float, by: int = 1) -> Column:
    """The cells from `by` below to `by` above."""
    return F.explode(F.sequence(cell(c, size) - by, cell(c, size) + by))


EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def named(value: Column, then) -> Column:
    """then(value), where value is worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def edges_of(rings: Column) -> Column:
    """The edges of all rings of a polygon; a ring's last point need not repeat its first."""
    ring = lambda r: F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at(r, F.pmod(i + 1, F.size(r)) + 1)["x"].alias("x2"), F.element_at(r, F.pmod(i + 1, F.size(r)) + 1)["y"].alias("y2")))
    return F.flatten(F.transform(rings, ring))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over a polygon's edges; a point on its left or lower edge is inside."""
    crossed = lambda e: F.when((e["y1"] > y) != (e["y2"] > y), x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)
    return F.pmod(F.size(F.filter(edges, crossed)), F.lit(2)) == 1


def nearest_edge(x: Column, y: Column, edges: Column, squeeze: Column | float = 1.0) -> Column:
    """Distance in degrees from a point to the nearest of some edges, x shrunk by `squeeze`."""
    by = squeeze if isinstance(squeeze, Column) else F.lit(squeeze)

    def to_edge(e: Column) -> Column:
        dx, dy, px, py = (e["x2"] - e["x1"]) * by, e["y2"] - e["y1"], (x - e["x1"]) * by, y - e["y1"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.least(F.greatest((px * dx + py * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))

    return F.array_min(F.transform(edges, to_edge))


def edge_distance(x: Column, y: Column, edges: Column, squeeze: Column | float = 1.0) -> Column:
    """Distance in degrees from a point to a polygon, given by all its edges; 0 inside."""
    return F.when(inside(x, y, edges), 0.0).otherwise(nearest_edge(x, y, edges, squeeze))


def edge_km(x: Column, y: Column, edges: Column) -> Column:
    return edge_distance(x, y, edges, F.cos(F.radians(y))) * KM_PER_DEGREE


def covered_cells(shapes: DataFrame, size: float, margin_km: float = 0.0) -> DataFrame:
    """(code, edges, cx, cy): each polygon with all its edges at the cells of its bounding box, widened by the margin; x wraps at
    180. For shapes of few edges, like hulls; see `clipped_cells` and `edge_cells` for others."""
    parts = shapes.select("code", F.explode("geom").alias("rings"))
    outer = F.col("rings")[0]
    box = parts.select("code", edges_of(F.col("rings")).alias("edges"), *(f(outer.getField(k)).alias(n) for n, f, k in (("x1", F.array_min, "x"), ("x2", F.array_max, "x"), ("y1", F.array_min, "y"), ("y2", F.array_max, "y"))))
    dy = F.lit(margin_km / KM_PER_DEGREE)
    dx = dy / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs("y1"), F.abs("y2")) + dy, F.lit(89.0)))), F.lit(0.01))
    n = round(360 / size)
    xs = F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("x1") - dx, size), cell(F.col("x2") + dx, size)), lambda i: F.pmod(i, F.lit(n)))))
    ys = F.explode(F.sequence(cell(F.col("y1") - dy, size), cell(F.col("y2") + dy, size)))
    return box.select("code", "edges", xs.alias("cx"), "y1", "y2").select("code", "edges", "cx", ys.alias("cy"))


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", F.pmod(cell(F.col("lon"), size), F.lit(round(360 / size)))).withColumn("cy", cell(F.col("lat"), size))


def edge_rows(shapes: DataFrame) -> DataFrame:
    """(code, part, x1, y1, x2, y2): every edge of every polygon of a shape; polygons of a code are numbered in their own order."""
    whole = shapes.groupBy("code").agg(F.flatten(F.array_sort(F.collect_list("geom"))).alias("geom"))
    return whole.select("code", F.posexplode("geom").alias("part", "rings")).select("code", "part", F.explode(edges_of(F.col("rings"))).alias("e")).select("code", "part", "e.*")


#: Edges this near to a border count as on both of its sides, so that rounding never takes one away.
SLACK = 1e-9
CLIPPED = f"cx long, cy long, base int, flips array<double>, edges {EDGES}"


def clip_band(size: float):
    """For the edges of one polygon in one band of cells: what each cell of the band has to know. A ray to the right from a point of
    a cell crosses some of the cell's own edges, and of those beyond the cell all whose heights it lies between. The latter are kept
    as the heights at which the number of crossings changes: heights that occur twice cancel out, so a chain of any number of
    edges is as two."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        code, cy = rows["code"].iloc[0], int(rows["cy"].iloc[0])
        floor, top = cy * size, (cy + 1) * size
        x1, y1, x2, y2 = (rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        low, high = np.minimum(y1, y2), np.maximum(y1, y2)
        slope = np.divide(x2 - x1, y2 - y1, out=np.zeros(len(x1)), where=y1 != y2)
        ends = [np.where(y1 == y2, x, x1 + slope * (np.clip(y, low, high) - y1)) for x, y in ((x1, floor), (x2, top))]
        first = np.floor((np.minimum(*ends) - SLACK) / size).astype("int64")
        last = np.floor((np.maximum(*ends) + SLACK) / size).astype("int64")
        own: dict[int, list[int]] = {}
        for k in np.flatnonzero(y1 != y2):
            for c in range(first[k], last[k] + 1):
                own.setdefault(c, []).append(k)
        order, at, heights, out = np.argsort(-first, kind="stable"), 0, set(), []
        for c in range(int(last.max()), int(first.min()) - 1, -1):
            while at < len(order) and first[order[at]] > c:
                k = order[at]
                if low[k] < high[k]:
                    heights ^= {low[k], high[k]}
                at += 1
            base = sum(h <= floor - SLACK for h in heights) % 2
            flips = sorted(h for h in heights if floor - SLACK < h < top + SLACK)
            edges = [{"x1": x1[k], "y1": y1[k], "x2": x2[k], "y2": y2[k]} for k in own.get(c, [])]
            if base or flips or edges:
                out.append((code, c, cy, base, flips, edges))
        return pd.DataFrame(out, columns=["code", "cx", "cy", "base", "flips", "edges"])

    return run


def clipped_cells(shapes: DataFrame, size: float) -> DataFrame:
    """(code, cx, cy, base, flips, edges): the cells that a shape reaches, each with the edges that cross it alone; cells wholly
    within carry none (base 1)."""
    kind = shapes.schema["code"].dataType.simpleString()
    bands = edge_rows(shapes).withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2"), size), cell(F.greatest("y1", "y2"), size))))
    cells = bands.groupBy("code", "part", "cy").applyInPandas(clip_band(size), f"code {kind}, {CLIPPED}")
    return cells.withColumn("cx", F.pmod("cx", F.lit(round(360 / size))))


def within_cell(x: Column, y: Column) -> Column:
    """Whether a point of a clipped cell is inside: an odd number of crossings in all; see `inside`."""
    crossed = lambda e: F.when((e["y1"] > y) != (e["y2"] > y), x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)
    beyond = F.size(F.filter("flips", lambda h: h <= y))
    return F.pmod(F.col("base") + beyond + F.size(F.filter("edges", crossed)), F.lit(2)) == 1


def containing(points: DataFrame, shapes: DataFrame, size: float = 1.0) -> DataFrame:
    """(id, code) of the shape that holds each point, the least code of several."""
    near = with_cell(points, size).join(clipped_cells(shapes, size), ["cx", "cy"])
    return near.filter(within_cell(F.col("lon"), F.col("lat"))).groupBy("id").agg(F.min("code").alias("code"))


def edge_cells(shapes: DataFrame, size: float, margin_km: float) -> DataFrame:
    """(code, cx, cy, edges): at each cell the edges of a shape that may be within the margin of one of its points, in km or in
    degrees of either axis."""
    rows = edge_rows(shapes)
    dy = F.lit(margin_km / KM_PER_DEGREE)
    widest = F.least(F.greatest(F.abs("y1"), F.abs("y2")) + dy, F.lit(89.0))
    by = dy / F.greatest(F.cos(F.radians(widest)), F.lit(0.01))
    n = round(360 / size)
    xs = F.explode(F.array_distinct(F.transform(F.sequence(cell(F.least("x1", "x2") - by, size), cell(F.greatest("x1", "x2") + by, size)), lambda i: F.pmod(i, F.lit(n)))))
    ys = F.explode(F.sequence(cell(F.least("y1", "y2") - by, size), cell(F.greatest("y1", "y2") + by, size)))
    spread = rows.withColumn("by", by).withColumn("cx", xs).withColumn("cy", ys)
    return spread.groupBy("code", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def reverse_geocode(points: DataFrame, shapes: DataFrame, most_km: float = 100.0, size: float = 1.0) -> DataFrame:
    """points with country: the shape that holds them, else the nearest within most_km (nearest in degrees, as
    the limit is in km), else ''."""
    held = checkpointed(containing(points, shapes, size))
    left = points.join(held, "id", "left_anti")
    x, y = F.col("lon"), F.col("lat")
    near = with_cell(left, size).join(edge_cells(shapes, size, most_km), ["cx", "cy"])
    near = near.filter(nearest_edge(x, y, F.col("edges"), F.cos(F.radians(y))) * KM_PER_DEGREE <= most_km).withColumn("deg", nearest_edge(x, y, F.col("edges")))
    best = near.groupBy("id").agg(F.min(F.struct("deg", "code")).alias("b")).select("id", F.col("b.code").alias("code"))
    return points.join(held.unionByName(best), "id", "left").withColumn("country", F.coalesce("code", F.lit(""))).drop("code")


def fill_country(rows: DataFrame, shapes: DataFrame, most_km: float = 100.0) -> DataFrame:
    """Only rows without a country are placed."""
    known = F.coalesce("country", F.lit("")) != ""
    return rows.filter(known).unionByName(reverse_geocode(rows.filter(~known).drop("country"), shapes, most_km).select(*rows.columns))


#: Most pairs of points that two cells may have to be compared point by point; beyond that cells are halved first.
MOST_PAIRS = 1 << 16
#: How often cells are halved; what is still open then is compared point by point.
HALVINGS = 20
SQUARE = ["n", "a", "x1", "x2", "y1", "y2"]


def squares(points: DataFrame, level: int) -> DataFrame:
    """Cells of a level (side / 2^level) with their points' number, least id and bounding box; fx and fy are places of the finest level."""
    at = lambda c: F.shiftright(c, HALVINGS - level)
    return points.groupBy(at("fx").alias("cx"), at("fy").alias("cy")).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))


def far_side(cells: DataFrame) -> DataFrame:
    """The same cells under other names, for the second cell of a pair."""
    return cells.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), *(F.col(c).alias(f"o_{c}") for c in SQUARE))


def judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of cells that may hold points at most eps apart, with `sure` where all of their points are."""
    zero = F.lit(0.0)
    gap = [F.greatest(F.col(f"o_{k}1") - F.col(f"{k}2"), F.col(f"{k}1") - F.col(f"o_{k}2"), zero) for k in ("x", "y")]
    span = [F.greatest(F.col(f"o_{k}2") - F.col(f"{k}1"), F.col(f"{k}2") - F.col(f"o_{k}1")) for k in ("x", "y")]
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    return pairs.filter(length(gap) <= eps * (1 + 1e-9)).withColumn("sure", length(span) <= eps * (1 - 1e-9))


def compared(points: DataFrame, pairs: DataFrame, level: int, eps: float) -> DataFrame:
    """(a, b): a link of each pair of cells that has one, between their least points, to which all others of their cells are linked. A point
    is done with another cell at the first point that is near; nothing is kept of a pair of cells but that it has a link."""
    at = lambda c: F.shiftright(c, HALVINGS - level)
    one = points.select(F.col("x").alias("ax"), F.col("y").alias("ay"), at("fx").alias("cx"), at("fy").alias("cy"))
    two = points.select(F.col("x").alias("bx"), F.col("y").alias("by"), at("fx").alias("ox"), at("fy").alias("oy"))
    asked = pairs.select("cx", "cy", "ox", "oy", F.col("a").alias("least"), F.col("o_a").alias("o_least")).join(one, ["cx", "cy"]).alias("l")
    near = planar(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps
    met = asked.join(two.alias("r"), (F.col("l.ox") == F.col("r.ox")) & (F.col("l.oy") == F.col("r.oy")) & near, "left_semi")
    return met.select(F.col("least").alias("a"), F.col("o_least").alias("b")).distinct()


def near_edges(points: DataFrame, eps: float) -> DataFrame:
    """(a, b): enough links between points at most eps apart to connect each group. Points of one cell of side eps / sqrt(2) are all
    within eps, so they link to the least of them. Whether two cells have a link is told by their points' bounding boxes, by
    comparing points where these are few, and else by halving both cells again and again: of the quarters, those too far apart go, and
    the first that are surely near settle the pair. No step compares more than MOST_PAIRS points for a pair of cells."""
    side = eps / math.sqrt(2) * (1 - 1e-12)
    fine = lambda c: F.floor(F.col(c) / side * F.lit(float(1 << HALVINGS))).cast("long")
    placed = checkpointed(points.select("id", "x", "y", fine("x").alias("fx"), fine("y").alias("fy")))
    cells = checkpointed(squares(placed, 0))
    at = lambda c: F.shiftright(c, HALVINGS)
    within = placed.select("id", at("fx").alias("cx"), at("fy").alias("cy")).join(cells.select("cx", "cy", "a"), ["cx", "cy"]).filter("id <> a").select("a", F.col("id").alias("b"))
    near = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)))
    pairs = cells.withColumn("_d", F.explode(near)).withColumn("ox", F.col("cx") + F.col("_d.i")).withColumn("oy", F.col("cy") + F.col("_d.j")).drop("_d").join(far_side(cells), ["ox", "oy"])
    pairs = checkpointed(judged(pairs, eps).withColumn("pair", F.struct("cx", "cy", "ox", "oy")))
    links, level = within, 0
    while True:
        small = (F.col("n") * F.col("o_n") <= MOST_PAIRS) | F.lit(level == HALVINGS)
        links = links.unionByName(pairs.filter("sure").select("a", F.col("o_a").alias("b"))).unionByName(compared(placed, pairs.filter(~F.col("sure") & small), level, eps))
        crowded = pairs.filter(~F.col("sure") & ~small)
        if level == HALVINGS or not crowded.limit(1).count():
            return links
        settled = pairs.filter("sure").select("pair").distinct()
        left = checkpointed(crowded.join(settled, "pair", "left_anti").select("pair", "cx", "cy", "ox", "oy"))
        if not left.limit(1).count():
            return links
        # Quarters of the cells of open pairs.
        level += 1
        both = left.select("cx", "cy").union(left.select("ox", "oy")).distinct()
        up = lambda c: F.shiftright(c, HALVINGS - level + 1)  # noqa: B023, E731
        quarters = checkpointed(squares(placed.join(both.select(F.col("cx").alias("_x"), F.col("cy").alias("_y")), (up("fx") == F.col("_x")) & (up("fy") == F.col("_y")), "left_semi"), level))
        parent = lambda c: F.shiftright(c, 1)
        one = quarters.withColumn("px", parent("cx")).withColumn("py", parent("cy"))
        two = far_side(quarters).withColumn("qx", parent("ox")).withColumn("qy", parent("oy"))
        open_ = left.select("pair", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("ox").alias("qx"), F.col("oy").alias("qy"))
        pairs = checkpointed(judged(open_.join(one, ["px", "py"]).join(two, ["qx", "qy"]).drop("px", "py", "qx", "qy"), eps))


def reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): the least id each node is connected to. Every round, the neighbours of a node that are greater
    than it hang on to the least of them all, then the lesser ones do; trees flatten in a few rounds."""
    now = checkpointed(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct())
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or not seen["n"]:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        mark = seen
        ways = now.select(F.col("lo").alias("v"), F.col("hi").alias("w")).unionByName(now.select(F.col("hi").alias("v"), F.col("lo").alias("w")))
        best = ways.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        up = ways.filter("w > v").join(best, "v").select(F.col("w").alias("hi"), F.col("m").alias("lo")).filter("lo <> hi").distinct()
        low = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = up.join(low, "hi")
        now = checkpointed(down.select("hi", F.col("m").alias("lo")).unionByName(down.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).filter("lo <> hi").distinct())
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def density_clusters(points: DataFrame, eps: float) -> DataFrame:
    """(id, cluster): connected components of the points at most eps apart (clusters from one point on)."""
    roots = reachable(near_edges(points, eps))
    return points.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def hull_of(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the least; a point or a segment may be all."""
    pts = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(pts) < 3:
        return pts

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def area_km2(ring: list[tuple[float, float]]) -> float:
    """Area of a ring of (lon, lat) on a sphere."""
    if len(ring) < 3:
        return 0.0
    lon, lat = np.radians(np.array(ring)).T
    return abs(float(((np.roll(lon, -1) - lon) * (2 + np.sin(lat) + np.sin(np.roll(lat, -1)))).sum())) / 2 * 6371.0088**2


HULL = "array<struct<x: double, y: double>>"


def hulls(points: DataFrame, by: str) -> DataFrame:
    """by, hull, area_km2 and a point of the hull (px, py). Points of a group are first dealt by 32 salts, and the hull of the
    salts' hulls is the group's, so that no task gets all points of a large group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ring = hull_of(rows["x"].to_numpy(), rows["y"].to_numpy())
        return pd.DataFrame({by: rows[by].iloc[0], "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    kind = points.schema[by].dataType.simpleString()
    thin = points.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(32))).groupBy(by, "_salt").applyInPandas(lambda r: one(r), f"{by} {kind}, x double, y double")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        ring = hull_of(rows["x"].to_numpy(), rows["y"].to_numpy())
        px, py = np.array(ring).mean(0)
        return pd.DataFrame({by: [rows[by].iloc[0]], "hull": [[{"x": a, "y": b} for a, b in ring]], "area_km2": [area_km2(ring)], "px": [px], "py": [py]})

    return thin.groupBy(by).applyInPandas(whole, f"{by} {kind}, hull {HULL}, area_km2 double, px double, py double")


def inner_point(shape: Column) -> Column:
    """A point (x, y) within a shape: the middle of the widest inner stretch of its part with the largest area, on a line halfway
    between two of its corners' latitudes."""
    area = lambda rings: F.abs(F.aggregate(edges_of(F.array(rings[0])), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    largest = F.array_max(F.transform(shape, lambda rings, i: F.struct(area(rings).alias("area"), (-i).alias("i"))))

    def stretches(edges: Column, y: Column) -> Column:
        cuts = F.array_sort(F.transform(F.filter(edges, lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        pairs = lambda c: F.transform(c, lambda x, i: F.struct((F.get(c, i + 1) - x).alias("wide"), ((F.get(c, i + 1) + x) / 2).alias("x"), y.alias("y")))
        return F.filter(named(cuts, pairs), lambda p, i: (i % 2 == 0) & p["wide"].isNotNull())

    def widest(edges: Column) -> Column:
        ys = F.array_sort(F.array_distinct(F.transform(edges, lambda e: e["y1"])))
        lines = named(ys, lambda v: F.filter(F.transform(v, lambda y, i: (y + F.get(v, i + 1)) / 2), lambda y: y.isNotNull()))
        return F.array_max(F.flatten(F.transform(lines, lambda y: stretches(edges, y))))

    def within(part: Column) -> Column:
        corner = F.struct(part[0][0]["x"].alias("x"), part[0][0]["y"].alias("y"))
        best = named(edges_of(part), widest)
        return named(best, lambda b: F.coalesce(F.when(b.isNotNull(), F.struct(b["x"].alias("x"), b["y"].alias("y"))), corner))

    return named(F.element_at(shape, -largest["i"] + 1), within)


def place_alerts(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """Alerts with lon and lat: on their own shape, else on the parts of all their zones together; others are dropped. Zones are put
    together once for all alerts that have the same ones."""
    blank = alerts.filter("geom is null")
    sets = blank.select("external_id", F.explode("zones").alias("url")).groupBy("external_id").agg(F.array_sort(F.collect_set("url")).alias("_urls"))
    known = sets.select("_urls").distinct().select("_urls", F.explode("_urls").alias("url")).join(zones.filter("geom is not null").select("url", F.col("geom").alias("zone")), "url")
    unions = known.groupBy("_urls").agg(F.flatten(F.array_sort(F.collect_list("zone"))).alias("zone")).select("_urls", inner_point(F.col("zone")).alias("_p"))
    own = alerts.filter("geom is not null").withColumn("_p", inner_point(F.col("geom")))
    both = own.unionByName(blank.join(sets, "external_id").join(unions, "_urls").select(*alerts.columns, "_p"))
    return both.select(*alerts.columns, F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat"))


def hull_distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`edge_distance` and, with x shrunk by `squeeze`, the same in km, of rows (id, fire_id, lon, lat, squeeze, edges), some thousand rows at
    a time; edges with a missing coordinate count as none."""
    for batch in batches:
        rows = batch.filter(pc.greater(pc.list_value_length(batch.column("edges")), 0))
        if not rows.num_rows:
            continue
        listed = rows.column("edges")
        counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        e = listed.flatten()
        x1, y1, x2, y2 = (pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False) for c in e.flatten())
        x, y, by = (np.repeat(rows.column(c).to_numpy(zero_copy_only=False), counts) for c in ("lon", "lat", "squeeze"))
        starts = np.cumsum(counts) - counts
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inner = np.add.reduceat(crossed.astype("int64"), starts) % 2 == 1

            def far(by) -> np.ndarray:
                dx, dy, px, py = (x2 - x1) * by, y2 - y1, (x - x1) * by, y - y1
                long = dx * dx + dy * dy
                t = np.where(long > 0, np.minimum(np.maximum((px * dx + py * dy) / long, 0.0), 1.0), 0.0)
                to_edge = np.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
                return np.where(inner, 0.0, np.fmin.reduceat(to_edge, starts))

            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("fire_id"), pa.array(far(1.0)), pa.array(far(by) * KM_PER_DEGREE)], names=["id", "fire_id", "far", "km"])


def join_fires(pixels: DataFrame, fires: DataFrame, km: float = 1.0, hours: int = 48, size: float = 0.05, degrees: float = 0.018) -> DataFrame:
    """(id, fire_id): the fire nearest in degrees, of equals the least id, of those whose hull is within `km` and `degrees` of a
    detection and that were seen within `hours` before it. fires has fire_id, hull, last_seen; pixels has id, lon, lat, acq_at."""
    shapes = fires.select(F.col("fire_id").alias("code"), F.array(F.array("hull")).alias("geom"))
    cells = covered_cells(shapes, size, km).withColumnRenamed("code", "fire_id").join(fires.select("fire_id", "last_seen"), "fire_id")
    near = with_cell(pixels, size).join(cells, ["cx", "cy"]).filter(F.col("last_seen") > F.col("acq_at") - F.expr(f"interval {hours} hours"))
    asked = near.select("id", "fire_id", *(F.col(c).cast("double").alias(c) for c in ("lon", "lat")), F.cos(F.radians("lat")).alias("squeeze"), "edges")
    kinds = StructType([asked.schema["id"], asked.schema["fire_id"], StructField("far", DoubleType()), StructField("km", DoubleType())])
    near = asked.mapInArrow(hull_distances, kinds).filter((F.col("far") <= degrees) & (F.col("km") <= km))
    return near.groupBy("id").agg(F.min(F.struct("far", "fire_id")).alias("b")).select("id", F.col("b.fire_id").alias("fire_id"))


def fire_totals(pixels: DataFrame) -> DataFrame:
    """Totals of each fire over its detections (fire_id, lon, lat, frp, confidence, acq_at)."""
    frp = lambda f: F.coalesce(f("frp"), F.lit(0.0))
    sums = pixels.groupBy("fire_id").agg(F.count("*").alias("detections"), F.count_if(F.col("confidence").isin("high", "h")).alias("high_conf"), frp(F.sum).alias("frp_sum"), frp(F.max).alias("frp_max"), F.min("acq_at").alias("first_seen"), F.max("acq_at").alias("last_seen"))
    return sums.join(hulls(pixels.select("fire_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "fire_id"), "fire_id")


def cluster_heads(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(cluster, fire_id): the first detection of each cluster, by time and then id."""
    return rows.join(clusters, "id").groupBy("cluster").agg(F.min_by("id", F.struct("acq_at", "id")).alias("fire_id"))


def track_fires(pixels: DataFrame, new: DataFrame, fires: DataFrame, eps: float = 0.009) -> tuple[DataFrame, DataFrame]:
    """(detections with fire_id, totals of the touched fires): new detections join live fires, the rest cluster
    among themselves and each cluster is a new fire, named after its first detection. Both are written out, so that the next
    run does not plan this one again."""
    named = checkpointed(join_fires(new, fires))
    rest = checkpointed(new.join(named, "id", "left_anti"))
    if rest.limit(1).count():
        clusters = checkpointed(density_clusters(rest.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), eps))
        named = checkpointed(named.unionByName(clusters.join(cluster_heads(clusters, rest), "cluster").select("id", "fire_id")))
    every = checkpointed(pixels.unionByName(new.join(named, "id").select(*pixels.columns)))
    return every, checkpointed(fire_totals(every.join(named.select("fire_id").distinct(), "fire_id", "left_semi")))


def fire_events(totals: DataFrame, as_of: Column, hours: int = 96) -> DataFrame:
    """What a fire's event row becomes after a run: a point of its hull and its totals as JSON, of fires seen within `hours`."""
    shown = {"kind": F.lit("fire"), "title": F.lit("Active fire"), "detections": F.col("detections"), "high_conf": F.col("high_conf"), "frp_sum": F.round("frp_sum", 1), "frp_max": F.round("frp_max", 1), "first_seen": F.col("first_seen"), "last_seen": F.col("last_seen"), "area_km2": F.round("area_km2", 2)}
    recent = totals.filter(F.col("last_seen") > as_of - F.expr(f"interval {hours} hours"))
    return recent.select(F.concat(F.lit("firms:"), F.col("fire_id").cast("string")).alias("external_id"), F.col("px").alias("lon"), F.col("py").alias("lat"), F.to_json(F.struct(*(v.alias(k) for k, v in shown.items()))).alias("props"))


EARTH_KM = 6371.0088
#: Sides of the cubes, on a sphere of radius 1, in which near places are looked for; the last ones hold the whole sphere.
WIDENING = (0.01, 0.04, 0.16, 0.64, 2.0)


def on_sphere(lon: Column, lat: Column) -> dict[str, Column]:
    """Coordinates on a sphere of radius 1, where neither poles nor the date line are special."""
    u, v = F.radians(lon), F.radians(lat)
    return {"sx": F.cos(v) * F.cos(u), "sy": F.cos(v) * F.sin(u), "sz": F.sin(v)}


def nearest(points: DataFrame, places: DataFrame, k: int = 1) -> DataFrame:
    """The k places nearest to each point by great circle (id, lon, lat and other columns of points, place_id, km, n), ties to the
    smaller id. Points meet the places of the 27 cubes around them; a point whose k-th place is farther than a cube's side goes on
    to wider cubes."""
    axes = ("sx", "sy", "sz")
    named = places.select(F.col("id").alias("place_id"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), *(v.alias(a) for a, v in on_sphere(F.col("lon"), F.col("lat")).items()))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("km", "place_id"))
    far = sphere_km(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"))
    left, out = points, None
    for side in WIDENING:
        asked = left
        for a, v in on_sphere(F.col("lon"), F.col("lat")).items():
            asked = asked.withColumn(f"_{a}", around(v, side))
        cubes = named.select("place_id", "p_lon", "p_lat", *(cell(F.col(a), side).alias(f"_{a}") for a in axes))
        near = asked.join(cubes, [f"_{a}" for a in axes]).withColumn("km", far).withColumn("n", rank).filter(F.col("n") <= k).drop(*(f"_{a}" for a in axes))
        if side != WIDENING[-1]:
            clear = 2 * EARTH_KM * math.asin(side / 2) * (1 - 1e-9)
            near = near.withColumn("_last", F.max(F.struct("n", "km")).over(Window.partitionBy("id"))).filter((F.col("_last.n") == k) & (F.col("_last.km") < clear)).drop("_last")
        near = checkpointed(near)
        out = near if out is None else out.unionByName(near)
        left = checkpointed(left.join(near.select("id").distinct(), "id", "left_anti"))
        if not left.limit(1).count():
            break
    return out
