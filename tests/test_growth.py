"""Steps whose work once grew faster than their input, and results that larger tables showed to be wrong."""

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from heliograph import plans, streaming
from heliograph.operators import gazetteer, geo
from heliograph.plans import landed, runs
from heliograph.sources import files, snapshots
from heliograph.streaming import batches


def test_pointer_state_is_by_hour_not_by_place(spark, tmp_path):
    """400 places of two hours in two batches: a state a group of places, and still the first posts of each place."""
    at = datetime(2026, 9, 20, 12)
    rows = [(at + timedelta(minutes=k), f"u{k:03d}-{p}", p) for p in range(200) for k in (0, 1, 2, 61)]
    land, out, cp = (str(tmp_path / x) for x in ("hits", "out", "cp"))
    kind = "at timestamp, uri string, place_id long"
    run = lambda: streaming.run_once(streaming.first_pointers(spark.readStream.schema(kind).parquet(land), 2), out, cp)
    spark.createDataFrame(rows, kind).write.parquet(land)
    q = run()
    states = sum(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"][:1] if p["numInputRows"])
    assert states <= 2 * streaming.PLACE_GROUPS
    later = [(at + timedelta(minutes=3), f"u003-{p}", p) for p in range(200)] + [(at + timedelta(minutes=62), f"u062-{p}", p) for p in range(200)]
    spark.createDataFrame(later, kind).write.mode("append").parquet(land)
    run()
    got = sorted((r.place_id, r.uri) for r in spark.read.parquet(out).collect())
    assert got == sorted((p, f"u{k:03d}-{p}") for p in range(200) for k in (0, 1, 61, 62))


def test_page_title_resolves_what_its_sql_does(spark, tmp_path):
    titles = ["a &quot;b&quot;", "the&amp", "x &amp; y &lt;z&gt;", "&amp;lt; &#39;", "  "]
    pages = spark.createDataFrame([(k, f"<html><head><title>{t}</title></head><body></body></html>") for k, t in enumerate(titles)], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.title for r in plans.QUERIES["f06_page_title"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(c.execute(plans.SQL["f06_page_title"]).fetchall())


def test_inner_point_works_each_step_out_once(spark):
    """An expression within a lambda is worked out for every use, so none may be there twice."""
    shape = spark.createDataFrame([], f"s {geo.SHAPE}").select(geo.inner_point(F.col("s")).alias("p"))
    assert shape._jdf.queryExecution().analyzed().toString().count("array_sort(") == 2


def test_zones_are_united_once_for_alike_alerts(spark):
    box = lambda x: [[[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]]]
    z = spark.createDataFrame([("u", box(0.0)), ("v", box(5.0)), ("w", None)], f"url string, geom {geo.SHAPE}")
    rows = [("a", None, ["u", "v", "u"]), ("b", None, ["v", "u"]), ("c", box(9.0), ["u"]), ("d", None, ["w", "none"]), ("e", None, []), ("f", None, None), ("g", None, ["v"])]
    got = {r.external_id: (r.lon, r.lat) for r in geo.place_alerts(spark.createDataFrame(rows, f"external_id string, geom {geo.SHAPE}, zones array<string>"), z).collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.5, 0.5), "c": (9.5, 0.5), "g": (5.5, 0.5)}


def test_fires_are_as_near_as_column_expressions_say(spark):
    """Hull distances in Arrow batches against the same by expressions, which no row goes through any more."""
    rng = random.Random(3)
    ring = lambda x, y: [{"x": x + rng.uniform(0, 0.03), "y": y + rng.uniform(0, 0.01)} for _ in range(rng.randint(1, 6))]
    at = datetime(2026, 9, 20, 12)
    fires = spark.createDataFrame([(k, ring(rng.uniform(0, 0.2), 65 + rng.uniform(0, 0.1)), at) for k in range(40)], f"fire_id long, hull {geo.HULL}, last_seen timestamp")
    pixels = spark.createDataFrame([(k, rng.uniform(0, 0.2), 65 + rng.uniform(0, 0.1), at) for k in range(500)], "id long, lon double, lat double, acq_at timestamp")
    met = geo.join_fires(pixels, fires)
    assert "MapInArrow" in met._jdf.queryExecution().executedPlan().toString()
    edges = geo.edges_of(F.array("hull"))
    far, km = geo.edge_distance(F.col("lon"), F.col("lat"), edges), geo.edge_km(F.col("lon"), F.col("lat"), edges)
    every = pixels.crossJoin(fires).withColumn("far", far).filter((F.col("far") <= 0.018) & (km <= 1.0))
    want = every.groupBy("id").agg(F.min(F.struct("far", "fire_id")).alias("b")).select("id", "b.fire_id")
    got = {tuple(r) for r in met.collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 50


def test_links_of_cells_keep_no_pairs_of_points(spark):
    """Two cells of 50 points, all near each other: one link, and no sort of all pairs on the way to it."""
    points = [(k, 0.001 * (k % 10), 0.0) for k in range(50)] + [(100 + k, 0.001 * (k % 10), 0.009) for k in range(50)]
    fine = lambda c: F.floor(F.col(c) / 0.0084 * F.lit(float(1 << geo.HALVINGS))).cast("long")
    placed = spark.createDataFrame(points, "id long, x double, y double").filter("x < 0.008").select("id", "x", "y", fine("x").alias("fx"), fine("y").alias("fy"))
    pair = spark.createDataFrame([(0, 0, 0, 1, 0, 100)], "cx long, cy long, ox long, oy long, a long, o_a long")
    links = geo.compared(placed, pair, 0, 0.012)
    assert [tuple(r) for r in links.collect()] == [(0, 100)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "SortAggregate" not in plan


def test_files_of_a_kind_are_loaded_at_once(spark, tmp_path, monkeypatch):
    """Five files of a kind are parsed in one step, and the ledger still has a row a file, also of one that kept nothing."""
    land, calls = tmp_path / "land", []
    land.mkdir()
    own = files.mention_rows
    monkeypatch.setattr(files, "mention_rows", lambda *a: calls.append(1) or own(*a))
    event = [""] * files.WIDTH
    for name, value in {"external_id": "7", "geo_type": "4", "country": "X", "lat": "1", "lon": "2"}.items():
        event[files.AT[name]] = value
    (land / "0.export").write_text("\t".join(event) + "\n")
    said = lambda k: "\t".join([str(k), "", "20260920120000", "1", "site", *["x"] * 9])
    for n in range(5):
        (land / f"{n}.mentions").write_text(f"{said(7)}\n{said(8)}\n" * n + "short\n")
    batches.load_files(spark, str(land), str(tmp_path / "out"), str(tmp_path / "cp"), 100)
    ledger = {r.file: (r.rows_seen, r.rows_kept) for r in batches.loaded(spark, str(tmp_path / "out"), "ledger").collect()}
    assert ledger == {"0.export": (1, 1), **{f"{n}.mentions": (2 * n + 1, n) for n in range(5)}} and len(calls) == 1


def test_landed_documents_lie_in_one_folder(spark):
    """A file a document, but no folder a document."""
    path = landed.land(spark.range(30).select(F.col("id").cast("string").alias("part"), F.lit("{}").alias("value")), "documents", "part")
    left = [p.name for p in Path(path.removeprefix("file:")).iterdir() if not p.name.startswith((".", "_"))]
    assert len(left) == 30 and all(x.startswith("part-") for x in left)


def test_grams_that_no_name_has_stay_in_their_task(spark):
    """Of some 800 n-grams of a text only those reach the join whose hash some name has, and starts count signs as the automaton's do."""
    text = " ".join(f"Word{k}" for k in range(200)) + " New York City 東京都, St. John's. D.C."
    texts = spark.createDataFrame([(1, text), (2, "in New York City Hall"), (3, None), (None, "York")], "id long, text string")
    rows = [("New York", 1), ("York", 2), ("York", 0), ("New York City Hall", 3), ("東京", 4), ("St. John's", 5), ("D.C.", 6), ("東京都", 7)]
    names = spark.createDataFrame(rows, "name string, place_id long")
    assert gazetteer.grams(texts, gazetteer.name_parts(names)).count() < 20
    both = [sorted((r.id or 0, r.start, r.place_id) for r in match(texts, names).collect()) for match in (gazetteer.match_names, gazetteer.match_by_grams)]
    assert both[0] == both[1] and [p for _, _, p in both[0]] == [0, 1, 7, 5, 6, 3]


def test_more_names_than_workers_hold_go_by_grams(spark, monkeypatch):
    """A quarter of a million names and one more build no automaton, whose size on each worker would follow the names."""
    monkeypatch.setattr(gazetteer, "name_automaton", lambda rows: 1 / 0)
    names = spark.range(250_001).select(F.concat(F.lit("N"), "id").alias("name"), F.col("id").alias("place_id"))
    texts = spark.createDataFrame([(1, "N7 N250000 N250001"), (2, "xN7 N007")], "id long, text string")
    assert sorted(tuple(r) for r in gazetteer.match_names(texts, names).collect()) == [(1, 7, 0), (1, 250_000, 3)]


def test_messages_are_read_once_for_their_hits(spark, tmp_path):
    """Hits carry their post's time and uri along; no second reading of all messages is joined to them."""
    (tmp_path / "1.json").write_text("")
    names = spark.createDataFrame([("Lviv", 7)], "name string, place_id long")
    plan = streaming.place_hits(spark.read.text(str(tmp_path)), names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_lots_are_dealt_before_messages_are_made(spark):
    """What lands first and what later is told by keys of the tables, not by reading the messages made of them again."""
    d = "/root/testdata/sf0.001"
    late = landed.edit_messages(spark, d, F.col("event_id") % 10 == 0)
    every = landed.edit_messages(spark, d)
    assert 0 < late.count() < every.count() and late.exceptAll(every).count() == 0
    for rows in runs.halves(spark, d):
        assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()


def edit_message(user: str | None, at: datetime, rev: int, bot: bool = False) -> str:
    return json.dumps({"wiki": "enwiki", "server_name": "en.wikipedia.org", "title": "T", "namespace": 0, "type": "edit", "user": user, "bot": bot, "timestamp": int(at.replace(tzinfo=timezone.utc).timestamp()), "revision": {"new": rev}})


def test_edit_messages_are_parsed_once(spark):
    """Filters on a message's fields parse it no further time; null, torn and foreign messages still give no row."""
    whole = edit_message("u", datetime(2026, 9, 20, 12), 7)
    rows = snapshots.edit_rows(spark.createDataFrame([(whole,), (None,), ("",), (whole[:60],), (whole.replace('"namespace": 0', '"namespace": 1'),)], "value string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    assert [(r.title, r.rev, r.bot) for r in rows.collect()] == [("T", 7, False)]


def test_state_of_an_hour_grows_with_groups_not_with_editors(spark, tmp_path):
    """2,000 editors of an hour in three batches, many of them again and again: a row of state a group of users, and the exact count."""
    at, land, out, cp = datetime(2026, 9, 20, 12), *(str(tmp_path / x) for x in ("land", "out", "cp"))
    run = lambda: streaming.run_once(streaming.hourly_editors(snapshots.edit_rows(streaming.lines(spark, land))), out, cp)
    put = lambda rows: spark.createDataFrame([(edit_message(*r),) for r in rows], "value string").write.mode("append").text(land)
    states = 0
    for lot in (range(1200), range(800, 2000), range(500, 600)):
        put([(f"u{k}", at + timedelta(minutes=k % 60), k) for k in lot] + [(f"bot{k}", at, -k, True) for k in lot[:5]] + [(None, at, -9)])
        q = run()
        states = max([states, *(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])])
    put([("late", at + timedelta(days=9), 1)])
    run()
    got = [(r.title, r.hour, r.editors) for r in spark.read.parquet(out).collect()]
    assert got == [("T", at, 2000)] and states <= streaming.USER_GROUPS
