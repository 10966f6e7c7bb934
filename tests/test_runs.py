"""Publishing by day, the runner of sources, counted writes, and streams whose batches fail, reload, retract and freeze."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliograph import streaming
from heliograph.operators import archive, gazetteer, geo, publish, source_jobs
from heliograph.sources import snapshots
from heliograph.streaming import batches

DAY = date(2026, 9, 20)


def rows_of(spark, folder, since=None):
    return sorted((r.day, r.k, r.n) for r in publish.current(spark, folder, "k string, n long", since).collect())


def test_publish_by_day(spark, tmp_path):
    folder = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "day date, k string, n long")
    assert rows_of(spark, folder) == []
    one = publish.publish(frame((DAY, "a", 1), (DAY + timedelta(1), "a", 2), (DAY + timedelta(2), "a", 3)), folder)
    publish.publish(frame((DAY, "b", 5)), folder, spark.createDataFrame([(DAY + timedelta(1),)], "day date"))
    # The second run's days are replaced whole; one of them has no rows any more.
    assert rows_of(spark, folder) == [(DAY, "b", 5), (DAY + timedelta(2), "a", 3)]
    assert rows_of(spark, folder, F.lit(DAY + timedelta(1))) == [(DAY + timedelta(2), "a", 3)]
    with pytest.raises(Exception, match="stop"):
        publish.publish(frame((DAY, "c", 9)).withColumn("n", F.raise_error(F.lit("stop")).cast("long")), folder)
    assert rows_of(spark, folder)[0] == (DAY, "b", 5) and publish.unused(spark, folder).count() == 0
    publish.publish(frame((DAY + timedelta(2), "z", 7)), folder)
    assert [r.run for r in publish.unused(spark, folder).collect()] == [one]
    assert publish.publish(frame((DAY, "a", 1)).limit(0), folder) is None and len(rows_of(spark, folder)) == 2


def test_counted_write(spark, tmp_path):
    rows = spark.range(10).withColumn("kept", F.col("id") > 3)
    assert source_jobs.counted_write(rows, F.col("kept"), str(tmp_path / "w")) == {"rows_seen": 10, "rows_kept": 6}
    assert source_jobs.counted_write(rows.filter("id < 0"), F.col("kept"), str(tmp_path / "w")) == {"rows_seen": 0, "rows_kept": 0}
    assert spark.read.parquet(str(tmp_path / "w")).count() == 0


def quake(k, ms, lat, mag=5.0):
    return {"id": k, "properties": {"mag": mag, "place": "p", "time": ms, "updated": ms}, "geometry": {"coordinates": [0.5, lat, 1.0]}}


def test_runner_of_sources(spark, tmp_path):
    box = [[[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]]]
    shapes = spark.createDataFrame([("AA", box)], f"code string, geom {geo.SHAPE}")
    job, base = source_jobs.SourceJob("quakes", snapshots.quakes), spark.createDataFrame([], snapshots.schemas.EVENT)
    for n, features in enumerate(([quake("a", 1000, 0.5), quake("b", 1000, 40.0)], [quake("a", 2000, 70.0), quake("c", 2000, 0.2), quake("d", 1, 1.0, None)])):
        (tmp_path / f"{n}.json").write_text(json.dumps({"features": features}))
    now = F.lit(datetime(2026, 9, 20, 12))
    first, log = source_jobs.run_source(spark, job, str(tmp_path / "0.json"), base, shapes, now)
    assert {r.external_id: r.country for r in first.collect()} == {"a": "AA", "b": ""}
    second, log = source_jobs.run_source(spark, job, str(tmp_path / "1.json"), first, shapes, now)
    # A country once found holds, though the quake now lies elsewhere.
    assert {r.external_id: r.country for r in second.collect()} == {"a": "AA", "b": "", "c": "AA"}
    assert [(r.source, r.file, r.rows_seen, r.rows_kept) for r in log.collect()] == [("quakes", "quakes:202609201200", 2, 2)]
    new_only = source_jobs.SourceJob("quakes", snapshots.quakes, only_new=True)
    third, _ = source_jobs.run_source(spark, new_only, str(tmp_path / "1.json"), first, shapes, now)
    assert {r.external_id: r.lat for r in third.collect()} == {"a": 0.5, "b": 40.0, "c": 0.2}


def test_alerts_that_later_runs_refer_to(spark):
    box = [[[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]]]
    shapes = spark.createDataFrame([("AA", box)], f"code string, geom {geo.SHAPE}")
    lots = {"one": [("a", 1, []), ("b", 2, [])], "two": [("b", 3, []), ("c", 3, ["a"])], "three": [("a", 9, [])]}
    ddl = "external_id string, added_at timestamp, lon double, lat double, refs array<string>"
    read = lambda spark, lot: spark.createDataFrame([(k, datetime(2026, 9, 20, h), 0.5, 0.5, refs) for k, h, refs in lots[lot]], ddl)
    job = source_jobs.SourceJob("alerts", read, refers=True)
    stored, now = spark.createDataFrame([], snapshots.schemas.EVENT + ", superseded_by string"), F.lit(datetime(2026, 9, 20, 12))
    for lot, want in (("one", {"a": None, "b": None}), ("two", {"a": "c", "b": None, "c": None}), ("three", {"a": "c", "b": None, "c": None})):
        stored, _ = source_jobs.run_source(spark, job, lot, stored, shapes, now)
        assert {r.external_id: r.superseded_by for r in stored.collect()} == want
    assert {r.country for r in stored.collect()} == {"AA"}


def post(k, text, op="create", s=0):
    return json.dumps({"did": "d", "time_us": (1790000000 + s) * 1_000_000, "kind": "commit", "commit": {"collection": "app.bsky.feed.post", "operation": op, "rkey": k, "record": {"text": text}}})


def test_live_posts(spark, tmp_path):
    """A delete takes a pointer and frees no place; a batch that fails halfway counts nothing twice; names are read anew."""
    land, folder, cp, names = (str(tmp_path / x) for x in ("land", "out", "cp", "names"))
    (tmp_path / "land").mkdir()
    spark.createDataFrame([("Lviv", 7)], "name string, place_id long").write.parquet(names)
    stops = str(tmp_path / "stops")

    def run(fail=None):
        streaming.run_once(streaming.lines(spark, land), "", cp, batches.live_posts(batches.names_from(spark, names, stops), folder, most=2, fail=fail))

    def stop(batch_id, what):
        raise RuntimeError("made to fail")

    assert batches.live_now(spark, folder).count() == 0
    (tmp_path / "land" / "1.json").write_text("\n".join([post("1", "Lviv Lviv"), post("2", "in Lviv", s=1), post("3", "Lviv", s=2), post("9", "York", s=3)]) + "\n")
    run()
    uris = lambda: sorted(r.uri[-1] + str(r.place_id) for r in batches.live_now(spark, folder).collect())
    assert uris() == ["17", "27"]
    spark.createDataFrame([("York", 8)], "name string, place_id long").write.mode("append").parquet(names)
    (tmp_path / "land" / "2.json").write_text("\n".join([post("1", "", "delete", s=9), post("4", "Lviv", s=8), post("5", "York", s=8)]) + "\n")
    with pytest.raises(Exception, match="made to fail"):
        run(stop)
    assert uris() == ["17", "27"]
    run()
    assert uris() == ["27", "58"]  # the fourth post gets no place, as two were given; York is known now
    counts = {(r.place_id, r.posts) for r in streaming.added_counts(spark, folder).groupBy("place_id").agg(F.sum("posts").alias("posts")).collect()}
    assert counts == {(7, 4), (8, 1)}
    spark.createDataFrame([("York",)], "name string").write.parquet(stops)
    (tmp_path / "land" / "3.json").write_text(post("6", "York", s=3 * 86400) + "\n")
    run()
    assert uris() == []  # York is a stop name by now, and the others are over two days old


def test_edit_batches_freeze_hours(spark, tmp_path):
    land, folder, cp = (str(tmp_path / x) for x in ("land", "out", "cp"))
    (tmp_path / "land").mkdir()
    start = 1_790_000_000 // 3600 * 3600
    edit = lambda rev, hours, user="a": json.dumps({"wiki": "w", "server_name": "en.wikipedia.org", "title": "T", "namespace": 0, "type": "edit", "user": user, "bot": False, "timestamp": start + int(hours * 3600), "revision": {"new": rev}})
    lots = [[edit(1, 0), edit(2, 0.1, "b"), edit(3, 80)], [edit(4, 0.2, "c"), edit(5, 79.9, "c"), edit(3, 80)], [edit(6, 7.5), edit(7, 8.5), edit(8, 80.5, "z")]]
    for n, lot in enumerate(lots):
        (tmp_path / "land" / f"{n}.json").write_text("\n".join(lot) + "\n")
        streaming.run_once(streaming.lines(spark, land), "", cp, batches.edit_batches(folder))
    got = {int(r.hour.timestamp() - datetime.fromtimestamp(start).timestamp()) // 3600: (r.edits, r.editors) for r in batches.edit_hours(spark, folder).collect()}
    # Hour 0 is frozen with its first two edits; hour 7 was never whole in the buffer; hour 8 is, and takes its late row.
    assert got == {0: (2, 2), 79: (1, 1), 80: (2, 2), 8: (1, 1)}


def test_half_a_batch_of_files_is_not_read(spark, tmp_path):
    land, folder, cp = (str(tmp_path / x) for x in ("land", "out", "cp"))
    (tmp_path / "land").mkdir()
    event = lambda i, width=61: "\t".join(([str(i), "20260920"] + [""] * 49 + ["4", "Here", "FR", "", "", "1.5", "2.5", "", "20260920120000", "http://x"])[:width])
    said = lambda i: "\t".join([str(i), "", "20260920121500", "1", "out.let", *[""] * 11])
    (tmp_path / "land" / "1.mentions").write_text("\n".join([said(1), said(9), "short"]) + "\n")
    (tmp_path / "land" / "1.export").write_text("\n".join([event(1), event(2, 60)]) + "\n")
    (tmp_path / "land" / "1.gkg").write_text("short\n")

    def stop(batch_id, what):
        if what == "articles":
            raise RuntimeError("made to fail")

    with pytest.raises(Exception, match="made to fail"):
        batches.load_files(spark, land, folder, cp, 10, stop)
    assert batches.loaded(spark, folder, "events") is None and archive.has_files(spark, f"{folder}/events")
    for _ in range(2):  # the second time nothing is new
        batches.load_files(spark, land, folder, cp, 10)
    assert {r.file: (r.rows_seen, r.rows_kept) for r in batches.loaded(spark, folder, "ledger").collect()} == {"1.export": (2, 1), "1.mentions": (3, 1), "1.gkg": (1, 0)}
    assert [r.event_id for r in batches.loaded(spark, folder, "mentions").collect()] == ["1"]
    (tmp_path / "land" / "2.mentions").write_text(said(1) + "\n")  # a later file's mention of an earlier file's event
    batches.load_files(spark, land, folder, cp, 10)
    assert batches.loaded(spark, folder, "mentions").count() == 2


def test_pointers_hold_no_more_than_asked(spark):
    hits = spark.createDataFrame([(datetime(2026, 9, 20, 12, k), f"u{k}", 1) for k in range(30)], "at timestamp, uri string, place_id long")
    assert gazetteer.first_pointers(hits, 20).count() == 20
