import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliograph import functions as own
from heliograph import streaming
from heliograph.operators import archive, facts, gazetteer, registry, rollup
from heliograph.sources import files, snapshots


NAMES = {"Lviv": 1, "New York": 2, "York": 3, "北京": 4, "東京": 5, "القاهرة": 6, "New York City Hall": 7, "City": 8, "ประเทศไทย": 9, "St. John's": 10, "Washington D.C.": 11, "京都": 12, "東京都": 13}


def spaced(c):
    return not ("฀" <= c <= "๿" or "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿")


def naive_match(text):
    """Every name at every place, with boundaries where scripts have them; then leftmost and longest."""
    hits = []
    for name, place in NAMES.items():
        at = text.find(name)
        while at >= 0:
            before, after = text[at - 1 : at] if at else " ", text[at + len(name) : at + len(name) + 1] or " "
            if not spaced(name[0]) or not (before.isalnum() or after.isalnum()):
                hits.append((at, -len(name), place))
            at = text.find(name, at + 1)
    out, free = [], 0
    for start, less, place in sorted(hits):
        if start >= free:
            out.append(place)
            free = start - less
    return sorted(out)


def test_names_in_texts(spark):
    texts = ["In Lviv, New York and York", "Lvivska _Lviv_ lviv", "我在北京和東京。東京都京都", "في القاهرة اليوم", "New York City Hall, New York City", "", None, "in St. John's; Washington D.C. or Washington D.C", "ในประเทศไทย", "York City York", "Lviv", "New  York New\nYork", "北京Lviv 京都X", "Lviv " * 400, "New York " * 300 + "City Hall"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    names = spark.createDataFrame(list(NAMES.items()), "name string, place_id long")
    want = {i: m for i, x in enumerate(texts) if x and (m := naive_match(x))}
    for match in (gazetteer.match_names, gazetteer.match_by_grams):
        got = {}
        for r in match(rows, names).collect():
            got.setdefault(r.id, []).append((r.start, r.place_id))
        assert {i: sorted(p for _, p in m) for i, m in got.items()} == want and want[4] == [2, 7, 8] and len(want[13]) == 400
        assert match(rows.limit(0), names).count() == 0 and match(rows, names.limit(0)).count() == 0
    few = gazetteer.match_names(rows, names, most_names=2)  # more names than the bound: n-grams, with the same result
    assert few.count() == sum(map(len, want.values()))


def test_automaton_and_grams_agree(spark):
    """Names and texts at random, of letters, digits, marks and signs in scripts with and without spaces."""
    rnd = random.Random(3)
    signs = ["A", "b", "é", "7", " ", "-", ".", "・", "東", "京", "サ", "ン", "م", "\u0301", "Ж"]
    word = lambda n: "".join(rnd.choice(signs) for _ in range(rnd.randint(1, n)))
    own = {w: k for k, w in enumerate({"サン・サン", "京.A", *(word(5) for _ in range(150))})}
    texts = [word(60) for _ in range(150)] + ["サン・サン・サン", "x京.A-京.Ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = spark.createDataFrame([(w, k) for w, k in own.items() if w.strip()], "name string, place_id long")
    both = [[(i, [p for _, p in sorted(m)]) for i, m in sorted(groups(match(rows, names)).items())] for match in (gazetteer.match_names, gazetteer.match_by_grams)]
    assert len(both[0]) > 50 and both[0] == both[1]


def groups(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.id, []).append((r.start, r.place_id))
    return out


def test_usable_names(spark):
    names = [("Nice", True, True), ("nice", True, False), ("BBC", False, False), ("BBC", True, True), ("Ur", True, False), ("京", True, False), ("北京", True, True), ("ライ", True, False), ("ライン", True, True), ("Area 51", True, False), ("'s-Gravenhage", True, False), ("القاهرة", True, True), ("  Bern ", True, True), ("", True, False)]
    d = spark.createDataFrame([(n, p) for n, p, _ in names], "name string, main boolean")
    assert [r[0] for r in d.select(own.usable_name(F.col("name"), F.col("main"))).collect()] == [w for *_, w in names]


def test_functions(spark):
    d = spark.createDataFrame([("Flood hits town - Site A", "A.News.CN", "Xin (New China)"), ("One | X", "b", "Xin (New) rest"), ("Two - " + "s" * 41, "c", "(New)")], "t string, h string, n string")
    r = d.select(own.norm_title(F.col("t")), own.host_suffixes(F.col("h")), own.name_variants(F.col("n"))).collect()
    assert [x[0] for x in r] == ["flood hits town", "one x", "two " + "s" * 41]
    assert r[0][1] == ["a.news.cn", "news.cn", "cn"]
    assert [x[2] for x in r] == [["Xin (New China)", "Xin", "New China"], ["Xin (New) rest"], ["(New)", "New"]]
    codes = spark.createDataFrame([("20", 4), ("99", 9)], "c string, q int")
    assert [tuple(x) for x in codes.select(own.legend(F.col("c"), own.EVENT_ROOTS), own.legend(F.col("q"), own.QUAD_CLASSES)).collect()] == [("use unconventional mass violence", "material conflict"), (None, None)]


def test_archive(spark, tmp_path):
    ddl = "id long, added_at timestamp, source_id int"
    now = F.lit(datetime(2026, 9, 20, 12))
    rows = spark.createDataFrame([(1, datetime(2026, 7, 1, 6, 30), 1), (2, datetime(2026, 9, 19), 1), (3, datetime(2026, 7, 1), 0), (4, None, 1)], ddl)
    keep = spark.createDataFrame([(0,)], "source_id int")
    p = archive.POLICIES[0]
    hot, n = archive.archive_slice(rows, str(tmp_path), p, now, keep=keep)
    assert n == 1 and {r.id for r in hot.collect()} == {2, 3, 4}
    late = spark.createDataFrame([(5, datetime(2026, 7, 1, 7), 1)], ddl)
    archive.archive_slice(late, str(tmp_path), p, now)
    assert len(list((tmp_path / "event" / "day=2026-07-01").glob("*.parquet"))) == 2
    q = archive.archive_query(spark, "SELECT id FROM event", str(tmp_path), ["event", "none"])
    assert {r.id for r in q.collect()} == {1, 5}
    with pytest.raises(archive.ShortArchive):
        archive.archive_slice(late, str(tmp_path), p, now, count=lambda d: 0)
    # What could not be read back is taken away again.
    assert len(list((tmp_path / "event" / "day=2026-07-01").glob("*.parquet"))) == 2
    source = spark.createDataFrame([(0, "gdacs-alerts"), (1, "x")], "id int, name string")
    hot, done, failed = archive.archive_all({"event": rows, "mention_hourly": rows.drop("added_at"), "source": source}, str(tmp_path / "x"), now)
    assert done == {"event": 1} and list(failed) == ["mention_hourly"] and hot["mention_hourly"].count() == 4
    assert archive.archive_all({"event": rows}, None, now)[1] == {}
    assert archive.same_rows(rows, rows) and not archive.same_rows(rows, late)
    assert {p.table: p.days for p in archive.POLICIES} == {"event": 60, "theme_hourly": 7, "mention_hourly": 7, "attention_hourly": 35, "wiki_activity": 30, "chatter_hourly": 30, "gkg_article": 30, "gkg_location": 30, "firms_detection": 30, "theme_daily": 7}


def message(i, user, bot=False, kind="edit", ns=0, minute=0):
    return json.dumps({"wiki": "enwiki", "server_name": "en.wikipedia.org", "title": "T", "namespace": ns, "type": kind, "user": user, "bot": bot, "timestamp": 1790000000 + 60 * minute, "revision": {"new": i}})


def test_edit_stream_equals_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    lines = [message(1, "a", kind="new"), message(2, "a"), message(3, "b"), message(4, "b"), message(5, "c"), message(6, "z", bot=True), message(7, "a", ns=1), message(5, "c")]
    (land / "1.json").write_text("\n".join(lines[:4]) + "\n")
    streaming.run_once(streaming.edits(streaming.lines(spark, str(land))), str(tmp_path / "out"), str(tmp_path / "cp"))
    (land / "2.json").write_text("\n".join(lines[4:]) + "\n")
    for _ in range(2):  # the second time nothing is new
        streaming.run_once(streaming.edits(streaming.lines(spark, str(land))), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = snapshots.edit_rows(spark.read.text(str(land))).dropDuplicates(["wiki", "rev"])
    assert archive.same_rows(got, want) and got.count() == 6
    a = rollup.page_activity(got).first()
    assert (a.edits, a.editors, a.created) == (6, 3, True)


def test_post_stream_counts(spark, tmp_path):
    land = tmp_path / "posts"
    land.mkdir()
    post = lambda k, text, op="create", s=0: json.dumps({"did": "d", "time_us": (1790000000 + s) * 1_000_000, "kind": "commit", "commit": {"collection": "app.bsky.feed.post", "operation": op, "rkey": k, "record": {"text": text}}})
    (land / "1.json").write_text("\n".join([post("1", "Lviv Lviv"), post("2", "in Lviv"), post("3", "nothing"), post("1", "", "delete"), post("4", "Lviv", s=600)]) + "\n")
    names = spark.createDataFrame([("Lviv", 7), ("New York", 8), ("York", 9)], "name string, place_id long")
    (land / "2.json").write_text("\n".join([post("5", "New York", s=60), post("4", "", "delete", s=900)]) + "\n")
    out, cp = str(tmp_path / "places"), str(tmp_path / "c")
    for _ in range(2):  # the second time nothing is new
        streaming.run_once(streaming.lines(spark, str(land), 1), "", cp, streaming.post_batches(names, out))
    got = {(r.bucket.minute // 5 * 5, r.place_id): r.posts for r in streaming.added_counts(spark, out).collect()}
    every = streaming.place_hits(spark.read.text(str(land)), names)
    want = {(r.bucket.minute // 5 * 5, r.place_id): r.posts for r in streaming.five_minute_counts(every).collect()}
    assert got == want and sorted(got.values()) == [1, 1, 2] and {k[1] for k in got} == {7, 8}
    assert {r.uri[-1] for r in streaming.live_pointers(spark, out).collect()} == {"2", "5"}
    hits = spark.readStream.schema("at timestamp, uri string, place_id long").parquet(f"{out}/pointers")
    streaming.run_once(streaming.first_pointers(hits, 1), str(tmp_path / "ptr"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "ptr")).count() == 2


def test_registry(spark):
    ids = spark.createDataFrame([("CN", "Xin", "host", "news.cn")], "country string, name string, kind string, value string")
    outlets = spark.createDataFrame([("CN", "Xin", "state")], "country string, name string, typology string")
    sites = spark.createDataFrame([(s,) for s in ("english.news.cn", "news.cn", "fakenews.cn", "news.cn.example.org")], "site string")
    assert {r.site for r in registry.match_hosts(sites, "site", ids, outlets).collect()} == {"english.news.cn", "news.cn"}
    lists = spark.createDataFrame([("CN", "Xin (New China)", 0), ("CN", "New China", 1), ("CN", "Other", 1), ("CN", "x.in", 2)], "country string, name string, priority int")
    none = spark.createDataFrame([], "country string, alias string, name string")
    assert {r.name for r in registry.first_listed(lists, none).collect()} == {"Xin (New China)", "Other"}
    # A chain: b goes for a, so it no longer blocks c; d has no key at all and stays.
    chain = spark.createDataFrame([("X", "A (B)", 0), ("X", "B (C)", 1), ("X", "C (D)", 2), ("X", "D", 3), ("X", "北京", 4), ("Y", "B", 9), ("X", "A (B)", 0)], "country string, name string, priority int")
    assert {(r.country, r.name) for r in registry.first_listed(chain, none).collect()} == {("X", "A (B)"), ("X", "C (D)"), ("X", "北京"), ("Y", "B")}
    renamed = spark.createDataFrame([("X", "D", "A")], "country string, alias string, name string")
    assert "D" not in {r.name for r in registry.first_listed(chain, renamed).collect()} and registry.first_listed(chain.limit(0), none).count() == 0
    cand = spark.createDataFrame([("CN", "Xin", "Q1"), ("CN", "New China", "Q2"), ("CN", "Other", "Q3")], "country string, label string, qid string")
    got = {r.name: r.qid for r in registry.resolve_entities(lists.select("country", "name"), cand).collect()}
    assert got["Other"] == "Q3" and "Xin (New China)" not in got
    with pytest.raises(ValueError):
        registry.assert_known(spark.createDataFrame([("CN", "No")], "country string, name string"), outlets)


def test_live_rules_on_both_sides_of_their_limits(spark):
    now = datetime(2026, 9, 20, 12)
    ago = lambda h: now - timedelta(hours=h)
    iso = lambda t: t.isoformat() + "+00:00"
    cases = [
        ("usgs", ago(71), {}, True), ("usgs", ago(73), {}, False),
        ("gdacs", ago(9999), {"alert": "Orange", "modified": iso(ago(719))}, True), ("gdacs", ago(1), {"modified": iso(ago(1))}, True), ("gdacs", ago(1), {"alert": "Green", "modified": iso(ago(1))}, False), ("gdacs", ago(1), {"alert": "Red", "modified": iso(ago(721))}, False),
        ("nws", ago(1), {"severity": "Severe", "expires": "2026-09-20T14:00:01+02:00"}, True), ("nws", ago(1), {"severity": "Severe", "expires": "2026-09-20T13:59:59+02:00"}, False), ("nws", ago(1), {"severity": "Minor", "expires": iso(ago(-1))}, False),
        ("tsunami", ago(23), {"category": "Warning"}, True), ("tsunami", ago(23), {}, True), ("tsunami", ago(23), {"category": "Information"}, False), ("tsunami", ago(25), {"category": "Warning"}, False),
        ("volcano", ago(9999), {"seen": iso(ago(2.9))}, True), ("volcano", ago(1), {"seen": iso(ago(3.1))}, False),
        ("firms", ago(99), {"detections": 50, "last_seen": iso(ago(23))}, True), ("firms", ago(99), {"detections": 49, "last_seen": iso(ago(1))}, False), ("firms", ago(1), {"detections": 60, "last_seen": iso(ago(25))}, False),
        ("ioda", ago(47), {"end": iso(ago(2.9))}, True), ("ioda", ago(47), {"end": iso(ago(3.1))}, False), ("ioda", ago(49), {"end": iso(now)}, False),
        ("radar", ago(9999), {"end": None}, True), ("radar", ago(9999), {"end": iso(ago(2.9))}, True), ("radar", ago(1), {"end": iso(ago(3.1))}, False),
        ("ucdp", ago(24 * 59), {}, True), ("ucdp", ago(24 * 60), {}, False), ("what", ago(1), {}, False),
    ]
    kinds = sorted({k for k, *_ in cases})
    rows = [(str(i), kinds.index(k), t, t.date(), json.dumps(p), None) for i, (k, t, p, _) in enumerate(cases)] + [("gone", kinds.index("nws"), ago(1), now.date(), json.dumps(cases[6][2]), "x"), ("news", 99, ago(1), now.date(), "{}", None)]
    e = spark.createDataFrame(rows, "external_id string, source_id int, added_at timestamp, occurred_on date, props string, superseded_by string")
    sources = spark.createDataFrame([(i, k, False) for i, k in enumerate(kinds)] + [(99, "usgs", True)], "id int, kind string, attention boolean")
    live = facts.live(e, sources, F.lit(now))
    assert {r.external_id for r in live.collect()} == {str(i) for i, (*_, good) in enumerate(cases) if good}
    assert facts.newest_live(live, F.lit(now), hours=1).filter("kind = 'usgs'").count() == 0
    assert [r.external_id for r in facts.newest_live(live, F.lit(now), limit=2).collect()] == ["3", "6"]


def event_line(i, geo_type="4", lat="1.5", lon="2.5", country="FR", day="20260920", width=61):
    f = [""] * 61
    f[0], f[1], f[51], f[52], f[53], f[56], f[57], f[59], f[60] = str(i), day, geo_type, "Somewhere", country, lat, lon, "20260920120000", "http://x"
    return "\t".join(f[:width])


def test_event_mention_article_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("\n".join([event_line(1), event_line(2, "0"), event_line(3, lat=""), event_line(4, width=60), event_line(5, day="bad")]) + "\n")
    rows = files.event_rows(files.read_lines(spark, str(tmp_path / "e.tsv")))
    assert rows.count() == 5 and rows.filter("kept").count() == 2
    e = files.events(files.read_lines(spark, str(tmp_path / "e.tsv")))
    assert {r.external_id: r.occurred_on is None for r in e.collect()} == {"1": False, "5": True}
    m = lambda i, w=16: "\t".join([str(i), "", "20260920121500", "1", "out.let", *[""] * 11][:w])
    (tmp_path / "m.tsv").write_text("\n".join([m(1), m(1), m(9), m(5, 10)]) + "\n")
    known = e.select(F.col("external_id").cast("long").alias("id"), "external_id")
    assert files.mention_rows(files.read_lines(spark, str(tmp_path / "m.tsv"))).filter("kept").count() == 3
    assert files.mentions(files.read_lines(spark, str(tmp_path / "m.tsv")), known).count() == 2
    g = ["g1", "20260920120000", "", "site", "http://a", "", "", "A;B;A;", "", "4#City#FR#FR01#1#2#x;4#City#FR#FR01#1#2#x;1#France#FR#FR#3#4#x;4#bad#FR", "", "", "", "", "", "-0.7,1"]
    (tmp_path / "g.tsv").write_text("\t".join(g) + "\n" + "short\n")
    a = files.articles(files.read_lines(spark, str(tmp_path / "g.tsv")))
    r = a.first()
    assert a.count() == 1 and r.themes == ["A", "B"] and r.tone == -0.7 and len(r.places) == 2
    assert {p.adm1 for p in r.places} == {"FR01", None}
    loc = files.article_places(a).withColumnRenamed("gkg_id", "article_id")
    daily = facts.theme_daily(a.withColumnRenamed("gkg_id", "article_id"), loc)
    assert daily.filter("region_kind = 'country'").count() == 2 and daily.filter("articles <> 1").count() == 0
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "e.tsv").write_text((tmp_path / "e.tsv").read_text())
    q = streaming.load_series(spark, str(tmp_path / "land"), str(tmp_path / "ev"), str(tmp_path / "cpe"))
    assert q.exception() is None and spark.read.parquet(str(tmp_path / "ev/batch=*")).count() == 2
    s = files.series_slots(spark, "2026-09-20 11:50:00", "2026-09-20 12:20:00", ".export").collect()
    assert [r.file for r in s] == ["20260920114500.export", "20260920120000.export", "20260920121500.export"]


def test_snapshots(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text))
        return str(tmp_path / name)

    q = {"features": [{"id": "q1", "properties": {"mag": 5.0, "place": "p", "time": 1790000000000, "updated": 1, "url": "u", "title": "t"}, "geometry": {"coordinates": [1, 2, 3]}}, {"id": "q2", "properties": {"mag": None}, "geometry": {"coordinates": [1, 2, 3]}}]}
    r = snapshots.quakes(spark, put("q.json", q)).collect()
    assert [(x.external_id, x.lon, x.country) for x in r] == [("q1", 1.0, "")] and json.loads(r[0].props)["alert"] is None
    rss = """<rss xmlns:gdacs="g" xmlns:georss="r"><channel><item><title>T</title><link>l</link><pubDate>Sun, 20 Sep 2026 10:00:00 GMT</pubDate><gdacs:eventtype>EQ</gdacs:eventtype><gdacs:eventid>7</gdacs:eventid><gdacs:alertlevel>Orange</gdacs:alertlevel><gdacs:iscurrent>true</gdacs:iscurrent><gdacs:severity unit="M" value="6.1">Magnitude</gdacs:severity><georss:point>10.5 20.5</georss:point></item></channel></rss>"""
    r = snapshots.disasters(spark, put("g.xml", rss)).first()
    assert (r.external_id, r.lat, r.lon) == ("EQ7", 10.5, 20.5) and json.loads(r.props)["alert"] == "Orange" and json.loads(r.props)["severity_value"] == 6.1
    atom = """<feed xmlns:geo="g"><entry><id>t1</id><title>T</title><updated>2026-09-20T10:00:00Z</updated><geo:lat>1</geo:lat><geo:long>2</geo:long><summary><div><b>Category:</b> Warning<br/><b>Preliminary Magnitude:</b> 7.1(Mw)</div></summary></entry></feed>"""
    r = snapshots.tsunami_bulletins(spark, put("t.xml", atom)).first()
    assert json.loads(r.props) == {"category": "Warning", "magnitude": 7.1}
    v = [{"vnum": "332010", "vName": "K", "lat": 1.0, "long": 2.0, "colorCode": "ORANGE", "codeChangeDate": "2026-09-07 23:00:41"}]
    assert snapshots.volcanoes(spark, put("v.json", v), F.lit("2026-09-20").cast("timestamp")).first().external_id == "332010:20260907230041"
    csv = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_ti5,frp,daynight\n1.5,2.5,300,1,1,2026-09-20,1,N,high,2,290,4.5,D\nbad,2.5,300,1,1,2026-09-20,1,N,high,2,290,4.5,D\n"
    r = snapshots.fire_pixels(spark, put("f.csv", csv), "N").collect()
    assert len(r) == 1 and r[0].acq_at == datetime(2026, 9, 20, 0, 1)
    o = {"data": [{"location": "country/FR", "start": 1790000000, "duration": 60, "score": 5.0, "datasource": "b"}, {"location": "asn/1", "start": 1}]}
    out = snapshots.outages(spark, put("o.json", o))
    codes = spark.createDataFrame([("FR", "FRA", "FR", "France")], "iso2 string, iso3 string, fips string, name string")
    pts = spark.createDataFrame([("FR", 2.0, 47.0)], "fips string, lon double, lat double")
    assert [(x.country, x.lat) for x in snapshots.placed_codes(out, codes, pts).collect()] == [("FR", 47.0)]
    n = {"result": {"annotations": [{"id": "a", "startDate": "2026-09-20T10:00:00Z", "locations": ["FR", "XX"], "locationsDetails": [{"code": "FR", "name": "France"}]}]}}
    assert {x.external_id for x in snapshots.outage_notes(spark, put("n.json", n)).collect()} == {"a:FR", "a:XX"}
    head = "id,where_coordinates,date_start,latitude,longitude,best,high,low,side_a,side_b,conflict_name\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "GED_v26_0_8.csv").write_text(head + '1,"Town, x",2026-08-01,1,2,9,9,9,a,b,"multi\nline"\n')
    (tmp_path / "c" / "GED_v26_01_26_06.csv").write_text(head + "1,Town,2026-08-01,1,2,3,9,9,a,b,c\n2,T,2026-08-01,,2,3,9,9,a,b,c\n")
    r = snapshots.conflicts(spark, str(tmp_path / "c")).collect()
    assert len(r) == 1 and json.loads(r[0].props)["best"] == 9
    runs = spark.createDataFrame([("fatal003_2026_07_t02",), ("fatal003_2026_08_t01",), ("other",)], "run string")
    assert snapshots.newest_run(runs).first().run == "fatal003_2026_08_t01"
    page = {"data": [{"isoab": "FRA", "year": 2026, "month": 9, "main_mean": 1.5, "main_dich": 0.1}]}
    assert snapshots.forecasts(spark, put("p.json", page), "r").first().fatalities == 1.5
    html = '<div data-post="chan/5"><time datetime="2026-09-20T10:00:00+00:00"></time><div class="message_text">Hi &amp; <a href="https://a.b/c?x=1&amp;y=2">l</a><br/>two</div><span class="message_views">1.2K</span></div>'
    r = snapshots.channel_posts(spark.createDataFrame([("chan", "<p>" + html)], "handle string, html string")).first()
    assert (r.post_id, r.text, r.views, r.links) == (5, "Hi & l\ntwo", 1200, ["https://a.b/c?x=1&y=2"])
    data = 'const DATA = [{"sr": "x", "countries": [{"country": "CN", "outlets": [{"outlet": "Xin", "assets": "a", "t": ["S", null]}]}]}];'
    assert snapshots.outlet_pages(spark.createDataFrame([(data,)], "html string")).first().trajectory == ["S", "-"]
    vids = spark.createDataFrame([("v", "t", None, 3, 9, False), ("w", "t", None, 3, 9, True)], "video_id string, title string, published timestamp, views long, length_s long, upcoming boolean")
    det = spark.createDataFrame([("v", "d", ["k"], 5, datetime(2026, 9, 1))], "video_id string, description string, keywords array<string>, views long, published timestamp")
    assert [(x.video_id, x.views) for x in snapshots.videos(vids, det).collect()] == [("v", 5)]
    poly = {"features": [{"properties": {"fips": "FR", "name": "F"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"fips": "FR", "name": "F"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 0], [6, 0], [6, 1]]]]}}]}
    assert len(files.country_shapes(spark, put("s.json", poly)).first().geom) == 2
