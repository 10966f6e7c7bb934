from datetime import datetime, timedelta

from pyspark.sql import functions as F

from heliograph import schemas
from heliograph.operators import archive, jobs, rollup, share, stories

H0 = datetime(2026, 9, 20, 15)
MIN, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)


def event(spark):
    rows = [(1, "US", "USWA", H0), (2, "US", "USWA", H0), (3, "US", "USWA", H0), (4, "US", "USCA", H0 + 30 * MIN), (5, "US", "USWA", H0 + HOUR), (6, "FR", "FR00", H0 + DAY), (7, None, "", H0)]
    return spark.createDataFrame(rows, "id long, country string, adm1 string, added_at timestamp")


def mention(spark):
    rows = [(1, H0, "a"), (1, H0, "b"), (4, H0, "a"), (5, H0 + HOUR, "c"), (6, H0 + DAY, "d"), (6, H0 + DAY, "d")]
    return spark.createDataFrame(rows, "event_id long, mentioned_at timestamp, source_name string")


def series(spark):
    return rollup.attention_hourly(rollup.hourly_sightings(event(spark)), rollup.hourly_coverage(mention(spark), event(spark)))


def test_hours_and_days(spark):
    h = series(spark)
    got = {(r.region, r.hour): (r.events, r.mentions, r.sources) for r in h.collect()}
    assert len(got) == 7
    assert got["US", H0] == (4, 3, 2) and got["USWA", H0] == (3, 2, 2)
    d = {r.region: (r.events, r.mentions) for r in rollup.attention_daily(h).filter("region_kind = 'country'").collect()}
    assert d == {"US": (5, 4), "FR": (1, 2)}
    again = rollup.incremental(h, event(spark), mention(spark), F.lit(H0 + DAY + HOUR))
    assert again.exceptAll(h.select(again.columns)).count() == 0 and again.count() == 7


def test_hours_before_the_buffer_stay(spark):
    base = series(spark).withColumn("mentions", F.lit(99).cast("long"))
    late = mention(spark).filter(F.col("mentioned_at") > H0 + HOUR - MIN)
    got = {(r.region, r.hour): r.mentions for r in rollup.incremental(base, event(spark), late, F.lit(H0 + DAY + HOUR)).collect()}
    assert got["US", H0] == 99 and got["US", H0 + HOUR] == 1


def test_anomaly(spark):
    flat = [("country", "A", H0 - i * DAY, 100) for i in range(1, 31)] + [("country", "B", H0 - i * DAY, 100) for i in range(1, 31)]
    now = [("country", "A", H0, 500), ("country", "B", H0, 100), ("country", "C", H0, 200)]
    h = spark.createDataFrame(flat + now, "region_kind string, region string, hour timestamp, mentions long")
    got = {r.region: r for r in rollup.seasonal_baseline(h).filter(F.col("hour") == F.lit(H0)).collect()}
    assert got["A"].z == 40 and abs(got["B"].z) < 1
    assert got["C"].baseline_mean == 0 and got["C"].z == 200
    assert [r.region for r in share.top_regions(rollup.seasonal_baseline(h), 50, 2).collect()] == ["C", "A"]


def test_running_story_and_growth(spark):
    rows = [(1, H0 + i * HOUR + k * MIN, o) for i in range(5) for k, o in enumerate("aab")]
    e = spark.createDataFrame([(1, "US", "USWA", H0)], "id long, country string, adm1 string, added_at timestamp")
    m = spark.createDataFrame(rows, "event_id long, mentioned_at timestamp, source_name string")
    h = rollup.attention_hourly(rollup.hourly_sightings(e), rollup.hourly_coverage(m, e)).filter("region = 'US'").orderBy("hour")
    assert [(r.events, r.mentions, r.sources) for r in h.collect()] == [(1, 3, 2)] + [(0, 3, 2)] * 4
    assert rollup.mention_hourly(m).count() == 5
    now = F.lit(H0 + 10 * HOUR)
    rising = [(1, H0 + 10 * HOUR - 10 * MIN, x) for x in "abcdef"] + [(1, H0 + 7 * HOUR, "g")]
    flat = [(2, H0 + 6 * HOUR, "x")] * 5  # four hours before
    old = [(3, H0, "x")]
    ev = spark.createDataFrame([(i, f"u{i}", H0, 4, 9) for i in (1, 2, 3)], "id long, url string, added_at timestamp, num_sources int, num_mentions int")
    g = stories.event_growth(spark.createDataFrame(rising + flat + old, "event_id long, mentioned_at timestamp, source_name string"), ev, now)
    assert {r.event_id: (r.url, r.first_sources, r.first_mentions, r.mentions_1h, r.sources_1h, r.mentions_6h, r.sources_6h) for r in g.collect()} == {1: ("u1", 4, 9, 6, 6, 7, 7), 2: ("u2", 4, 9, 0, 0, 5, 1)}


def test_stories_collapse_headlines(spark):
    titles = ["Flood hits town - Site A", "Flood hits town | Site B", "Another thing", "Third thing"]
    story = spark.createDataFrame([(f"u{i}", t, "ok", f"s{i % 2}") for i, t in enumerate(titles)], "url string, title string, status string, site string")
    e = spark.createDataFrame([(i, f"u{i}") for i in range(4)], "id long, url string")
    m = spark.createDataFrame([(i, H0, f"o{k}") for i in range(4) for k in range(i + 1)], "event_id long, mentioned_at timestamp, source_name string")
    got = [(r.rep, r.outlets, r.sites) for r in stories.top_stories(m, e, story, F.lit(H0 + HOUR)).collect()]
    assert got == [(3, 4, 1), (2, 3, 1), (1, 2, 2)]


def test_hourly_job(spark):
    """A run restores what is missing and leaves hours before the buffer as they are; a second one changes nothing."""
    e = event(spark).selectExpr("*", "cast(1 as int) as geo_type", "country as geo_name", "cast(0 as int) as source_id")
    base = series(spark).withColumn("mentions", F.lit(99).cast("long")).filter(F.col("hour") == F.lit(H0))
    late = mention(spark).filter(F.col("mentioned_at") > H0 + HOUR - MIN)
    edits = spark.createDataFrame([("w", "T", H0, "a", False, True)], "wiki string, title string, at timestamp, user_hash string, bot boolean, created boolean")
    five = spark.createDataFrame([("s", 1, H0, 2), ("s", 1, H0 + 5 * MIN, 3)], "source string, place_id long, bucket timestamp, posts long")
    empty = lambda name: spark.createDataFrame([], schemas.TABLES[name])
    mh = spark.createDataFrame([], "event_id long, hour timestamp, mentions long, sources long")
    tables = {"event": e, "mention": late, "wiki_edit": edits, "chatter_5min": five, "attention_hourly": base, "mention_hourly": mh, **{n: empty(n) for n in ("attention_daily", "wiki_activity", "chatter_hourly", "attention_anomaly", "region_name")}}
    now = F.lit(H0 + DAY + HOUR)
    once = jobs.hourly_run(tables, now)
    h = {(r.region, r.hour): (r.events, r.mentions) for r in once["attention_hourly"].collect()}
    assert h["US", H0] == (4, 99) and h["US", H0 + HOUR] == (1, 1) and h["FR", H0 + DAY] == (1, 2)
    assert {(r.region, r.mentions) for r in once["attention_daily"].filter("region_kind = 'country'").collect()} == {("US", 100), ("FR", 2)}
    assert once["chatter_hourly"].first().posts == 5 and once["wiki_activity"].first().editors == 1
    assert {r.name for r in once["region_name"].collect()} == {"US", "FR"} and once["attention_anomaly"].count() == once["attention_hourly"].count()
    twice = jobs.hourly_run(once, now)
    for name in ("attention_hourly", "attention_daily", "mention_hourly", "attention_anomaly"):
        assert archive.same_rows(once[name], twice[name])
    full = jobs.hourly_run(tables, now, full=True)
    assert archive.same_rows(full["attention_hourly"], once["attention_hourly"])
