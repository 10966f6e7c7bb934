from heliograph.operators import upsert


def test_policies_and_idempotence(spark):
    ddl = "k int, country string, best int, added int"
    base = spark.createDataFrame([(1, "FR", 5, 10), (2, "DE", 1, 11)], ddl)
    new = spark.createDataFrame([(1, "", 7, 99), (1, "", 8, 100), (3, "ES", 2, 12)], ddl)
    rules = {"country": "nonblank", "added": "keep"}
    once = upsert.merge(base, new, ["k"], rules, [new["best"]])
    assert {tuple(r) for r in once.collect()} == {(1, "FR", 8, 10), (2, "DE", 1, 11), (3, "ES", 2, 12)}
    assert upsert.merge(once, new, ["k"], rules, [new["best"]]).exceptAll(once).count() == 0
    skipped = upsert.insert_or_skip(base, new, ["k"])
    assert skipped.count() == 3 and upsert.only_new(skipped, new, ["k"]).count() == 0


def test_repeated_batch_adds_nothing(spark):
    delta = spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "k string, batch int, n long")
    once = upsert.add_counts(delta.limit(0), delta, ["k"], ["n"], "batch")
    assert {tuple(r) for r in upsert.add_counts(once, delta, ["k"], ["n"], "batch").select("k", "n").collect()} == {("a", 2), ("b", 3)}


def test_origin_and_attempts(spark):
    rows = spark.createDataFrame([("h", "x", "machine"), ("h", "x", "manual")], "kind string, value string, origin string")
    assert upsert.by_origin(rows, ["kind", "value"], "origin", {"manual": 0, "machine": 1}).first().origin == "manual"
    base = spark.createDataFrame([("u", "failed", 1)], "url string, status string, attempts int")
    tried = spark.createDataFrame([("u", "ok"), ("v", "failed")], "url string, status string")
    assert {tuple(r) for r in upsert.count_attempts(base, tried, ["url"]).collect()} == {("u", "ok", 2), ("v", "failed", 1)}
