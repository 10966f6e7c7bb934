"""Joins whose commonest keys are joined apart give what a plain join gives; the two operators that use them, in plain Python."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from heliograph.llm import simhash, trees, url_filter
from heliograph.llm.shared import join_commonest_apart, table


def test_commonest_keys_apart(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["hot"] * 6 + [f"k{rnd.randrange(30)}", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, key string").repartition(3)
    values = df.filter("key is not null").groupBy("key").agg(F.count("*").alias("times"), F.min("id").alias("v")).filter("key <> 'k7'")
    want = {(r.id, r.key, r.v) for r in df.join(values.drop("times"), "key", "left").collect()}
    for most in (1, 3, 100):
        got = join_commonest_apart(df, values, "key", "times", most)
        assert got.columns == ["key", "id", "v"] and got.count() == len(rows)
        assert {(r.id, r.key, r.v) for r in got.collect()} == want
    assert join_commonest_apart(df.limit(0), values, "key", "times", 2).count() == 0
    assert join_commonest_apart(df, values.limit(0), "key", "times", 2).filter("v is null").count() == len(rows)


def test_verdicts_of_urls_without_a_rule(spark):
    """The verdict of every URL that no rule decides, by the trees in plain Python; and the trees on labelled URLs that they were not
    fitted on."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    urls = url_filter.with_suffix_rates(url_filter.lexical(url_filter.with_rule(url_filter.split_url(pages)))).toPandas()
    x = urls[list(url_filter.FEATURES)].to_numpy(float)
    start, grown = url_filter.fit(url_filter.with_suffix_rates(url_filter.lexical(url_filter.with_rule(url_filter.split_url(pages)))))
    score = 1 / (1 + np.exp(-(start + sum(trees.predict(t, x) for t in grown))))
    want = {int(i): (r if isinstance(r, str) else "block" if s >= url_filter.CUT else "allow") for i, r, s in zip(urls["page_id"], urls["rule_verdict"], score, strict=True)}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == want and sum(not isinstance(r, str) for r in urls["rule_verdict"]) > 100
    known = urls[urls["y"].notna()]
    held = known["page_id"] % 5 == 0
    start, grown = trees.boost(known[~held][list(url_filter.FEATURES)].to_numpy(float), known[~held]["y"].to_numpy(float), url_filter.ROUNDS, url_filter.DEPTH)
    odds = start + sum(trees.predict(t, known[held][list(url_filter.FEATURES)].to_numpy(float)) for t in grown)
    right = ((odds >= 0) == (known[held]["y"] == 1)).mean()
    print(f"held-out URLs judged as their rule does: {right:.4f} of {held.sum()}")
    assert held.sum() > 30 and right >= 0.9


def test_fingerprints_by_plain_python(spark):
    """Bits set in over half the XXH64 of all three-word shingles, repeats counted, word by word."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.fingerprint for r in simhash.query(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[doc_id] == f"{bits:016x}"
