import random

import numpy as np
import pytest

from heliograph.llm import edit_embedding, neighbours, similar_texts, simhash

from .conftest import ROWS


def brute_components(fps):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in u}


def test_links_and_components(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for k in range(6):
            g = f
            for b in rnd.sample(range(64), k):
                g ^= 1 << b
            fps.append(g)
    u = np.array(sorted(set(fps)), np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    want = {(a, b) for i, a in enumerate(u.tolist()) for b in u.tolist()[:i] if (a ^ b).bit_count() <= 3}
    got = {tuple(np.array([r.a, r.b], np.int64).view(np.uint64).tolist()) for r in simhash.links(nodes).collect()}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in want}
    groups = lambda links: {frozenset(m) for m in simhash.components(links).groupBy("root").agg({"node": "collect_list"}).toPandas().iloc[:, 1].map(tuple)}
    assert groups(simhash.links(nodes)) == groups(simhash.links(nodes, 3, 16, 0))
    # By one task, and by rounds between tasks that have few edges each.
    alone, dealt = (dict(map(tuple, simhash.components(simhash.links(nodes), local=n).collect())) for n in (10**6, 20))
    root = brute_components(u.tolist())
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    least = {}
    for x, r in root.items():
        least[r] = min(least.get(r, signed(x)), signed(x))
    assert alone == dealt == {signed(x): least[r] for x, r in root.items() if signed(x) != least[r]}
    assert simhash.components(simhash.links(nodes.limit(0))).count() == 0


def test_near_duplicates(odd, empty):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == len(ROWS)
    fps = {r[0]: simhash.majority(simhash.shingle_hashes(r[1])) for r in ROWS}
    root = brute_components(fps.values())
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert int(r.fingerprint, 16) == fps[i]
        same = [j for j, f in fps.items() if root[f] == root[fps[i]] and j is not None]
        assert (r.component_id != r.component_id and not same) or int(r.component_id) == min(same)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.majority(simhash.shingle_hashes(" \n")) == 0


def word_shingles(text, n=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_shingle_hashes_are_those_of_joined_words():
    rnd = random.Random(9)
    seen = {}
    for _ in range(300):
        text = "".join(rnd.choice(["aB", "é", "日本", " ", "\t\n ", "x", "a"]) for _ in range(rnd.randrange(60)))
        want, got = word_shingles(text), set(similar_texts.shingle_hashes(text).tolist())
        assert len(got) == len(want)
        seen |= dict.fromkeys(want, None)
        for w in want:
            (h,) = similar_texts.shingle_hashes(w).tolist()
            assert h in got
            seen[w] = h
    assert len(set(seen.values())) == len(seen)
    assert not len(similar_texts.shingle_hashes(" \x0b\r")) and not len(similar_texts.shingle_hashes(None))


def planted(rnd):
    """Copies, near copies about the threshold, a crowd that shares a passage, and a chain whose ends are unlike."""
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for g in range(12):
        base = fresh(rnd.choice([8, 60, 150, 400]))
        for k in range(6):
            words = base[:]
            for _ in range(k if g % 2 else 0):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(99999)}"
            texts.append(words)
    base = fresh(120)
    texts += [base + fresh(rnd.choice([6, 20, 31])) for _ in range(60)]
    passage = fresh(60)
    texts += [passage + fresh(25) for _ in range(40)]
    link = fresh(100)
    for _ in range(8):
        texts.append(link)
        link = link[9:] + fresh(9)
    texts += [["a"], ["A"], ["a", "b"], [], []]
    rnd.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def brute_groups(rows):
    sets = {i: word_shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in rows:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("way", ["listed", "rounds", "blocks"])
def test_similar_texts_misses_nothing(spark, way, monkeypatch):
    rows = planted(random.Random(len(way)))
    if way != "listed":
        monkeypatch.setattr(similar_texts, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(similar_texts.common_shingles, "__defaults__", (5, 1, 2, 200))
        monkeypatch.setattr(similar_texts.node_roots, "__defaults__", (5, 0.8, 3, 4096, 10**5) if way == "rounds" else (5, 0.8, 0, 0, 400))
    got = dict(map(tuple, similar_texts.superfluous(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept_id").collect()))
    want = brute_groups(rows)
    assert got == {i: r for i, r in want.items() if i != r} and len(got) > 60


def test_similar_texts_on_odd_rows(spark, odd, empty):
    kept = similar_texts.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4] and kept.count() == 4
    assert similar_texts.keep_one(empty).count() == 0
    other = "one two three four five six seven"
    twice = spark.createDataFrame([(1, other, 7), (1, "quite another text under the same id", 8), (1, other, 9), (0, other.upper(), 1)], "doc_id long, text string, t int")
    assert {(r.doc_id, r.text) for r in similar_texts.keep_one(twice).collect()} == {(0, other.upper()), (1, "quite another text under the same id")}


def naive_fingerprint(text, seed=edit_embedding.SEED):
    """The walk one character and one step at a time, and the sampled steps by looking at all of them."""
    e = edit_embedding
    number = lambda x, s: int(e.mixed(np.array([x], np.uint64), s)[0])
    out, i, j = [], 0, 0
    while i < len(text):
        kind = (number(ord(text[i]), seed + 2) >> 33) % e.KINDS
        out.append(text[i])
        i += number(kind * e.PERIOD + j % e.PERIOD, seed) >> 40 & 1
        j += 1
    best = {}
    for s in range(2 * len(text)):
        h = number(s, seed + 1)
        best[h % e.BINS] = min(best.get(h % e.BINS, (h, s)), (h, s))
    digits = []
    for b in range(e.BINS):
        while best and b % e.BINS not in best:
            b += 1
        step = best[b % e.BINS][1] if best else len(out)
        digits.append(number(ord(out[step]), seed + 3) >> 37 & 15 if step < len(out) else 0)
    return "".join(f"{x:x}" for x in digits)


def test_fingerprints_are_those_of_a_naive_walk():
    rnd = random.Random(4)
    texts = ["", "é", "ab" * 40, "日本語 テキスト", *("".join(rnd.choice("abcde fgh\n😀") for _ in range(rnd.randrange(900))) for _ in range(8))]
    assert [edit_embedding.as_hex(x) for x in edit_embedding.fingerprint(texts)] == [naive_fingerprint(x) for x in texts]


def test_edit_embedding(spark, odd, empty):
    texts = ["abcdefghij" * 30, "abcdefghij" * 15 + "Z" + "abcdefghij" * 15, "quite another thing " * 15, "", "é"]
    a, b, c, none, one = edit_embedding.fingerprint(texts)
    assert (a == b).mean() > (a == c).mean() + 0.2
    assert not none.any() and len(one) == 256
    whole = edit_embedding.with_edited(odd).toPandas()
    assert len(whole) == len(ROWS) and whole[whole["doc_id"] == 5]["fingerprint"].nunique() == 1
    got = edit_embedding.with_edited(odd.dropDuplicates(["doc_id"])).toPandas()
    ids = [None, 1, 2, 3, 4, 5, 7]
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        own, after = text[i], text[ids[(ids.index(i) + 1) % len(ids)]]
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        p, q, n = map(edit_embedding.as_hex, edit_embedding.fingerprint([own, edited, after]))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(own), p, q)
        assert r.near_edited == pytest.approx(np.mean([x == y for x, y in zip(p, q, strict=True)]))
        assert r.near_next == pytest.approx(np.mean([x == y for x, y in zip(p, n, strict=True)]))
    assert edit_embedding.with_edited(empty).count() == 0
    assert edit_embedding.with_edited(odd.filter("doc_id = 1")).first().next_id == 1


def by_table(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_near_pairs_are_those_of_brute_force(spark, odd, empty):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(rnd.randrange(n)))
    for a, b in [(word(30), word(30)) for _ in range(200)]:
        assert edit_embedding.edit_distance(a, b) == by_table(a, b)
    texts = []
    for _ in range(4):
        base = "".join(rnd.choice("abcdefghij klm") for _ in range(400))
        for k in range(12):
            at = rnd.randrange(300, 400)
            texts.append(base[:at] + "Z" * (k % 4) + base[at:] if k else base)
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(100, texts[0]), (101, None), (None, texts[1])]
    prints = edit_embedding.fingerprint(texts)
    for least in (0.88, 0.6):
        want = {}
        for j, t in enumerate(texts):
            for i in range(j):
                near = (prints[i] == prints[j]).mean()
                if texts.index(t) == j and texts.index(texts[i]) == i and near >= least and (d := by_table(texts[i], t)) <= 0.1 * max(len(t), len(texts[i])):
                    want[i, j] = (near, d)
        got = edit_embedding.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), least, block=4).collect()
        assert len(got) == len(want) > 20 and {(r.a_id, r.b_id): (r.likeness, r.distance) for r in got} == want
        assert any(j - i > 1 for i, j in want)
    assert edit_embedding.near_pairs(empty).count() == 0 and edit_embedding.near_pairs(odd).count() == 0


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [1.0, 2.0]), (305, x[0].tolist()), (305, x[0].tolist()), (None, x[1].tolist())]
    good = neighbours.good_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.search(good.filter("vec_id % 100 = 0"), good, 10, 2, 64).toPandas()
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    for q in (0, 100, 200):
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in fine if i != q)[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == [i for _, i in want] and np.allclose(own["score"], [s for s, _ in want])
    assert neighbours.search(good.limit(0), good).count() == 0
    assert neighbours.search(good.limit(0), good.limit(0)).count() == 0
    # A repeated query row asks once for each copy's block and still gets ten ranks; its own copies are no candidates.
    twice = spark.createDataFrame([*rows, (100, x[100].tolist())], "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS dim", "3 AS ids")
    more = neighbours.good_vectors(twice)
    again = neighbours.search(more.filter("vec_id = 100"), more).toPandas()
    assert 100 not in again["vec_id"].tolist() and sorted(again["rank"]) == list(range(1, 11))
