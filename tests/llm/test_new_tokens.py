"""Best-fit packing against one piece at a time, and fill-in-the-middle against its definition."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from heliograph.llm import best_fit, fill_middle, token_ids
from heliograph.llm.shared import table

from .conftest import ROWS

SF = "/root/testdata/sf0.001"


def one_by_one(lengths, capacity):
    """Sequences of matching and best fit with every piece for itself."""
    items = sorted(lengths, reverse=True)
    large, gaps = [n for n in items if 3 * n > capacity], []
    while large:
        n = large.pop(0)
        if other := next((m for m in large if n + m <= capacity), 0):
            large.remove(other)
        gaps.append(capacity - n - other)
    for n in items:
        if 3 * n <= capacity:
            fit = min((g for g in gaps if g >= n), default=None)
            gaps.append((capacity if fit is None else fit) - n)
            if fit is not None:
                gaps.remove(fit)
    return len(gaps)


def test_plan_is_what_single_pieces_give():
    rng = random.Random(1)
    for _ in range(500):
        capacity, counts = rng.choice([10, 30, 64, 100]), {}
        for _ in range(rng.randint(0, 60)):
            n = rng.randint(1, capacity)
            counts[n] = counts.get(n, 0) + 1
        rows, bins = sorted(best_fit.plan(counts, capacity)), {}
        for k, (n, number, first, per, offset) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == n else counts[n]
            for x in range(end - number):
                bins.setdefault(first + x // per, []).append((offset + x % per * n, n))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in own) <= 2
        assert sum(map(len, bins.values())) == sum(counts.values())
        assert len(bins) == one_by_one([n for n, c in counts.items() for _ in range(c)], capacity)


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    assert len(best_fit.plan(counts, 4096)) < 4 * 4096


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(token_ids.default_tokenizer())
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")


def held(got, by_id, capacity):
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= capacity
    for r in got.itertuples():
        ids = by_id[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert got["sequence_id"].nunique() == one_by_one(got["length"].tolist(), capacity)


def test_best_fit(spark, odd, empty, plain):
    got = best_fit.pack(odd.repartition(3), capacity=256).toPandas()
    assert got["length"].sum() == sum(len(plain(r[1])) for r in ROWS)
    held(got, {r[0]: plain(r[1]) for r in ROWS}, 256)
    assert best_fit.pack(empty).count() == 0


def test_best_fit_of_the_table(spark, plain):
    docs = {r["doc_id"]: plain(r["text"]) for r in table(spark, SF, "documents").collect()}
    got = best_fit.query(spark, SF).toPandas()
    assert len(got) == sum(-(-len(x) // 4096) for x in docs.values())
    held(got, docs, 4096)
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 4096 + 1


TEXTS = ["", None, "a", "\n", "a\nb", "a\n\n\nb\n", "x <S> y\nz", "<P>", "é\n" * 50, "日本\n\U0001f600\r\nend", "one line " * 9000, "l\n" * 40000]


def test_fill_middle_by_definition(spark):
    rows = [(None if k == 3 else k, t, 0) for k, t in enumerate(TEXTS)] + [(k, "first\nsecond\nthird\nlast", 1) for k in range(100, 160)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output int").repartition(3)
    made = fill_middle.fill_in_middle(df)
    got = made.withColumn("back", fill_middle.restore(made["output"], made["form"])).collect()
    assert len(got) == len(rows)
    by_id, forms = {r[0]: r[1] or "" for r in rows}, set()
    for r in got:
        text = by_id[r["doc_id"]]
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        x = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["back"]) == (len(units), form, want, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_fill_middle_rate(spark):
    df = spark.createDataFrame([(k, "a\nb\n") for k in range(400)], "doc_id long, text string")
    forms = {r["form"]: r["count"] for r in fill_middle.fill_in_middle(df, rate=50, spm=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260


def test_fill_middle_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(fill_middle.SQL).to_arrow_table().to_pylist()
    got = [r.asDict() for r in fill_middle.query(spark, SF).collect()]
    assert len(want) and sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])
