import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from heliograph.llm import packing, token_files, token_ids

from .conftest import ROWS


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(token_ids.default_tokenizer())
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")


def test_words_encode_like_whole_texts(plain):
    texts = [r[1] for r in ROWS] + ["don't x's ''ve a—b ﬁ é É ÀÉ ² ½ _x_ 日本語 a<|startoftext|>b <|ENDOFTEXT|>", "a b c", "x..'s !!'re"]
    for x in texts:
        assert token_ids.document_ids(token_ids.default_tokenizer(), x, 2).tolist() == plain(x).tolist(), x


def test_memory_is_bounded():
    m = token_ids._Memory(lambda w: w, 4)
    for i in range(100):
        assert m[i] == i
    assert len(m) <= 4 and len(m.old) <= 4


def test_round_trip(spark, odd, empty, plain, tmp_path):
    files = token_files.write_token_files(odd, str(tmp_path / "ids"), file_bytes=64)
    got = token_files.read_token_files(files).toPandas()
    assert len(got) == len(ROWS)
    got = got.sort_values("start")
    assert got["doc_id"].tolist()[1:] == sorted(r[0] for r in ROWS if r[0] is not None)
    start = 0
    by_id = {r[0]: plain(r[1]) for r in ROWS}
    for r in got.itertuples():
        ids = by_id[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for path in sorted(files.toPandas()["file"]):
        f = token_files.TokenFile(path)
        for i in f.ids:
            assert all(x.tolist() == by_id[i].tolist() for x in f.read(i))
    assert token_files.read_token_files(token_files.write_token_files(empty, str(tmp_path / "none"))).count() == 0


def test_packing(odd, empty, plain):
    got = packing.pack(odd, capacity=256).toPandas()
    total = sum(len(plain(r[1])) for r in ROWS)
    assert got["length"].sum() == total
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 256
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    one = got[got["doc_id"] == 4].sort_values("start")
    ids = plain(ROWS[3][1])
    assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in one.itertuples()] == one["ids_crc32"].tolist()
    assert packing.pack(empty).count() == 0


def test_cuts_leave_little_padding():
    for n in range(1, 9000, 7):
        pieces = packing.cut_lengths(n, 4096)
        assert sum(p for p, _ in pieces) == n and all(p * k <= 4096 for p, k in pieces)
        assert sum(4096 // k - p for p, k in pieces) <= 32
