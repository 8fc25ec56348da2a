import functools
import random

import pytest

from convlens.llm import piece_scan as ps
from convlens.llm.common import TOKENIZER_DIR

PATH = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
TEXTS = [
    "", None, " ", "  ", "a", " lead", "trail ", "trail  ", "two  spaces   here", "new\nline \n x", "tab\t x", "▁ under ▁▁ x▁ y▁", "été ça 日本語 😀😀 x",
    "<s> </s> <unk> <0x0A>", "nb\xa0 sp", "the the the", "ﬁ ligature ① ½ Ａ", "​ zero \x00 x", "aaaa" * 50, "_" * 90, "    " * 30,
]


@pytest.fixture(scope="module")
def model():
    return ps.Model(PATH)


def test_units_equal_the_library(model):
    texts = [t or "" for t in TEXTS]
    import numpy as np

    for t, x in zip(texts, model.encode(texts)):
        assert np.frombuffer(x, "<i4").tolist() == model.sp.encode(t), repr(t)


def test_own_merges_equal_the_library(model):
    r = random.Random(5)
    for _ in range(300):
        s = "".join(r.choices("aabeinrst▁▁éx", k=r.randint(1, 14)))
        assert [i for p in model.bpe(ps.SPACE + s) for i in model.piece_ids(p)] == model.sp.encode(s.replace(ps.SPACE, " "))


def scan(model, text, size):
    s = ps.SPACE + text.replace(" ", ps.SPACE)
    n = -(-len(s) // size)
    cuts = [(k * size, min(len(s), (k + 1) * size)) for k in range(n)]
    each = [ps.transfer(model, s, lo, hi, k == 0, k == n - 1) for k, (lo, hi) in enumerate(cuts)]
    whole = functools.reduce(ps.multiply, each)
    assert whole == [((0, 0), (0, 0))]
    # associative: any bracketing gives the same product
    assert functools.reduce(lambda b, a: ps.multiply(a, b), reversed(each)) == whole
    state, ids = (0, 0), []
    for k, (lo, hi) in enumerate(cuts):
        rest = functools.reduce(ps.multiply, each[k + 1:]) if k < n - 1 else None
        (b,) = {y for x, y in each[k] if x == state and (rest is None or any(z == y for z, _ in rest))}
        ids += ps.backtrace(model, s, lo, hi, k == n - 1, state, b)
        state = b
    return ids


def test_scan_equals_the_library_on_random_texts(model):
    r = random.Random(7)
    for _ in range(60):
        alphabet = r.choice(["aab ", "eintrsh  ", "_-= ", "日本é x", "aaaa", "theandof "])
        text = "".join(r.choices(alphabet, k=r.randint(1, 300)))
        size = r.choice([17, 20, 33, 64])
        assert scan(model, text, size) == model.sp.encode(text), (text, size)


def test_operator(spark, rows, model):
    r = random.Random(1)
    long = ["".join(r.choices("eintr sh", k=500)), "a" * 333, " ".join(["wort"] * 80), "é" * 200, " " * 150]
    data = [(i, t, "x", 1) for i, t in enumerate(TEXTS + long + long[:2])] + [(None, long[0], None, None), (3, "again", "y", 2)]
    docs = rows(data, "doc_id long, text string, `k` string, `_key2` int")
    got = ps.decode(ps.encode(docs, PATH, chunk_chars=64), PATH).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["token_ids"], x["k"] or "") for x in got) == sorted((d is None, d or 0, model.sp.encode(t or ""), k or "") for d, t, k, _ in data)
    by = {(d, tuple(model.sp.encode(t or ""))): t or "" for d, t, *_ in data}
    for x in got:
        assert x["decoded"] == by[x["doc_id"], tuple(x["token_ids"])].replace(ps.SPACE, " ")


def test_empty_table(spark, rows):
    assert ps.decode(ps.encode(rows([], "doc_id long, text string"), PATH), PATH).count() == 0
