import zlib

import numpy as np
import pytest

from convlens.llm import token_shards as ts
from convlens.llm.common import TOKENIZER_DIR, shared_path
from convlens.llm.word_cache import split_units

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
DDL = "doc_id long, text string, file string, start string"
TEXTS = [
    "", None, "plain words here", "two  spaces   and\n newline", " lead and trail ", "tab\t next\r\n  x", "nb\xa0 sp  wide", "<|endoftext|> in <|endoftext|>text",
    "l'été ça's 123 ½ x²y ____ a\x1cb \x1c c", "x" * 3000, "😀 emoji ☃ é text  sep", "plain words here", "\n\n  \n", "it's we'll  I'd",
]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 29, 32])
def test_pack_unpack_any_range(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = ts.pack_ids(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    for a, n in [(0, 1001), (0, 0), (7, 13), (1000, 1), (513, 400)]:
        assert (ts.unpack_ids(packed, bits, a, n) == ids[a:a + n]).all()


def test_equals_the_library(spark, rows):
    data = [(i * 3, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (6, "repeated id", "", "")]
    path = shared_path(spark, "t")
    ts.write_shards(rows(data, DDL), path, PATH)
    got = sorted((r.asDict() for r in ts.read_shards(spark, path).collect()), key=lambda r: r["start"])
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text, *_), ids in zip(got, order, library([x[1] for x in order]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, start, len(ids), ids), text
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_blocks_and_random_access(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    path = shared_path(spark, "t")
    # long texts: several blocks in a file
    data = [(i, "word%d and more " % i * (40_000 if i < 12 else 5)) for i in range(60)]
    ts.write_shards(rows(data, "doc_id long, text string"), path, PATH)
    index = ts.index_shards(spark, path)
    assert index.agg(F.max("block")).first()[0] >= 1
    flat = np.concatenate([np.array(x) for x in library([t for _, t in data])])
    assert index.agg(F.sum("n_ids")).first()[0] == len(flat)
    for a, n in [(0, 10), (len(flat) - 7, 100), (250_000, 300_000), (5, 0)]:
        assert (ts.read_ids(index, a, n) == flat[a:a + n]).all()


def test_empty_table(spark, rows):
    path = shared_path(spark, "t")
    ts.write_shards(rows([], "doc_id long, text string"), path, PATH)
    assert ts.read_shards(spark, path).count() == 0


def test_units_join_to_the_text():
    for t in TEXTS:
        assert " ".join(split_units(t or "")) == (t or "")


def test_words_joined_equal_the_library():
    import random

    r = random.Random(11)
    pieces = ["the", "Été", "x.y", "it's", "'s", "a\x1cb", "٣", "½", "<|endoftext|>", "<|", "", "\n", "\t", "\xa0", "日本", "😀", "--", "123", "_", "re're", "　", "\x00"]
    encode, _ = ts._encoder(PATH)
    texts = [r.choice([" ", "  ", " "]).join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choices(["ab", " ", "É", "'", "ll", "7", "!"], k=30)) for _ in range(1500)]
    for text, got, want in zip(texts, encode(texts), library(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want[:-1], repr(text)
    other, _ = ts._encoder(f"{TOKENIZER_DIR}/word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/word_bpe_49k.json")
    for text, got in zip(texts[:200], other(texts[:200])):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
