import hashlib
import json
import random

import numpy as np
import pytest

from convlens.llm import bpe_cuts as bc
from convlens.llm.common import TOKENIZER_DIR

PATH = f"{TOKENIZER_DIR}/word_bpe_49k.json"
TEXTS = [
    "", None, "Plain words HERE", "two  spaces\n\t and\x0b\x0c\r lines ", "don't!!'s it'Ll 'S 've", "a\x1cb \x1f c\x85d\xa0e", "<|endoftext|> in <|startoftext|>x<|endoftext|><|endoftex|>",
    "the</w> cat</w> </w>", "12½ ²x ٣٤ 日本語 ☃😀😀 zźé", "ΑΣ Ὀδυσσεύς İSTANBUL ẞ ǅ", "́ ́x 각", "q" * 5000 + "zx" * 3000, "__--__ ~~`` \x00\x7f", "﻿bom​zero line",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_forced_cuts_lie_inside_no_token():
    model = json.load(open(PATH))["model"]
    allowed, byte = bc.pair_table(list(model["vocab"]), "</w>"), {c: b for b, c in enumerate(bc.byte_characters())}
    assert 0 < allowed.sum() < 5000 and not allowed[ord("q"), ord("z")]
    for token in random.Random(1).sample(sorted(model["vocab"]), 3000):
        body = [byte[c] for c in token.removesuffix("</w>")]
        assert all(allowed[x, y] for x, y in zip(body, body[1:]))
    e = bc.FragmentEncoder(PATH)
    assert e.cuts([b"aqzb", b"the"]) == ([2, 4, 7], [False, True, True])


def test_equals_the_library(spark, rows, library):
    data = [(i, t, "clash", i, "clash", "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None), (2, "Repeated id", "", 0, "", "")]
    docs = rows(data, "doc_id long, text string, token_ids string, `a b.c` long, decoded string, rest string")
    both = bc.encode_and_decode(docs, PATH)
    assert both.columns == ["doc_id", "a b.c", "rest", "token_ids", "decoded"]
    ids = bc.encode(docs, PATH)
    assert ids.columns == ["doc_id", "a b.c", "decoded", "rest", "token_ids"]
    again = {r["doc_id"]: r for r in bc.decode(ids.where("doc_id <> 2"), PATH).collect()}
    want = {}
    for i, t, *_ in data:
        x = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append((x, library.decode(x, skip_special_tokens=False)))
    got = {}
    for r in both.collect():
        got.setdefault(r["doc_id"], []).append((r["token_ids"], r["decoded"]))
        if r["doc_id"] in again:
            assert (again[r["doc_id"]]["token_ids"], again[r["doc_id"]]["decoded"], again[r["doc_id"]]["rest"]) == (r["token_ids"], r["decoded"], "x")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_random_texts_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(bc, "KEPT", 50)
    monkeypatch.setattr(bc, "GROUP_CHARS", 200)
    r = random.Random(3)
    parts = ["the", "Été", "x.y", "it's", "'s", "a\x1cb", "٣", "½", "<|endoftext|>", "<|", "", "\n", "\t", "\xa0", "日本", "😀", "--", "123", "_", "re're", "　", "\x00", "ñ", "Σ", "é", "qzqz", "</w>"]
    texts = [r.choice([" ", "  ", ""]).join(r.choices(parts, k=r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(r.choices(["ab", " ", "É", "'", "ll", "7", "!", "zq"], k=300)) for _ in range(100)]
    e = bc.FragmentEncoder(PATH)
    for text, got in zip(texts, e.encode(texts), strict=True):
        ids = np.frombuffer(got, "<i4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert len(e.units) < 2000 and all(len(u) <= bc.KEPT_CHARS for u in e.units)


def test_contract_digests_and_giant_text(spark, tmp_path, library):
    texts = [None, "", "Some words, and more", "giant word " * 150_000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in bc.op12_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_empty_table(spark, rows):
    assert bc.encode_and_decode(rows([], "doc_id long, text string"), PATH).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bc.FragmentEncoder(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
