"""Columns that are named like what the operators use inside, repeated and null
benchmark ids, and a text above the size at which batches are cut."""

import random

import pytest

from convlens.llm import decontam, near_dedup, piece_scan, repeats, toxicity
from convlens.llm.common import TOKENIZER_DIR

NAMES = ["_leak_d", "d", "c", "rest", "row", "_id", "stays", "checksum", "spans", "_", "_rest", "_text", "_key", "key", "x", "decoded", "a.b"]
DDL = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)


def say(seed, n):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(4000)], k=n))


ITEM = say(1, 30)
LONG = say(2, 250_000)  # 1.4 MB
TEXTS = {1: say(3, 60), 2: say(3, 60), 3: say(4, 20) + " " + ITEM + " " + say(5, 20), 4: None, 5: "", 6: LONG, 7: say(6, 40) + " " + say(2, 250_000)[:3000], None: say(7, 30)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in TEXTS.items()], DDL).repartition(3)


def same(out, docs, ids, but=()):
    assert out.columns == docs.columns
    got = sorted((r.asDict() for r in out.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert {r["doc_id"] for r in got} == set(ids) and len(got) == len(ids)
    for r in got:
        assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES if n not in but)
    return {r["doc_id"]: r["text"] for r in got}


def test_drop_leaks(docs, rows):
    bench = rows([(None, ITEM), (7, say(8, 30)), (7, say(3, 60)), (7, say(3, 60)), (9, None)], "item_id long, text string")
    assert same(decontam.drop_leaks(docs, bench), docs, [4, 5, 6, 7, None])[6] == LONG
    found = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).where("item_id IS NULL OR doc_id <> 3").collect())
    assert found == [(1, 7), (2, 7), (3, None)]


def test_drop_near_duplicates(docs):
    assert same(near_dedup.drop_near_duplicates(docs.union(docs.where("doc_id = 5"))), docs, [1, 3, 4, 5, 6, 7, None])[6] == LONG


def test_cut_repeats(docs):
    texts = same(repeats.cut_repeats(docs), docs, TEXTS)
    assert texts[2] == "" and texts[1] == TEXTS[1] and texts[6] == LONG and len(texts[7]) < 400


def test_pieces(docs):
    path = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
    sp = piece_scan.Model(path).sp
    one = piece_scan.encode(docs, path, decoded=True)
    two = piece_scan.decode(piece_scan.encode(docs, path), path)
    assert one.columns == ["doc_id", *[n for n in NAMES if n != "decoded"], "token_ids", "decoded"] == two.columns
    a, b = (sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])) for out in (one, two))
    assert a == b
    for r in a:
        t = TEXTS[r["doc_id"]] or ""
        assert r["token_ids"] == sp.encode(t) and r["decoded"] == t and r["_key"] == f"_key{r['doc_id']}"


def test_drop_toxic(docs, spark):
    labels = spark.createDataFrame([(1, 0), (6, 0), (7, 1)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, toxicity.fit(toxicity.training_rows(docs, labels, ~toxicity.held_out())))
    assert out.columns == docs.columns and out.count() <= len(TEXTS)
