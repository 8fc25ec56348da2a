import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = [f"{a}{b}{i}" for i in range(60) for a in ("lo", "ra") for b in ("min", "dos")]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    docs, labels = [], []
    for i in range(300):
        text = say(r.randint(20, 120))
        if i % 6 == 0:
            text += " vileword nastyterm " + say(3) + " vileword uglyname"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    item, passage = say(40), say(60)
    extra = {
        "copy": docs[1][1], "near": " ".join(docs[2][1].split(" ")[:-1] + ["other"]), "leak": say(20) + "\n" + item + "\n" + say(20),
        "first": say(30) + " " + passage + " " + say(30), "second": say(30) + " " + passage + " " + say(30), "toxic": "vileword " * 5 + say(30),
        "empty": "", "null": None, "clean": say(90),
    }
    ids = {}
    for k, (name, text) in enumerate(extra.items()):
        ids[name] = 1000 + k
        docs.append((1000 + k, text, "en", "x", len(text or "")))
    docs += [(None, "null id " + say(30), "en", "x", 1), docs[3], docs[3]]
    path = str(tmp_path_factory.mktemp("sf"))
    for name, data, ddl in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(0, item), (1, say(50))], "item_id long, text string"),
    ):
        spark.createDataFrame(data, ddl).write.parquet(f"{path}/{name}.parquet")
    return path, docs, ids, passage


def test_stages_and_run(spark, corpus):
    path, docs, ids, passage = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        frame = cp.store(stage(spark, frame, path), f"test_{name}")
        seen.append({r["doc_id"]: r for r in frame.collect()})
        if name != cp.STAGES[-1][0]:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, near, cut, leaks, tokens = seen
    lost = {d for d, *_ in docs} - set(toxic)
    assert ids["toxic"] in lost and {i for i in range(0, 300, 6)} <= lost and lost <= {i for i in range(0, 300, 6)} | {ids['toxic']}
    assert set(toxic) - set(near) == {ids["copy"], ids["near"]}
    assert set(cut) == set(near) and passage in cut[ids["first"]]["text"] and len(cut[ids["second"]]["text"]) < len(near[ids["second"]]["text"]) - 250
    assert cut[ids["clean"]]["text"] == near[ids["clean"]]["text"] and cut[ids["clean"]]["n_chars"] == len(near[ids["clean"]]["text"])
    assert set(cut) - set(leaks) == {ids["leak"]}
    assert set(tokens) == set(leaks) and all(r["decodes"] and r["n_tokens"] == len(r["token_ids"]) for r in tokens.values())
    assert tokens[ids["empty"]]["token_ids"] == [] and None in tokens
    assert sum(r["doc_id"] == 3 for r in frame.collect()) == 1
    ran = cp.run(spark, path)
    assert sorted((r["doc_id"] or -1, r["token_ids"]) for r in ran.collect()) == sorted((r["doc_id"] or -1, r["token_ids"]) for r in frame.collect())


def test_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
