import random
import zlib

import numpy as np
import pytest

from convlens.llm import toxicity as tx


def brute(scores):
    """The best segment, then the best left and right of it, and so on."""
    out = []

    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 0:
            _, _, i, j = best
            out.append((i, j))
            go(a, i), go(j, b)

    go(0, len(scores))
    return sorted(out)


def test_all_maximal_segments():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-1, 1]) * r.random() * r.choice([1, 3]) for _ in range(r.randint(0, 25))]
        got = tx.maximal_segments(np.array(s))
        assert sorted((b, e) for b, e, _ in got) == brute(s)
        assert all(abs(v - sum(s[b:e])) < 1e-9 for b, e, v in got)


def test_lambda_is_the_root():
    s, w = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    lam = tx._solve_lambda(s, w)
    assert abs((w * np.exp(lam * s)).sum() - 1) < 1e-6 and lam > 0


BAD = ["vileword", "nastyterm", "uglyname"]


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(1, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randint(0, len(w)), r.choice(BAD).upper() + r.choice(["", ",", "!"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(600, 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(10_000, 1), (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    return tx.fit(tx.training_rows(frame, known, ~tx.held_out())), frame, docs, labels


def test_held_out_accuracy(fitted, spark):
    model, frame, docs, labels = fitted
    got = {r["doc_id"]: r for r in tx.score(frame, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(got[i]["score"] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    for i, text in docs[:100]:
        words = tx.words_of(text)
        for p in got[i]["passages"]:
            assert any(w.decode() in BAD for w in words[p["begin"]:p["end"]]) and p["e_value"] <= tx.MAX_E_VALUE


def test_texts_of_all_kinds(fitted, rows):
    model, *_ = fitted
    data = [(1, None, "a"), (2, "", "b"), (3, "!!! ...", "c"), (None, "vileword nastyterm vileword", "d"), (4, "plain1 " * 30_000 + "vileword " * 4, "e"), (4, "x", "f"), (4, "x", "f")]
    out = tx.score(rows(data, "doc_id long, text string, passages string"), model)
    got = out.collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= 0.5} == {None, 4}
    kept = tx.drop_toxic(rows(data, "doc_id long, text string, passages string"), model)
    assert kept.columns == ["doc_id", "text", "passages"] and sorted(r["passages"] for r in kept.collect()) == ["a", "b", "c", "f", "f"]
    assert tx.score(rows([], "doc_id long, text string"), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(50)], [(i, 1) for i in range(50)]])
def test_labels_of_one_class_or_none(spark, labels):
    docs = spark.createDataFrame(corpus(50, 2)[0], "doc_id long, text string")
    model = tx.fit(tx.training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~tx.held_out()))
    scores = {r["score"] for r in tx.score(docs, model).collect()}
    assert len(scores) == 1 and (scores.pop() > 0.5) == bool(labels and labels[0][1])


def test_bounded_sample(spark):
    docs, labels = corpus(200, 3)
    rows = tx.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ~tx.held_out(), 50)
    assert rows.count() == 50


def test_repeated_rows_are_learnt_from_once(spark):
    docs, labels = corpus(200, 5)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = spark.createDataFrame(docs, "doc_id long, text string")
    many = spark.createDataFrame(docs + [docs[7]] * 500 + [(9, None)], "doc_id long, text string").repartition(5)
    rows = tx.training_rows(many, known, ~tx.held_out())
    assert rows.count() == tx.training_rows(one, known, ~tx.held_out()).count()
    assert {r["text"] for r in rows.collect()} - {t for _, t in docs} <= {None, ""}


def test_whole_score_equals_brute_force(spark):
    """Fit and score again, word by word, from the formulas of the docstring."""
    import math

    docs, labels = corpus(500, 8)
    r = random.Random(3)  # clean texts hold such words too, now and then
    docs = [(i, t + " " + r.choice(BAD) if i % 5 and r.random() < 0.15 else t) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    learnt = tx.training_rows(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), ~tx.held_out())
    model = tx.fit(learnt)
    rows = [(r["text"], int(r["toxic"]), r["half"]) for r in learnt.collect()]

    def places(word):
        return [zlib.crc32(word) & (tx.PLACES - 1)] + [zlib.crc32(b"^" + word[:n]) & (tx.PLACES - 1) for n in tx.STEMS]

    seen = [{}, {}]
    for text, toxic, half in rows:
        if half:
            for place in {p for w in tx.words_of(text) for p in places(w)}:
                seen[toxic][place] = seen[toxic].get(place, 0) + 1
    total = sum(sum(x.values()) for x in seen)

    def prior(place):
        return tx.PRIOR_COUNTS * (seen[0].get(place, 0) + seen[1].get(place, 0) + 0.01) / (total + 0.01 * tx.PLACES)

    n_a, n_b = (sum(seen[k].values()) + tx.PRIOR_COUNTS for k in (1, 0))

    def odds(place):
        a, b = (seen[k].get(place, 0) + prior(place) for k in (1, 0))
        v = math.log(a / (n_a - a)) - math.log(b / (n_b - b))
        return v if abs(v) >= tx.MIN_Z * math.sqrt(1 / a + 1 / b) else 0.0

    def word_score(word):
        own = [odds(p) for p in places(word)]
        return next((v for v in own if v), own[-1]) - tx.DRIFT

    known = {}
    mean = lambda lam: sum(c * math.exp(lam * (odds(p) - tx.DRIFT)) for p, c in seen[0].items()) / sum(seen[0].values())
    assert abs(mean(model.lam) - 1) < 1e-3 and model.lam not in (0, 1)

    def segments(text):
        s = [known[w] if w in known else known.setdefault(w, word_score(w)) for w in tx.words_of(text)]
        return [sum(s[b:e]) for b, e, _ in tx.maximal_segments(np.array(s))], len(s)

    held = [(segments(text), toxic) for text, toxic, half in rows if not half]
    usual = sorted(model.lam * max(s) - math.log(n) for (s, n), toxic in held if not toxic and s)
    middle = (usual[(len(usual) - 1) // 2] + usual[len(usual) // 2]) / 2
    assert abs(model.log_k - (middle + math.log(math.log(2)))) < 1e-3

    def features(s, n):
        return 1.0, max(model.lam * max(s) - model.log_k - math.log(n), tx.FLOOR) if s else tx.FLOOR, math.log1p(model.lam * sum(s))

    # the weights are where the penalized likelihood is flat
    slope = [0.0] * 3
    for (s, n), toxic in held:
        x = features(s, n)
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(model.weights, x))))))
        slope = [g + (toxic - p) * v for g, v in zip(slope, x)]
    assert all(abs(g - r * w) < 1e-2 for g, r, w in zip(slope, (1e-6, 1, 1), model.weights))
    for r in tx.score(frame, model).collect():
        x = features(*segments(dict(docs)[r["doc_id"]]))
        z = sum(w * v for w, v in zip(model.weights, x))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-3
