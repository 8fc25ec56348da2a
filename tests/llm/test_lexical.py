import math
import random
from collections import Counter

import numpy as np
import pytest

from convlens.llm import lexical as lx

DDL = "doc_id long, text string, score long, row long, item_id long"


def brute(docs, items, k=10):
    bags = [(d, Counter(lx.terms_of(t))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        ask = set(lx.terms_of(text))
        rows = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total if total else 0
            s = sum(weight[t] * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in ask if t in b)
            rows += [(-s, d is not None, d or 0, d)] if s > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(rows, key=lambda r: r[:3])[:k])]
    return sorted(out, key=repr)


def corpus(seed, n_docs, n_items, longest=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    say = lambda n: " ".join(r.choices(vocab, weights=[1 / (i + 1) for i in range(200)], k=n))
    return say, [(i, say(r.randint(0, longest))) for i in range(n_docs)], [(i, say(r.randint(1, 25))) for i in range(n_items)]


@pytest.mark.parametrize("shard,block_bytes", [(7, 10**6), (100, 600)])
def test_equals_brute_force(spark, rows, monkeypatch, shard, block_bytes):
    # task code is pickled by reference: shards are cut by the batch size here
    say, docs, items = corpus(shard, 300, 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", shard)
    try:
        docs += [(None, say(20)), (None, None), (3, ""), (3, say(30)), (5, docs[5][1]), (900, "W1, w2! É"), (901, "w1 " * 400_000)]
        items += [(None, say(5)), (0, say(9)), (77, None), (78, ""), (79, "unheardof"), (80, "É é w1 W1 w1")]
        got = lx.rank_documents(rows([(d, t, 0, 0, 0) for d, t in docs], DDL, 4), rows([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), block_bytes=block_bytes)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shards_of(docs, items, size):
    """The index of a list, without Spark."""
    import pyarrow as pa

    it = lx.Items([(i, i, t) for i, t in items])
    parts = [list(lx._postings(iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs[a:a + size]], "text": [t for _, t in docs[a:a + size]]})]), it.number)) for a in range(0, len(docs), size)]
    n = np.concatenate([p[1] for x in parts for p in x])
    df = sum(np.bincount(p[2], minlength=len(it.number)) for x in parts for p in x)
    it.weigh(df, int((n > 0).sum()))
    for x in parts:
        ids, n_of, term, doc, tf = (np.concatenate(c) for c in zip(*x))
        impact = lx.impacts(it.weight[term], tf, lx.lengths_to_m(n_of, int((n > 0).sum()), int(n.sum()))[doc])
        start = np.searchsorted(term, np.arange(len(it.weight) + 1))
        most = np.array([impact[a:b].max(initial=0) for a, b in zip(start, start[1:])])
        yield it, {"doc_ids": ids, "start": start, "doc": doc, "impact": impact, "most": most, "joint": lx.joint_maxima(list(it.pair), start, doc, impact, most)}


def test_pair_bounds_hold_and_tighten():
    _, docs, items = corpus(5, 400, 30)
    tighter = 0
    for it, shard in shards_of(docs, items, 100):
        dense = np.zeros((len(it.weight), len(shard["doc_ids"])), np.int64)
        for t in range(len(it.weight)):
            dense[t, shard["doc"][shard["start"][t]:shard["start"][t + 1]]] = shard["impact"][shard["start"][t]:shard["start"][t + 1]]
        for (a, b), k in it.pair.items():
            assert shard["joint"][k] == (dense[a] + dense[b]).max()
        for order, pairs in zip(it.order, it.pairs_of):
            bound = lx.bounds(shard["most"][order], shard["joint"][pairs])
            for i in range(len(order) + 1):
                assert dense[order[i:]].sum(axis=0).max(initial=0) <= bound[i] <= shard["most"][order[i:]].sum()
            tighter += bound[0] < shard["most"][order].sum()
    assert tighter > 50


@pytest.mark.parametrize("least", [0, 1, 10**6, 4 * 10**6, 10**8])
def test_search_keeps_all_that_reach_the_score(least):
    _, docs, items = corpus(6, 300, 30)
    for it, shard in shards_of(docs, items, 150):
        for order, pairs in zip(it.order, it.pairs_of):
            full = np.zeros(len(shard["doc_ids"]), np.int64)
            for t in order:
                full[shard["doc"][shard["start"][t]:shard["start"][t + 1]]] += shard["impact"][shard["start"][t]:shard["start"][t + 1]]
            scores, at = lx.search_shard(shard, order, pairs, 10, least)
            floor = max(least, 1, int(np.sort(full)[-10]))
            assert (full[at] == scores).all() and set(np.flatnonzero(full >= floor)) <= set(at.tolist())


def test_empty_tables(spark, rows):
    none, some = rows([], "doc_id long, text string"), rows([(1, "a b")], "item_id long, text string")
    assert lx.rank_documents(none, some).count() == 0
    assert lx.rank_documents(rows([(1, "a")], "doc_id long, text string"), rows([], "item_id long, text string")).count() == 0
    assert lx.rank_documents(rows([(1, None), (2, " ,")], "doc_id long, text string"), some).count() == 0


def test_long_lengths_do_not_overflow():
    n = np.array([10**9, 3], np.int64)
    assert lx.lengths_to_m(n, 10**11, 10**13).tolist() == [10 + 90 * 10**9 * 10**11 // 10**13, 10 + 90 * 3 * 10**11 // 10**13]
