import random
import re

import pytest

from convlens.llm import hyperminhash as hm
from convlens.llm import near_dedup as nd
from convlens.llm.components import connected_components


def brute(rows, size):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                c = len(sets[i] & sets[j])
                if 100 * c >= 80 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((d, len(sets[i]), comp, d is None or d == comp))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = (r.choice(out)[1] or "x").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = r.choices(vocab, k=r.choice([1, 2, 3, 8, 40, 90, 200]))
        out.append((i * 7 % 101, " ".join(w)))
    return out


EDGES = [(None, "null id here"), (None, "null id here"), (500, ""), (501, ""), (502, None), (503, "One"), (504, "one"), (505, "ONE two"), (506, "one\ttwo"), (507, "été É"), (508, "été é"), (503, "one"), (509, " \n ")]


@pytest.mark.parametrize("blocks", [2000, 3])
def test_equals_all_pairs(spark, rows, monkeypatch, blocks):
    monkeypatch.setattr(nd, "BUCKET_BLOCK", blocks)
    monkeypatch.setattr(nd, "FAMILY_BLOCK", blocks)
    data = corpus(3) + EDGES
    docs = rows([(d, t, 1, "k") for d, t in data], "doc_id long, text string, node int, family string")
    got = nd.near_duplicates(docs, 2, 80).drop("checksum").collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, 2)


def test_five_words(spark, rows):
    data = corpus(8)
    assert sorted(map(tuple, nd.near_duplicates(rows(data, "doc_id long, text string")).drop("checksum").collect()), key=repr) == brute(data, 5)


def test_empty_table(spark, rows):
    assert nd.near_duplicates(rows([], "doc_id long, text string")).count() == 0


def test_estimates():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 900):
        base = hm.mix(r.integers(1, 1 << 62, 2 * n).astype(np.uint64))
        for same in (0, n // 2, n):
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:same], base[n:2 * n - same]]))
            j = same / (2 * n - same)
            assert abs(hm.estimate(hm.registers(a), hm.registers(b)) - j) < 0.15


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 2000 + i) for i in range(50)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_of_equal_checksum(spark, rows):
    data = [(1, "plumless a b c"), (7, "plumless a b c"), (7, "buckeroo a b c")]
    got = nd.drop_near_duplicates(rows(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [data[0], data[2]]
