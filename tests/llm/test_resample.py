import math
import random
import zlib

import numpy as np
import pytest
import regex

from convlens.llm import resample as rs
from convlens.llm.common import store

DDL = "doc_id long, text string, tie string, k0 string, row string, rank string"
TEXTS = ["", None, "One two, THREE four", "état Été x9 9x", "a\x00b\x7fc~d", "日本 語x", "İK ß", "word " * 700_000]


def brute(docs, target, percent=10, least=20, longest=1, seed=2024):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * 10000, [0] * 10000
    each = [(d, *features(x)) for d, x in docs]
    for _, _, f in each:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)] if any(s) or any(t) else [0] * 10000
    out = [(d, n, len(f), w := sum(gain[b] for b in f) // len(f) if f else 0, w + rs.gumbel(d, seed)) for d, n, f in each]
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    k = percent * len(able) // 100
    return sorted((repr((d, f, w, s, None)) for d, n, f, w, s in out if n < least)) + sorted(repr((d, f, w, s, None)) for d, _, f, w, s in able[k:]), [(d, f, w, s, i + 1) for i, (d, _, f, w, s) in enumerate(able[:k])]


def test_words_are_the_pattern():
    for t in TEXTS:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        assert [w.decode() for w in rs.words_of(t)] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 37), (1, 100), (2, 0)])
def test_equals_brute_force(spark, rows, longest, percent):
    r = random.Random(longest)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(n))
    docs = [(i, say(r.randint(0, 60))) for i in range(400)] + list(enumerate(TEXTS, 1000)) + [(None, say(30)), (7, "same " * 25), (8, "same " * 25)]
    target = [say(40), None, "", say(5)]
    got = rs.draw(rows([(d, t, "clash", "clash", "clash", "clash") for d, t in docs], DDL, 5), rows([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent, longest=longest).collect()
    plain, drawn = brute(docs, target, percent, longest=longest)
    assert sorted((tuple(x) for x in got if x["rank"]), key=lambda x: x[4]) == drawn
    assert sorted(repr(tuple(x)) for x in got if not x["rank"]) == sorted(plain)


@pytest.mark.parametrize("n,parts,few", [(1, 1, 0), (2, 2, 0), (3, 1, 1), (100, 7, 2), (1001, 3, 100)])
def test_cutoff_is_exact(spark, n, parts, few):
    r = np.random.default_rng(n)
    data = [(int(a), int(b), 0, i) for i, (a, b) in enumerate(zip(r.integers(0, 4, n), r.integers(0, 9, n)))]
    keys = store(spark.createDataFrame(data, "k0 long, k1 long, k2 long, k3 long").repartition(parts), "t")
    for k in {1, n // 3, n} - {0}:
        assert rs.cutoff(keys, k, few) == sorted(data)[k - 1]
    assert rs.cutoff(keys, n + 1, few) is None and rs.cutoff(keys, 0, few) is None


def test_weighted_median_leaves_a_quarter_on_both_sides():
    r = random.Random(4)
    for _ in range(200):
        parts = [sorted((r.randint(0, 50), 0, 0, r.random()) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 9))]
        m = rs._weighted_median([(len(p), p[(len(p) - 1) // 2]) for p in parts])
        flat = [k for p in parts for k in p]
        assert sum(k <= m for k in flat) * 4 >= len(flat) and sum(k >= m for k in flat) * 4 >= len(flat)


def test_repeated_rows_and_empty_tables(spark, rows):
    twin = [(5, "w " * 30)] * 40
    got = rs.draw(rows(twin, "doc_id long, text string"), rows([], "item_id long, text string")).collect()
    assert len(got) == 40 and sorted(x["rank"] for x in got if x["rank"]) == [1, 2, 3, 4]
    assert rs.draw(rows([], "doc_id long, text string"), rows([], "item_id long, text string")).count() == 0
