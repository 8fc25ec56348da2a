import random
import re
from collections import Counter

from pyspark.sql import functions as F

from convlens.llm import decontam as dc


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs, items):
    """The best similarity of any window of an item's size, of all windows there are."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v:
                continue
            k = min(5, len(v))
            best = max((similarity(bag(w[s:s + len(v)], k), bag(v, k)) for s in range(max(1, len(w) - len(v) + 1))), default=0)
            if best >= 0.8:
                out[d, i] = best
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(14, 60)))) for i in range(25)] + [(25, "yes it is"), (26, None), (27, " ... "), (28, "echo echo echo echo echo echo echo echo"), (29, "Été à l'Œuvre, now and then!")]
    items.append((30, items[3][1]))
    docs = []
    for d in range(120):
        w = r.choices(vocab, k=r.choice([0, 3, 30, 120]))
        if d % 2:
            p = words(r.choice(items[:25])[1])
            for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
                j = r.randrange(len(p))
                r.choice([lambda: p.__setitem__(j, "zz"), lambda: p.insert(j, "ins"), lambda: p.pop(j) if len(p) > 9 else None])()
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((d, r.choice([" ", "\n", ", ", " -- "]).join(w).upper() if d % 3 == 0 else " ".join(w)))
    docs += [(500, "well yes, IT is."), (501, items[28][1]), (502, "echo echo echo"), (503, "été à l œuvre now and then"), (504, None), (505, items[3][1][:-1]), (None, items[2][1]), (506, items[1][1] + " x"), (506, items[1][1] + " x")]
    return docs, items


def test_finds_what_all_windows_find(spark, rows):
    docs, items = corpus(3)
    got = dc.find_leaks(rows([(*x, "s", 1, 2) for x in docs], "doc_id long, text string, k string, size int, d int"), rows([(*x, 0) for x in items], "item_id long, text string, h int")).collect()
    want = brute(docs, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert len(found) == len(got)
    # a window is placed where a shingle matches: of pairs barely at the threshold the best placed one may fall short
    clear = {k for k, v in want.items() if v >= 0.84}
    assert clear <= set(found) <= set(want)
    assert all(abs(found[k] - want[k]) < 0.1 and found[k] <= want[k] + 1e-9 for k in found)
    assert {(500, 25), (501, 28), (503, 29), (505, 3), (505, 30), (None, 2)} <= set(found) and (502, 28) not in found


def test_all_fingerprints_within_the_radius_share_a_key():
    r = random.Random(1)
    for _ in range(500):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), dc.RADIUS):
            b ^= 1 << i
        assert any(bin((a >> 8 * i & 255) ^ (b >> 8 * i & 255)).count("1") <= dc.BLOCK_RADIUS for i in range(8))


def test_rolled_simhashes_are_those_of_each_run(spark):
    r = random.Random(8)
    cases = [([r.getrandbits(64) - 2**63 for _ in range(n)], m) for n, m in ((1, 1), (5, 2), (9, 9), (40, 7), (60, 46), (300, 120))]
    cases.append(([-1] * 6 + [0] * 6, 4))
    frame = spark.createDataFrame([(i, b, m) for i, (b, m) in enumerate(cases)], "i int, b array<long>, m int")
    runs = F.transform(F.sequence(F.lit(1), F.size("b") - F.col("m") + 1), lambda s: dc.simhash(F.slice("b", s, F.col("m"))))
    b, m = F.col("b"), F.col("m")
    for x in frame.select("i", runs.alias("want"), dc.rolled_simhashes(b, m).alias("got"), dc._rolled(b, m, 64, 40).alias("wide")).collect():
        assert x["got"] == x["want"] == x["wide"], x["i"]


def test_simhash(spark):
    r = random.Random(2)
    bags = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 9, 40)] + [[5, 5, -7]]
    for b, (got,) in zip(bags, spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, b array<long>").orderBy("i").select(dc.simhash(F.col("b"))).collect()):
        want = sum(1 << i for i in range(64) if sum(1 if x >> i & 1 else -1 for x in b) > 0)
        assert got % (1 << 64) == want


def test_drop_and_empty(spark, rows):
    docs, items = corpus(4)
    frame, bench = rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")
    found = {r["doc_id"] for r in dc.find_leaks(frame, bench).collect()}
    kept = [r["doc_id"] for r in dc.drop_leaks(frame, bench).collect()]
    assert sorted(kept, key=str) == sorted((d for d, _ in docs if d not in found), key=str)
    assert dc.find_leaks(frame, bench.limit(0)).count() == 0 and dc.find_leaks(frame.limit(0), bench).count() == 0
    assert dc.drop_leaks(frame, bench.limit(0)).count() == len(docs)


def test_without_broadcast(spark, rows, monkeypatch):
    docs, items = corpus(6)
    frame, bench = rows(docs[:60], "doc_id long, text string"), rows(items, "item_id long, text string")
    a = sorted(map(tuple, dc.find_leaks(frame, bench).collect()), key=repr)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, dc.find_leaks(frame, bench).collect()), key=repr) == a


def test_windows_at_every_start(spark, rows):
    r = random.Random(9)
    vocab = [f"t{i}" for i in range(5000)]
    docs, items = [], []
    # ends replaced and words inserted in the middle: the best window lies between the two alignments
    for i, (n, ends, middle) in enumerate([(104, 3, 6), (1004, 36, 72), (300, 8, 20), (505, 18, 30), (200, 0, 10)]):
        w = r.choices(vocab, k=n)
        items.append((i, " ".join(w)))
        new = lambda k: r.choices(["x", "y", "z"], k=k)
        docs.append((i, " ".join(r.choices(vocab, k=50) + new(ends) + w[ends:n // 2] + new(middle) + w[n // 2:n - ends] + new(ends) + r.choices(vocab, k=40))))
    w = words(items[2][1])
    docs.append((10, " ".join(r.choices(vocab, k=30) + w[150:] + new(9) + w[:150] + r.choices(vocab, k=30))))  # halves swapped, a gap between them
    docs.append((11, " ".join(w[20:] + w[:5])))  # shorter than the item
    want = brute(docs, items)
    assert {(0, 0), (1, 1), (10, 2), (11, 2)} <= set(want)
    got = dc.find_leaks(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]): x["similarity"] for x in got}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in found)
    # and the short items of the other tests, from the threshold on
    docs, items = corpus(3)
    found = {(x["doc_id"], x["item_id"]): x["similarity"] for x in dc.find_leaks(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_texts_of_equal_checksum(spark, rows):
    leak, clean = (f"some words before {w} and a few after it" for w in ("plumless", "buckeroo"))
    frame, bench = rows([(None, leak), (None, clean)], "doc_id long, text string"), rows([(1, "before plumless and a few")], "item_id long, text string")
    assert [r["similarity"] for r in dc.find_leaks(frame, bench).collect()] == [1.0]
    assert [r["text"] for r in dc.drop_leaks(frame, bench).collect()] == [clean]
