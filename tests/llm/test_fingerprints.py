import hashlib
import random
import re

from pyspark.sql import functions as F

from convlens.llm import fingerprints as fp


def shingles(t):
    w = re.findall(r"\S+", (t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices([f"w{i}" for i in range(50)], k=r.choice([0, 1, 3, 5, 9, 40, 90]))) for _ in range(n)]


def test_contract(spark, rows):
    data = [(i * 3, t) for i, t in enumerate(texts(1, 80))] + [(7, "É ☃ x"), (8, None), (10, ""), (6, "repeated"), (6, "repeated"), (None, "null id"), (5, "a b c d e f"), (5, "other text one two")]
    got = [r.asDict() for r in fp.edited_fingerprints(rows([(*d, "c", 1) for d in data], "doc_id long, text string, d string, h int")).collect()]
    assert len(got) == len(data)
    order = sorted({(d is not None, d or 0, t or "") for d, t in data}, reverse=True)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    for k, (known, d, t) in enumerate(order):
        if d in (5, 6, 3) or order[(k + 1) % len(order)][1] == 5:
            continue  # an id with two texts: their order is that of hashes
        m = len(t) // 3
        nxt = order[(k + 1) % len(order)][2]
        edited = t[:len(t) - m] + nxt[:m]
        r = by[d if known else None, len(t)][0]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), (d, t)
        # sketches of at most K shingles are exact
        assert r["near_edited"] == jaccard(shingles(t), shingles(edited)) and r["near_next"] == jaccard(shingles(t), shingles(nxt))
        assert len(r["fingerprint"]) == 8 * len(shingles(t)) and (r["fingerprint"] == r["edited_fingerprint"]) == (shingles(t) == shingles(edited))
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 6 and r["n_chars"] == 8}) == 1


def test_one_and_no_document(spark, rows):
    frame = rows([(1, "one two three four five six")], "doc_id long, text string")
    (r,) = fp.edited_fingerprints(frame).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"one two three four" + b"one two t").hexdigest()
    assert fp.edited_fingerprints(frame.limit(0)).count() == 0


def test_estimates_and_merging(spark):
    r = random.Random(4)
    words = [f"v{i}" for i in range(30000)]
    a, b = words[:9000], words[3000:12000]
    frame = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(words[3000:9000]))], "a string, b string, c string")
    sk = frame.select(*[fp.sketch(F.col(c), 512).alias(c) for c in "abc"])
    got = sk.select(fp.resemblance(F.col("a"), F.col("b"), 512), fp.containment(F.col("c"), F.col("a"), 512), fp.distinct_shingles(F.col("a"), 512), (fp.parse_fingerprint(fp.fingerprint(F.col("a"))) == F.col("a"))).first()
    assert abs(got[0] - 0.5) < 0.08 and abs(got[1] - 1) < 0.15 and abs(got[2] / 8996 - 1) < 0.15 and got[3]
    parts = spark.createDataFrame([(g, " ".join(r.choices(words, k=60))) for g in (1, 1, 1, 2) for _ in range(40)], "g int, t string").select("g", fp.sketch(F.col("t")).alias("sketch"))
    merged = {x["g"]: x["sketch"] for x in fp.merge_all(parts, ["g"]).collect()}
    for g in (1, 2):
        every = sorted({h for x in parts.where(F.col("g") == g).collect() for h in x["sketch"]})
        assert merged[g] == every[:fp.K]
