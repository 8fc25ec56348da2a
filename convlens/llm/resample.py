"""Operator 11: documents drawn by importance towards a target distribution.

1. Texts become words (ASCII lower case; digits, letters and all non-ASCII
   characters), words become features (runs of one to ``longest`` words) and
   features become ``BUCKETS`` hash buckets.  The counts of all documents and of
   the whole target give each bucket a gain, and the gains are one small array:
   a document's weight is an array lookup for each feature and a floored mean.
2. A Gumbel number that depends on the document's id alone is added, so drawing
   the k greatest scores is drawing k documents without replacement by weight.
3. The cutoff is selected, not sorted for.  Keys (score, doc_id, tie, row) are
   written once.  In a round each task counts its remaining keys on either side
   of a pivot and finds the median of both sides; the next pivot is the median of
   the medians of the side that holds the cutoff, weighted by how many keys
   remain in each task.  A quarter of the remaining keys, at least, is on either
   side of such a pivot, so every round discards that much, and the keys are
   written anew when few of them are left.  The driver sees two numbers and two
   keys for each task.
4. Only the drawn documents are sorted (by ranges), for their ranks.

Null texts have no features and weight 0.  A null id counts as the empty string
for the Gumbel number and comes before other ids; equal ids with equal scores are
drawn by the hash of their text, equal rows in any order.  Documents with fewer than ``least_words``
words are never drawn.  An empty target or corpus gives gains from the smoothing alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.ordered import position_in_group
from convlens.llm.common import forget, pieces, store, table

BUCKETS = 10_000
#: Words whose buckets a worker keeps while it reads a partition.
KNOWN_WORDS = 400_000
#: The remaining keys are written anew when they are fewer than this share of those last written.
SHRINK = 8
#: So few remaining keys (of four numbers) end the rounds: the driver takes them and picks the cutoff.
FEW_KEYS = 1_000

#: Bytes of words, upper case made lower; all others become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Buckets(dict):
    """Bucket of a feature, worked out once while the worker keeps it."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[feature] = k = zlib.crc32(feature) % BUCKETS
        return k


def feature_buckets(words: list[bytes], longest: int, known: Buckets) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words, repeats included."""
    runs = [words]
    for n in range(2, min(longest, len(words)) + 1):
        runs.append([b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)])
    return np.fromiter((known[f] for run in runs for f in run), np.int64, sum(map(len, runs)))


def bucket_counts(texts: DataFrame, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: one row of counts a
    task and bucket, summed by Spark; at most ``BUCKETS`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, total = Buckets(), np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, "text"):
            for text in batch.column(0):
                total += np.bincount(feature_buckets(words_of(text.as_py()), longest, known), minlength=BUCKETS) if text.is_valid else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a feature of the bucket is in the target)."""
    all_s, all_t = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = Buckets()
        for batch in pieces(batches, "text"):
            ids, n_words, n, weight, score = batch.column(0).to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column(2)):
                words = words_of(text.as_py())
                at = feature_buckets(words, longest, known)
                w = int(gains[at].sum()) // len(at) if len(at) else 0
                n_words.append(len(words)), n.append(len(at)), weight.append(w), score.append(w + gumbel(doc_id, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))], names)

    names = ["doc_id", "tie", "n_words", "n_features", "weight", "score"]
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


Key = tuple[int, int, int, int]  # ascending: minus score, doc_id (null: the least number), tie, row
KEY = ["k0", "k1", "k2", "k3"]


def _before(a: list[np.ndarray], b: Key) -> np.ndarray:
    """Which of the keys (columns) come strictly before ``b``."""
    less, same = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for col, x in zip(a, b):
        less |= same & (col < x)
        same &= col == x
    return less


def _median(keys: list[np.ndarray]) -> Key | None:
    n = len(keys[0])
    if not n:
        return None
    at = np.lexsort(keys[::-1])[(n - 1) // 2]
    return tuple(int(c[at]) for c in keys)


def _halves(keys: DataFrame, pivot: Key | None) -> list[tuple[int, Key | None, int, Key | None]]:
    """Of each task's keys: how many come up to ``pivot`` and their median, how
    many come after it and theirs.  Without pivot all count as coming after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        cols = [np.concatenate(c) for c in zip(*got)]  # 32 bytes a key of one scan task
        upto = np.zeros(len(cols[0]), bool) if pivot is None else _before(cols, (*pivot[:3], pivot[3] + 1))
        row = {}
        for side, mask in (("a", upto), ("b", ~upto)):
            m = _median([c[mask] for c in cols])
            row |= {f"{side}n": int(mask.sum()), **{f"{side}{i}": None if m is None else m[i] for i in range(4)}}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int64()) for n in names]))

    names = [f"{s}{x}" for s in "ab" for x in "n0123"]
    rows = keys.select(*KEY).mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()  # a row of ten numbers for each task
    return [(r["an"], (r["a0"], r["a1"], r["a2"], r["a3"]), r["bn"], (r["b0"], r["b1"], r["b2"], r["b3"])) for r in rows]


def _weighted_median(medians: list[tuple[int, Key]]) -> Key:
    left = sum(n for n, _ in medians)
    seen = 0
    for n, key in sorted(((n, k) for n, k in medians if n), key=lambda x: x[1]):
        seen += n
        if 2 * seen >= left:
            return key
    raise ValueError("no key remains")


def _within(low: Key | None, high: Key | None):
    """Keys after ``low`` and up to ``high``."""
    def after(b: Key, or_equal: bool):
        out = F.lit(or_equal)
        for name, x in reversed(list(zip(KEY, b))):
            out = (F.col(name) > x) | ((F.col(name) == x) & out)
        return out

    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col("k0") >= low[0]) & after(low, False)  # the plain bound reaches the scan
    if high is not None:
        keep = keep & (F.col("k0") <= high[0]) & ~after(high, False)
    return keep


def cutoff(keys: DataFrame, k: int, few: int = FEW_KEYS) -> Key | None:
    """The k-th least of the unique keys ``KEY`` of a written table (1 <= k <= its rows; else None)."""
    low = high = pivot = None
    stored = remaining = keys
    written, skipped = 0, 0  # keys at or before ``low`` are ``skipped`` in number
    if k < 1:
        return None
    while True:
        sides = _halves(remaining, pivot)
        upto, after = sum(s[0] for s in sides), sum(s[2] for s in sides)
        if pivot is None and k > after:
            return None
        if pivot is not None and skipped + upto >= k:
            high, left = pivot, upto
            medians = [(s[0], s[1]) for s in sides]
        else:
            low, left, skipped = pivot, after, skipped + upto
            medians = [(s[2], s[3]) for s in sides]
        remaining = stored.where(_within(low, high))
        if left <= max(1, few):
            return sorted(tuple(r) for r in remaining.select(*KEY).collect())[k - skipped - 1]
        pivot = _weighted_median(medians)  # with two or more unique keys left it is not the greatest
        written = written or left
        if left * SHRINK <= written:
            stored, written = store(remaining, "resample_keys"), left
            remaining = stored


def draw(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: of the
    N with ``least_words`` words the floor(percent * N / 100) with the highest
    scores have a rank from 1, the others none."""
    gains = bucket_gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    scored = score_documents(docs, gains, longest, seed).withColumn("row", F.monotonically_increasing_id())
    scored = store(scored, "resample_scores")
    none = F.coalesce("doc_id", F.lit(-(2**63)))
    able = scored.where(F.col("n_words") >= least_words).select(
        (-F.col("score")).alias("k0"), none.alias("k1"), F.coalesce("tie", F.lit(0)).alias("k2"), F.col("row").alias("k3"))
    n = able.count()
    last = cutoff(store(able, "resample_keys"), percent * n // 100)
    keyed = scored.withColumns({"k0": -F.col("score"), "k1": none, "k2": F.coalesce("tie", F.lit(0)), "k3": F.col("row")})
    won = (F.col("n_words") >= least_words) & _within(None, last) if last else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    winners = position_in_group(keyed.where(won).select(*columns, *KEY), [], KEY, "rank").select(*columns, (F.col("rank") + 1).cast("long").alias("rank"))
    return keyed.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(winners)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a tenth of ``documents``, drawn towards the words of ``benchmark``."""
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: it is folded over the bytes of each distinct word with the table of the polynomial 0xEDB88320.
OP11_SQL = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', item_id, -row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts WHERE text IS NOT NULL),
counted AS (SELECT side, r, w, count(*) AS n FROM words GROUP BY ALL),
spelled AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, i * 2 + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM spelled, crc_table),
placed AS (SELECT side, r, bucket, n FROM counted JOIN hashed USING (w)),
filled AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM filled),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM filled, totals),
weights AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS all_n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * all_n // 100 THEN k END AS rank FROM ranked
"""
