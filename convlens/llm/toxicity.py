"""Operator 4: toxic passages as maximum-scoring segments of token log-odds.

1. Counts of the labelled texts by class that hold a word, or a stem (the first
   ``STEMS`` bytes of a word), in 2^20 hashed places (so the table has a fixed size whatever
   the vocabulary), become log-odds under a Dirichlet prior proportional to the
   counts of both classes together; places whose log-odds are not ``MIN_Z``
   standard errors from 0 count as 0.  A word scores its own log-odds, or its
   longest stem's where it has none, and pays ``DRIFT``, so that a random text's score falls.
2. A linear scan finds all maximal-scoring segments of a text (the greatest,
   then the greatest left and right of it, and so on).
3. Scores are calibrated by extreme values: ``lambda`` solves
   E[exp(lambda * score)] = 1 over clean text, K is fitted to the greatest
   scores of clean texts, and a segment of score S in a text of n words has
   lambda * S - ln(K * n) nats of surprise (E-value exp(-that)).
4. A text's features are the surprise of its best segment (at least ``FLOOR``,
   which is also that of a text without one) and the summed scores of all of them, times lambda; a logistic curve over them, fitted on
   labelled texts that step 1 has not seen, gives the probability.

Labels are a bounded sample (``max_labelled`` rows, those of least hash); every
text is scored whole.  Null and empty texts have no segment.  Without labels of
both classes there is no evidence: every score is the smoothed share of toxic
labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.llm.common import carried, forget, pieces, table, text_key

PLACES = 1 << 20
#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 50_000
#: Strength of the Dirichlet prior in counts, least standard errors, cost of a word, bytes of stems.
PRIOR_COUNTS, MIN_Z, DRIFT, STEMS = 5_000.0, 3.0, 0.3, (6, 4)
#: Least surprise, in nats, and that of a text without any segment, however short.
FLOOR = -8.0
#: Segments expected in a clean text at most, for a passage to count as significant.
MAX_E_VALUE = 0.1

#: ASCII that does not belong to a word becomes a space.
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def places_of(words: list[bytes]) -> np.ndarray:
    """A row for the words and one for each length of stem."""
    out = np.empty((1 + len(STEMS), len(words)), np.uint32)
    out[0] = np.fromiter(map(crc32, words), np.uint32, len(words))
    for k, n in enumerate(STEMS, 1):
        cut = [w[:n] for w in words]
        places = {w: crc32(b"^" + w) for w in set(cut)}
        out[k] = np.fromiter(map(places.__getitem__, cut), np.uint32, len(words))
    return out & np.uint32(PLACES - 1)


def word_scores(odds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A word's own log-odds or those of its longest stem that has any, less the drift."""
    out = odds[places[-1]]
    for row in places[-2::-1]:
        own = odds[row]
        out = np.where(own != 0, own, out)
    return out - np.float32(DRIFT)


@dataclass
class ToxicityModel:
    odds: np.ndarray  # float32[PLACES]
    lam: float
    log_k: float
    weights: np.ndarray  # of 1, surprise of the best segment, log of the summed scores

    def surprise(self, score: float, n_words: int) -> float:
        return self.lam * score - self.log_k - np.log(max(n_words, 1))

    def features(self, segments: list[tuple[int, int, float]], n_words: int) -> tuple[float, float]:
        return self.features_of(max((s for *_, s in segments), default=0.0), sum(s for *_, s in segments), n_words)

    def features_of(self, best: float, total: float, n_words: int) -> tuple[float, float]:
        """From the best segment's score and the sum of all (0 and 0: no segment)."""
        return max(self.surprise(best, n_words), FLOOR) if best > 0 else FLOOR, float(np.log1p(self.lam * total))

    def probability(self, features: tuple[float, float]) -> float:
        z = float(self.weights @ np.array([1.0, *features]))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one left-to-right
    scan.  Runs of positive scores stand for their positions; each stacked
    segment keeps the total before it (``low``) and at its end (``high``)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    breaks = np.flatnonzero(np.diff(positive) > 1)
    begins = positive[np.concatenate([[0], breaks + 1])]
    ends = positive[np.concatenate([breaks, [len(positive) - 1]])] + 1
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, low, high, nearest earlier one that starts lower (-1: none)
    for b, e in zip(begins.tolist(), ends.tolist()):
        low, high = total[b], total[e]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((b, e, low, high, j))
                break
            b, low = stack[j][0], stack[j][2]  # the two and all between become one, which is tried anew
            del stack[j:]
    return [(b, e, float(h - lo)) for b, e, lo, h, _ in stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    both = toxic + clean
    if not toxic.sum() or not clean.sum():
        return np.zeros(len(both), np.float32)
    prior = PRIOR_COUNTS * (both + 0.01) / (both.sum() + 0.01 * len(both))
    a, b = toxic + prior, clean + prior
    n_a, n_b = a.sum(), b.sum()
    odds = np.log(a / (n_a - a)) - np.log(b / (n_b - b))
    return np.where(np.abs(odds) >= MIN_Z * np.sqrt(1 / a + 1 / b), odds, 0.0).astype(np.float32)


def _solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1, by halving."""
    p = weights / max(weights.sum(), 1.0)
    used = p > 0
    s, p = scores[used].astype(np.float64), p[used]
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * s, 500))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, half) of the labelled documents that may be learnt from.
    A document labelled twice counts as toxic if any label says so; of several
    rows with one id the text of the least key is learnt from."""
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # a row has two numbers and max_labelled bounds the rows, so the broadcast has a proven size
    text = F.col("text").cast("string")
    joined = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.struct(text_key(F.coalesce("text", F.lit(""))).alias("key"), "text")).alias("one"), F.first("toxic").alias("toxic"))
    return one.select(F.col("one.text").alias("text"), "toxic", (F.xxhash64(F.lit(17), "doc_id") % 2 == 0).alias("half"))


def fit(rows: DataFrame) -> ToxicityModel:
    """Fit on the rows of ``training_rows``: log-odds on one half, calibration on the other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums = np.zeros((2, PLACES), np.int64)
        for batch in pieces(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[toxic][np.unique(places_of(words_of(text)))] += 1
        used = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[1][used]), pa.array(sums[0][used])], ["place", "toxic", "clean"])

    counts = rows.where("half").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).mapInArrow(count, "place int, toxic long, clean long")
    got = counts.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()  # PLACES rows at most
    toxic, clean = np.zeros(PLACES), np.zeros(PLACES)
    place = got["place"].to_numpy()
    toxic[place], clean[place] = got["toxic"].to_numpy(), got["clean"].to_numpy()
    odds = log_odds(toxic, clean)
    model = ToxicityModel(odds, _solve_lambda(odds - DRIFT, clean), 0.0, np.zeros(3))

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            places = [places_of(words_of(t)) for t in batch.column(0).to_pylist()]
            found = [[s for *_, s in maximal_segments(word_scores(shared.value.odds, p))] for p in places]
            columns = [p.shape[1] for p in places], [max(x, default=0.0) for x in found], [sum(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns, (pa.int64(), pa.float64(), pa.float64()))], ["toxic", "n", "best", "total"])

    # four numbers for each of at most max_labelled ids
    held = rows.where("not half").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).mapInArrow(segments, "toxic int, n long, best double, total double").toArrow()
    y, n, best, total = (held[c].to_numpy() for c in ("toxic", "n", "best", "total"))
    usual = (y == 0) & (best > 0)
    if usual.any():  # a Gumbel variable's mean is its mode plus Euler's constant over lambda; the median resists mislabelled rows
        model.log_k = float(np.median(model.lam * best[usual] - np.log(n[usual])) + np.log(np.log(2)))
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 10)
        model.weights = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    else:
        x = np.array([[1.0, *model.features_of(*row)] for row in zip(best.tolist(), total.tolist(), n.tolist())])
        model.weights = _logistic(x, y.astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages``: the significant ones
    as word positions, score and E-value.  The text is not carried through Python and back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest, back = carried(docs, "text", "score", "passages")
    rows = docs.select("text", rest.alias("rest"))
    passage = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, "text"):
            scores, passages = [], []
            for text in batch.column(0):
                p = places_of(words_of(text.as_py()))
                n = p.shape[1]
                found = maximal_segments(word_scores(m.odds, p))
                scores.append(m.probability(m.features(found, n)))
                each = [{"begin": b, "end": e, "score": s, "e_value": float(np.exp(-m.surprise(s, n)))} for b, e, s in found]
                passages.append([x for x in each if x["e_value"] <= MAX_E_VALUE])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], ["rest", "score", "passages"])

    found = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))
    schema = T.StructType([rows.schema["rest"], T.StructField("score", T.DoubleType()), T.StructField("passages", found)])
    return rows.mapInArrow(run, schema).select(*back("rest"), "score", "passages")


def drop_toxic(docs: DataFrame, model: ToxicityModel, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest, back = carried(docs, "text")
    rows = docs.select("text", rest.alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        for batch in pieces(batches, "text"):
            keep = []
            for text in batch.column(0):
                p = places_of(words_of(text.as_py()))
                keep.append(m.probability(m.features(maximal_segments(word_scores(m.odds, p)), p.shape[1])) < at)
            yield batch.filter(pa.array(keep, pa.bool_()))

    others = dict(zip([c for c in docs.columns if c != "text"], back("rest")))
    return rows.mapInArrow(run, rows.schema).select(*["text" if c == "text" else others[c] for c in docs.columns])


def held_out() -> Column:
    """Rows of the fold that is never learnt from (a null id belongs to no fold)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels"), ~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
