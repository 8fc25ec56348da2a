"""Operator 13: ranked lexical search, skipping by joint maxima of term pairs.

A document's score for an item is the sum of the impacts of the item's distinct
terms, all in 64-bit integers (``impacts``).  The whole stated set of items is
ranked against every document, in blocks of items of bounded size.  For a block:

1. A pass over all texts counts N, L and the documents that hold each term of the
   block (map-side sums; a number for each term of the block comes to the driver).
2. A second pass writes the index.  Documents are dealt into shards of bounded
   size; a shard holds its terms' postings (document, impact), each term's
   greatest impact and, for the term pairs that stand next to each other in some
   item's order of weights, the greatest joint impact over the documents in
   the intersection of their lists.
3. Each shard is searched from its heaviest terms on.  What the terms from i on can add to
   a document is at most

       bound[i] = min(bound[i + 1] + most[i], bound[i + 2] + pair[i, i + 1])

   where ``pair`` is the greatest of the joint maximum and of either term alone; the minimum
   picks the best way of pairing.  Once the bound is under the score of the k-th
   best document so far, no document that is yet unseen can come in: from then on
   terms are only looked up for the documents whose score and bound still reach it.
4. A task hands on the k best of its shards for each item, and a window limited
   to k rows before its shuffle merges them.

Nothing is approximate: a document is passed over only if its bound is strictly
under the k-th score.  Null texts have no terms.  Rows of items are ranked each for itself, even
if their ids are null or repeated, and so are repeated documents; null document
ids come before others.  Without documents or terms there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlens.llm.common import forget, pieces, store, table

#: Bytes of item texts that are searched for at once, and documents and postings of a shard.
BLOCK_BYTES, SHARD_DOCS, SHARD_POSTINGS = 8_000_000, 8_192, 2_000_000
NO_ID = -(2**63)

#: Bytes of terms, upper case made lower; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def lengths_to_m(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * N) div L, in Python's integers as the product may pass 64 bits."""
    values, at = np.unique(n, return_inverse=True)
    return np.array([10 + 90 * int(x) * docs // total for x in values], np.int64)[at]


class Items:
    """A block of items: its terms, numbered, and each item's terms by falling weight."""

    def __init__(self, rows: list[tuple[int, int | None, str | None]]):
        self.row, self.item_id = [r for r, _, _ in rows], [i for _, i, _ in rows]
        sets = [sorted(set(terms_of(t))) for _, _, t in rows]
        self.number = {t: k for k, t in enumerate(sorted({t for s in sets for t in s}))}
        self.terms = [[self.number[t] for t in s] for s in sets]

    def weigh(self, df: np.ndarray, docs: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.order = [np.array(sorted((t for t in ts if df[t]), key=lambda t: (-self.weight[t], t)), np.int64) for ts in self.terms]
        pairs = sorted({(int(a), int(b)) for o in self.order for a, b in zip(o, o[1:])})
        self.pair = {p: k for k, p in enumerate(pairs)}
        #: For each item the number of the pair that each of its terms but the last forms with the next one.
        self.pairs_of = [np.array([self.pair[int(a), int(b)] for a, b in zip(o, o[1:])], np.int64) for o in self.order]


def _postings(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece: doc ids, numbers of terms, and (term, document in the piece, tf) sorted."""
    for batch in pieces(batches, "text"):
        n, found = [], []
        for text in batch.column(1):
            words = terms_of(text.as_py())
            n.append(len(words))
            found.append(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)))
        flat = np.concatenate(found)
        key = (flat << 32) | np.repeat(np.arange(len(n)), n)
        key, tf = np.unique(key[flat >= 0], return_counts=True)
        yield batch.column(0).fill_null(NO_ID).to_numpy(), np.array(n, np.int64), key >> 32, key & 0xFFFFFFFF, tf.astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def corpus_statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents that hold each term of the block."""
    spread = docs.sparkSession.sparkContext.broadcast(items.number)  # of a block, so at most BLOCK_BYTES of terms
    v = len(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(v + 2, np.int64)
        for _, n, term, _, _ in _postings(batches, spread.value):
            total[:v] += np.bincount(term, minlength=v)
            total[v:] += int((n > 0).sum()), int(n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(v + 2, np.int64)
    for r in _texts(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[v]), int(out[v + 1]), out[:v]


def joint_maxima(pairs: list[tuple[int, int]], start: np.ndarray, doc: np.ndarray, impact: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair the most that its two terms add to one document of the shard."""
    out = np.zeros(len(pairs), np.int64)
    for k, (a, b) in enumerate(pairs):
        if start[a + 1] - start[a] > start[b + 1] - start[b]:
            a, b = b, a
        out[k] = max(most[a], most[b])
        short, long = slice(start[a], start[a + 1]), slice(start[b], start[b + 1])
        if short.stop > short.start:
            at = np.minimum(np.searchsorted(doc[long], doc[short]), long.stop - long.start - 1)
            both = doc[long][at] == doc[short]
            if both.any():
                out[k] = max(out[k], (impact[short][both] + impact[long][at[both]]).max())
    return out


INDEX = [("doc_ids", np.int64), ("start", np.int64), ("doc", np.int32), ("impact", np.int64), ("most", np.int64), ("joint", np.int64)]


def build_index(docs: DataFrame, items: Items, n_docs: int, total: int) -> DataFrame:
    """A row per shard, its arrays as bytes: document ids, where each term's
    postings start, postings, and the maxima of terms and pairs."""
    spread = docs.sparkSession.sparkContext.broadcast((items.number, items.weight, list(items.pair)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, weight, pairs = spread.value
        held, rows, size = [], 0, 0
        for part in _postings(batches, number):
            held.append(part)
            rows, size = rows + len(part[0]), size + len(part[2])
            if rows >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield shard(held, weight, pairs)
                held, rows, size = [], 0, 0
        if held:
            yield shard(held, weight, pairs)

    def shard(held: list, weight: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        ids, n, term, doc, tf = (np.concatenate(x) for x in zip(*held))
        doc = doc + np.repeat(np.cumsum([0, *(len(h[0]) for h in held[:-1])]), [len(h[2]) for h in held])
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        impact = impacts(weight[term], tf, lengths_to_m(n, n_docs, total)[doc])
        start = np.searchsorted(term, np.arange(len(weight) + 1))
        most = np.zeros(len(weight), np.int64)
        there = np.flatnonzero(np.diff(start))
        if len(there):
            most[there] = np.maximum.reduceat(impact, start[there])
        doc = doc.astype(np.int32)
        arrays = (ids, start, doc, impact, most, joint_maxima(pairs, start, doc, impact, most))
        return pa.RecordBatch.from_arrays([pa.array([a.astype(t).tobytes()], pa.binary()) for a, (_, t) in zip(arrays, INDEX)], [c for c, _ in INDEX])

    return store(_texts(docs).mapInArrow(run, ", ".join(f"{c} binary" for c, _ in INDEX)), "lexical_index")


def bounds(most: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What the terms from i on add at most, for each i and after the last."""
    n = len(most)
    out = [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = out[i + 1] + int(most[i])
        if i + 1 < n:
            out[i] = min(out[i], out[i + 2] + int(joint[i]))
    return np.array(out[:n + 1], np.int64)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_shard(shard: dict[str, np.ndarray], order: np.ndarray, pairs: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, document numbers) of the shard that may be among the k best; all
    that reach ``least``, the k-th best score so far, and are above 0."""
    start, doc, impact = shard["start"], shard["doc"], shard["impact"]
    bound = bounds(shard["most"][order], shard["joint"][pairs])
    score = np.zeros(len(shard["doc_ids"]), np.int64)
    candidates = None
    for i, t in enumerate(order):
        a, b = start[t], start[t + 1]
        if candidates is None:
            if bound[i] < score.max(initial=0):
                least = max(least, _kth(score, k))
            if bound[i] < least:  # no document that is unseen so far can reach it
                candidates = np.flatnonzero(score + bound[i] >= least)
        if candidates is None:
            score[doc[a:b]] += impact[a:b]
        elif b > a:
            candidates = candidates[score[candidates] + bound[i] >= least]
            at = np.minimum(np.searchsorted(doc[a:b], candidates), b - a - 1)
            hit = doc[a:b][at] == candidates
            score[candidates[hit]] += impact[a:b][at[hit]]
            least = max(least, _kth(score[candidates], k))
    if candidates is None:
        candidates = np.flatnonzero(score)
    least = max(least, _kth(score[candidates], k), 1)
    candidates = candidates[score[candidates] >= least]
    return score[candidates], candidates


def search_index(index: DataFrame, items: Items, k: int) -> DataFrame:
    """(row, item_id, doc_id, score): the k best of each task's shards for each item."""
    spread = index.sparkSession.sparkContext.broadcast((items.row, items.item_id, items.order, items.pairs_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, item_ids, orders, pairs_of = spread.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = {c: np.frombuffer(batch.column(i)[r].as_buffer(), t) for i, (c, t) in enumerate(INDEX)}
                for q, (order, pairs) in enumerate(zip(orders, pairs_of)):
                    old, old_ids = best[q]
                    scores, at = search_shard(shard, order, pairs, k, int(old[-1]) if len(old) == k else 0)
                    if len(at):
                        scores, ids = np.concatenate([old, scores]), np.concatenate([old_ids, shard["doc_ids"][at]])
                        first = np.lexsort((ids, -scores))[:k]
                        best[q] = scores[first], ids[first]
        n = [len(s) for s, _ in best]
        if sum(n):
            ids = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(rows, np.int64), n)), pa.array([item_ids[q] for q, c in enumerate(n) for _ in range(c)], pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in best])),
            ], ["row", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "row long, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    numbered = store(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "lexical_items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out, blocks = None, max(1, -(-size // block_bytes))
    for block in range(blocks):
        mine = numbered.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        items = Items([(r["row"], r["item_id"], r["text"]) for r in mine.select("row", "item_id", "text").collect()])  # BLOCK_BYTES of texts
        if not items.number:
            continue
        n_docs, total, df = corpus_statistics(docs, items)
        if not df.any():
            continue
        items.weigh(df, n_docs)
        found = search_index(build_index(docs, items, n_docs, total), items, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the ten best of all ``documents`` for each row of ``benchmark``."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT item_id, -row_number() OVER (), text FROM benchmark),
words AS (SELECT id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts WHERE text IS NOT NULL),
postings AS (SELECT id, r, w, count(*) AS tf FROM words WHERE r > 0 GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM postings GROUP BY r),
totals AS (SELECT count(*) AS all_n, sum(n)::BIGINT AS all_l FROM lengths),
terms AS (SELECT w, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, totals GROUP BY w, all_n),
asked AS (SELECT DISTINCT id AS item_id, r AS item, w FROM words WHERE r < 0),
scores AS (
  SELECT item_id, item, p.id AS doc_id, p.r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_n) // all_l))))::BIGINT AS score
  FROM asked JOIN postings p USING (w) JOIN terms USING (w) JOIN lengths l ON l.r = p.r, totals GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
