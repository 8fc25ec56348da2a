"""Operator 7: document fingerprints as bottom-k sketches, native.

A text's words (lower case, split at white space) form shingles of five, or one
of all words if there are fewer.  Each shingle hashes to 32 bits; the sketch is
the sorted array of the K least distinct hashes, as 8 hex digits each, and the
fingerprint is their concatenation.  Sketches of parts merge into the sketch of
the union, and two sketches estimate resemblance, containment and the
number of distinct shingles (exactly so while there are at most K).

Everything is an array expression within the row; no shingle is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlens.llm.common import store, table

K, SHINGLE = 128, 5
#: Stands for a null id while documents are ordered; not an id itself.
NO_ID = -(2**63)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<string>; empty for null, empty and blank texts."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    # each word is hashed once; an array in an array binds it to a name
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        last = F.greatest(n - F.lit(shingle), F.lit(0))
        several = F.transform(F.slice(h, F.lit(1), last + 1), lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, shingle)]))
        one = F.array(F.xxhash64(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
        none = F.array().cast("array<bigint>")
        each = F.when(n >= shingle, several).when(n > 0, one).otherwise(none)
        least = F.slice(F.sort_array(F.array_distinct(F.transform(each, lambda x: F.shiftrightunsigned(x, 32)))), 1, k)
        return F.transform(least, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))

    return F.transform(F.array(hashed), of)[0]


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group of ``keys``.  Hashes are counted once before they are
    gathered, and gathered in two levels: a hot group's first level is spread
    over ``salts`` tasks by hash value, each of which passes on k hashes at most."""
    each = parts.select(*keys, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    rank = Window.partitionBy(*keys, "salt").orderBy("h")
    best = each.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    return best.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def distinct_shingles(a: Column, k: int = K) -> Column:
    kth = F.conv(F.element_at(a, -1), 16, 10).cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**32) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""

    def of(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1))) / F.size(u))

    return F.transform(F.array(merge(a, b, k)), of)[0]


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty ``a``."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    return F.array_join(a, "")


def parse_fingerprint(s: Column) -> Column:
    n = F.length(s).cast("int") / 8
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(s, i * 8 + 1, F.lit(8))))


def rows_before(ids: DataFrame, order: list[str]) -> DataFrame:
    """``ids`` (no rows repeated) with ``before``: the row before it in descending
    ``order`` (a struct of all columns); the first row has the last one.  Rows are
    dealt out by ranges, and only the last of each range meet in one task."""
    down = [F.col(c).desc() for c in order]
    ranged = store(ids.repartitionByRange(*down).withColumn("_range", F.spark_partition_id()), "ranges")
    row = F.struct(*order, *[c for c in ids.columns if c not in order])
    inside = ranged.withColumn("before", F.lag(row).over(Window.partitionBy("_range").orderBy(*down)))
    lasts = ranged.groupBy("_range").agg(F.min(row).alias("last"))
    prior = lasts.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("prior"))
    # a row per range, and one row
    joined = inside.join(F.broadcast(prior), "_range").crossJoin(F.broadcast(lasts.agg(F.min("last").alias("least"))))
    return joined.select(*ids.columns, F.coalesce("before", "prior", "least").alias("before"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs`` (doc_id, text).  The next
    document is the next distinct (doc_id, text) in descending order of id, null ids
    last, so repeated rows have the same next one; a single document follows itself.

    Texts move once, by their own key; each then sends the one before it what
    that one takes of it, its first code points and its sketch."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"), "text")
    order = store(rows_before(rows.select("d", "h", F.length("text").alias("n")).distinct(), ["d", "h"]).select("d", "h", "before"), "order")
    # both uses of the texts by (d, h) read one exchange; the join leaves them sorted for the grouping of repeated rows
    sent = rows.join(order.hint("merge"), ["d", "h"]).groupBy("d", "h").agg(F.first("text").alias("text"), F.first("before").alias("before"))
    sent = sent.select(F.col("before.d").alias("d"), F.col("before.h").alias("h"), F.expr("left(text, before.n div 3)").alias("head"), sketch(F.col("text")).alias("of_next"))
    taken = rows.join(sent.hint("merge"), ["d", "h"])
    n = F.length("text")
    edited = taken.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), n.alias("n_chars"), "text", F.expr("concat(left(text, length(text) - length(text) div 3), head)").alias("edited"), "of_next")
    both = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"), "of_next")
    return both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("of_next")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of ``documents``."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
