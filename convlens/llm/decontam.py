"""Operator 1: benchmark passages inside documents, native.

Words are runs of letters and digits, in lower case; an item's shingles have
five words (all of its words if it has fewer), weighted by how often they occur.

1. A document's shingle positions are joined with the items' shingles.  Of the
   windows of an item's size, at whatever word they start, those are made that
   hold as many matching positions as a similarity of ``least`` needs: the
   common weight of a window and an item is at most their number.
2. Windows and items get a 64-bit SimHash of their weighted shingles.  Windows of one
   size that begin near each other are a stretch; its bit counts roll from one start to
   the next (a shingle comes in, one goes out), so a window costs the same whatever its size.  The item
   index holds, for each of 8 blocks of 8 bits, all values within 2 bits of the
   item's: two fingerprints at most ``RADIUS`` = 8 * 3 - 1 bits apart differ by 2 or
   fewer bits in some block, so a join on (size, block, value) finds all of them.
   At similarity 0.8 the distance is 9.7 bits on average with a deviation of 2.9.
3. The candidates within the radius are verified: the sum of the lesser weights
   over the sum of the greater ones must be at least ``least``.

A window's number of words is its item's, or the document's if that is shorter.
Null and empty texts hold nothing; rows with equal id and text are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.common import carried, distinct_count_at_most, store, table, text_key

SHINGLE, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 5, 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows (of a few numbers each) up to which a side may be broadcast.
BROADCAST_ROWS = 500_000
#: Numbers of eight bytes in the arrays of a side that is broadcast.
BROADCAST_NUMBERS = 4_000_000
NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bind(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def shingles(hashed: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes, in order; none if it is shorter."""
    return _bind(hashed, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - F.lit(k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, k)])))


def numbered(bag: Column) -> Column:
    """A bag as a set: each value hashed with the number of its occurrence (-1 for the
    first); places are looked up only in a bag that repeats a value."""
    first = F.lit(-1)
    places = _bind(F.sort_array(bag), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x).cast("int"))))
    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), F.transform(bag, lambda x: F.xxhash64(x, first))).otherwise(places)


def simhash(bag: Column) -> Column:
    def bit(b: Column) -> Column:
        score = F.aggregate(bag, F.lit(0), lambda a, x: a + F.when(F.getbit(x, b) == 1, 1).otherwise(-1))
        return F.when(score > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def rolled_simhashes(bag: Column, m: Column) -> Column:
    """``simhash`` of every run of ``m`` neighbours of ``bag``, in order.

    Bit counts are packed: a long counts bits j, j + 22 and j + 44 in lanes of 22
    bits, which hold windows of fewer than 2^18 shingles; longer ones get a long a bit."""
    return F.when(m < F.lit(1 << 18), _rolled(bag, m, 22, 18)).otherwise(_rolled(bag, m, 64, 40))


def _rolled(bag: Column, m: Column, lane: int, top: int) -> Column:
    """As ``rolled_simhashes``, with lanes of ``lane`` bits for counts below ``2**top``."""
    ones = sum(1 << i for i in range(0, 64, lane))
    tests = ones << top
    js = F.sequence(F.lit(0), F.lit(min(lane, 64) - 1))

    def lanes(x: Column, j: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(ones))

    def fingerprint(counts: Column) -> Column:
        # a lane's test bit is set if its count is more than half of m
        lift = (F.lit((1 << top) - 1) - F.floor(m / 2)) * F.lit(ones)
        bits = F.transform(counts, lambda v, j: F.call_function("shiftleft", F.call_function("shiftrightunsigned", (v + lift).bitwiseAND(F.lit(tests)), F.lit(top)), j))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    def roll(b: Column) -> Column:
        first = F.slice(b, F.lit(1), m)
        counts = F.transform(js, lambda j: F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + lanes(x, j)))
        begin = _bind(counts, lambda c: F.struct(c.alias("counts"), F.array(fingerprint(c)).alias("all")))

        def step(state: Column, i: Column) -> Column:
            moved = F.transform(state["counts"], lambda v, j: v + lanes(b[i + m], j) - lanes(b[i], j))
            return _bind(moved, lambda c: F.struct(c.alias("counts"), F.concat(state["all"], F.array(fingerprint(c))).alias("all")))

        steps = F.when(F.size(b) > m, F.sequence(F.lit(0), F.size(b) - m - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, begin, step, lambda state: state["all"])

    return _bind(bag, roll)


def _block(fingerprint: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (i * BLOCK_BITS).cast("int")).bitwiseAND(F.lit(2**BLOCK_BITS - 1))


def _small(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """``df``, to be broadcast if it has been counted to be small: its rows and,
    if they hold arrays, all the ``numbers`` in them."""
    if numbers is None:
        return F.broadcast(df) if distinct_count_at_most(df, BROADCAST_ROWS) else df
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(numbers), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_NUMBERS else df


def _hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def item_index(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, k, bag, set, fingerprint) of every item that has words;
    ``item`` is its own number once the index is written.  Null ids are items like
    others, an id with several texts is several items, equal rows are one."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", _hashed(F.col("text")).alias("h")).where(F.size("h") > 0)
    items = items.withColumns({"size": F.size("h"), "k": F.least(F.size("h"), F.lit(SHINGLE))})
    of_k = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("h"), k)) for k in range(1, SHINGLE + 1)])
    return items.select("item", "item_id", "size", "k", of_k.alias("bag")).withColumns({"set": numbered(F.col("bag")), "fingerprint": simhash(F.col("bag"))})


def _starts(hits: DataFrame, least: float) -> DataFrame:
    """Windows that hold enough of the matching positions (d, c, n, size, k, at) to
    be as similar to an item as ``least``: (d, c, size, k, width, starts), a row for
    each stretch of ``width`` starts that has any."""
    held = hits.groupBy("d", "c", "n", "size", "k").agg(F.collect_list("at").alias("ats"))
    held = held.withColumn("width", F.least("size", "n"))
    # common / (window + item - common) >= least, with weights of width - k + 1 and size - k + 1
    need = F.ceil((F.col("width") + F.col("size") - 2 * F.col("k") + 2) * F.lit(least / (1 + least)) - F.lit(1e-6))
    held = held.withColumn("need", F.greatest(need, F.lit(1)).cast("int")).where(F.size("ats") >= F.col("need"))

    def spans(p: Column) -> Column:
        # starts from which the i-th position and the need - 1 after it are seen, without those of the position before
        return F.transform(F.slice(p, F.lit(1), F.size(p) - F.col("need") + 1), lambda x, i: F.struct(
            F.greatest(p[i + F.col("need") - 1] - F.col("width") + F.col("k"), F.when(i > 0, p[i - 1] + 1), F.lit(0)).alias("begin"), F.least(x, F.col("n") - F.col("width")).alias("end")))

    each = held.select("d", "c", "size", "k", "width", F.explode(F.filter(_bind(F.sort_array("ats"), spans), lambda r: r["begin"] <= r["end"])).alias("r"))
    each = each.select("d", "c", "size", "k", "width", F.explode(F.sequence("r.begin", "r.end")).alias("start"))
    stretch = F.floor(F.col("start") / F.col("width")).alias("stretch")
    return each.groupBy("d", "c", "size", "k", "width", stretch).agg(F.sort_array(F.collect_list("start")).alias("starts")).drop("stretch")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(d, c, doc_id, item_id, start_word, n_words, distance, similarity): the
    best window of each document and item whose similarity is at least ``least``.
    (d, c) is the document's key (see ``keyed``)."""
    items = store(item_index(benchmark), "items")
    ks = [r["k"] for r in items.select("k").distinct().collect()]  # five numbers at most
    rows = keyed(docs).select("d", "c", "text")
    windows = None
    for k in ks:
        anchors = _small(store(items.where(F.col("k") == k).select("size", F.explode("bag").alias("h")).distinct(), "anchors"))
        places = rows.select("d", "c", _hashed(F.col("text")).alias("words")).select("d", "c", F.size("words").alias("n"), shingles(F.col("words"), k).alias("s"))
        places = places.select("d", "c", "n", F.posexplode("s").alias("at", "h"))
        hits = places.join(anchors, "h").select("d", "c", "n", "size", F.lit(k).alias("k"), "at").distinct()
        found = _starts(hits, least)
        windows = found if windows is None else windows.unionByName(found)
    if windows is None:
        windows = rows.limit(0).select("d", "c", *[F.lit(0).alias(x) for x in ("size", "k", "width")], F.array(F.lit(0)).alias("starts"))
    windows = store(windows, "leak_windows")
    few = distinct_count_at_most(windows, BROADCAST_ROWS)
    by_doc = windows.groupBy("d", "c").agg(F.collect_list(F.struct("size", "k", "width", "starts")).alias("windows"))
    texts = rows.join(F.broadcast(by_doc) if few else by_doc, ["d", "c"]).dropDuplicates(["d", "c"])

    def cut(w: Column, words: Column) -> Column:
        first, last = w["starts"][0], F.element_at(w["starts"], -1)
        return F.struct(w["size"].alias("size"), w["k"].alias("k"), w["width"].alias("width"), w["starts"].alias("starts"), F.slice(words, first + 1, last - first + w["width"]).alias("words"))

    each = texts.select("d", "c", F.explode(_bind(_hashed(F.col("text")), lambda words: F.transform("windows", lambda w: cut(w, words)))).alias("w")).select("d", "c", "w.*")
    bag = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("words"), k)) for k in range(1, SHINGLE + 1)])
    weight = F.col("width") - F.col("k") + 1
    stretches = each.select("d", "c", "size", "k", "width", F.col("starts")[0].alias("first"), "starts", bag.alias("bag"))
    stretches = store(stretches.withColumn("fingerprints", rolled_simhashes(F.col("bag"), weight)), "leak_fingerprints")
    at = _bind(F.col("fingerprints"), lambda f: F.transform("starts", lambda s: F.struct(s.alias("start"), f[s - F.col("first")].alias("fingerprint"))))
    fingerprints = stretches.select("d", "c", "size", "first", F.explode(at).alias("w")).select("d", "c", "size", "first", "w.*")
    # multi-index: windows look their blocks up among all values near the items'
    values = F.sequence(F.lit(0), F.lit(2**BLOCK_BITS - 1))
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    item_keys = items.select("item", "size", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks).alias("block"))
    item_keys = item_keys.withColumn("value", F.explode(F.filter(values, lambda v: F.bit_count(v.cast("long").bitwiseXOR(_block(F.col("item_fingerprint"), F.col("block")))) <= BLOCK_RADIUS)))
    index = item_keys.select("item", "size", "item_fingerprint", "block", F.col("value").cast("long").alias("value"))
    asked = fingerprints.select("d", "c", "start", "first", "size", "fingerprint", F.explode(blocks).alias("block")).withColumn("value", _block(F.col("fingerprint"), F.col("block")))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = asked.join(_small(index), ["size", "block", "value"]).where(distance <= RADIUS)
    near = near.select("d", "c", "start", "first", "size", "item", distance.alias("distance")).distinct()
    pairs = near.join(_small(items.select("item", "set"), F.size("set")), "item").join(stretches.select("d", "c", "first", "size", "k", "width", "bag"), ["d", "c", "first", "size"])
    common = F.size(F.array_intersect(numbered(F.slice("bag", F.col("start") - F.col("first") + 1, weight)), F.col("set")))
    scored = pairs.select("d", "c", "item", "start", F.col("width").alias("n_words"), "distance", _bind(common, lambda m: m / (weight + F.size("set") - m)).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("d", "c", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", "distance")).alias("b"))
    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return best.join(_small(items.select("item", "item_id")), "item").select("d", "c", doc_id, "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def keyed(docs: DataFrame) -> DataFrame:
    """(d, c, text): a document's key is its id (null ids have one that no id has) and ``text_key`` of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_key(text).alias("c"), text.alias("text"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    leaks = _small(store(find_leaks(docs, benchmark, least).select("d", "c").distinct(), "leaks"))
    packed, back = carried(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_key(text).alias("c"), packed.alias("row"))
    return rows.join(leaks, ["d", "c"], "left_anti").select(*back("row"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` against all of ``benchmark``: a row per document and item found in it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("d", "c")
