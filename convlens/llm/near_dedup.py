"""Operator 2: near-duplicate documents by HyperMinHash and exact verification.

1. Each document becomes the set of its distinct shingles, a 128-bit key of that
   set and its HyperMinHash registers.  Documents with equal sets are one node
   from here on (grouped with map-side minima, so copies cost nothing).
2. The compressed registers are banded.  Within a bucket of nodes, those whose
   collision-corrected estimate is at least ``least - SLACK`` (and whose sizes
   allow it) are joined into a forest: at most a row per member leaves a task,
   never all pairs.  Large buckets are dealt out as pairs of blocks.
3. The forests' components are the families.  A family's nodes meet, with their
   full sets, in one task, or in a task for each pair of blocks if the family is
   large; there every pair of sufficient estimate that is not yet connected is
   verified on the full sets, and the verified links' forest leaves the task.
4. Components of verified links are the classes.

A family is a superset of every class, so no verified link is lost between
blocks.  A link is missed only if its two sketches miss each other in all bands
(about 5e-6 at the threshold) or underestimate by more than SLACK (at the threshold
156 or fewer of 240 registers agree: about 4e-8).  Null ids belong to no class; empty sets link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm import hyperminhash as hm
from convlens.llm.common import carried, distinct_count_at_most, forget, pieces, store, table, text_key
from convlens.llm.components import connected_components

#: How far below the threshold an estimate may lie and still be verified.
SLACK = 0.15
#: Members of a block of a bucket, and members and bytes of sets of a block of a family.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_BYTES = 2_000, 1_500, 16_000_000
#: Nodes whose keys may be broadcast (six numbers each) to fetch their texts again.
BROADCAST_ROWS = 500_000
#: Distinct words whose hashes a worker keeps while it reads a batch.
KNOWN_WORDS = 150_000


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, checksum, n_shingles, k1, k2, regs) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, int] = {}
        for batch in pieces(batches, "text"):
            if len(known) > KNOWN_WORDS:
                known.clear()
            n, k1, k2, regs = [], [], [], []
            for text in batch.column(1):
                s = hm.shingle_set(words_of(text.as_py()), shingle, known)
                a, b = hm.set_key(s)
                n.append(len(s)), k1.append(a), k2.append(b)
                regs.append(hm.registers(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "checksum", "n_shingles", "k1", "k2", "regs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), checksum().alias("checksum")).mapInArrow(run, "doc_id long, checksum binary, n_shingles long, k1 long, k2 long, regs binary")


def checksum() -> Column:
    return text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hm.band_keys(np.frombuffer(x.as_buffer(), np.uint16)) for x in batch.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), hm.BANDS))], ["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows that are sorted by their first ``n_keys`` columns, a group at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:n_keys] != held[0][:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _blocks(members: Column, node: Column, salt: int) -> Column:
    """The pairs of blocks, as i * blocks + j with i <= j, in which a node takes part."""
    own = F.pmod(F.xxhash64(F.lit(salt), node), members)
    return F.transform(F.sequence(F.lit(0).cast("long"), members - 1), lambda j: F.least(own, j) * members + F.greatest(own, j))


def _forest(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Groups of (key, block, node, n, registers of 8 bits) to edges: each node joins the first reached one that resembles it."""
    chance = 1 / 256
    us: list[int] = []
    vs: list[int] = []
    for group in _groups(batches, 2):
        node = np.array([r[2] for r in group])
        n = np.array([r[3] for r in group], dtype=np.float64)
        regs = np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), hm.REGISTERS)
        rest = np.arange(len(group))
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                agree = (regs[rest] == regs[x]).mean(axis=1)
                close = ((agree - chance) / (1 - chance) >= least - SLACK) & (np.minimum(n[rest], n[x]) >= least * np.maximum(n[rest], n[x]) - 1e-9)
                us += [int(node[x])] * int(close.sum())
                vs += node[rest[close]].tolist()
                queue += rest[close].tolist()
                rest = rest[~close]
        if len(us) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            us, vs = [], []
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def families(nodes: DataFrame, least: float) -> DataFrame:
    """(node, component): nodes that may be linked, directly or through others."""
    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = bands.join(shared, "key").select("key", "node", F.ceil(F.col("members") / BUCKET_BLOCK).alias("blocks"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.uint16).reshape(batch.num_rows, -1)
            small = ((regs ^ (regs >> np.uint16(8)) * np.uint16(167)) & np.uint16(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in small], pa.binary())], ["node", "n", "small"])

    folded = nodes.select("node", F.col("n_shingles").alias("n"), "regs").mapInArrow(fold, "node long, n long, small binary")
    dealt = members.join(folded, "node").select("key", F.explode(_blocks(F.col("blocks"), F.col("node"), 1)).alias("block"), "node", "n", "small")
    met = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return connected_components(met.mapInArrow(lambda it: _forest(it, least), "u long, v long"), "families")


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Groups of (family, block, node, regs, set) to the forest of exact links."""
    us: list[int] = []
    vs: list[int] = []
    for group in _groups(batches, 2):
        node = [r[2] for r in group]
        regs = np.frombuffer(b"".join(r[3] for r in group), np.uint16).reshape(len(group), hm.REGISTERS)
        sets = [np.frombuffer(r[4], np.uint64) for r in group]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        root = np.arange(len(group))  # of every member, kept flat
        for x in range(len(group) - 1):
            near = np.flatnonzero(hm.estimate(regs[x + 1:], regs[x]) >= percent / 100 - SLACK) + x + 1
            for y in near[100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x])]:
                if root[x] == root[y]:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (n[x] + n[y] - common):
                    us.append(node[x]), vs.append(node[y])
                    root[root == root[y]] = root[x]
        if len(us) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            us, vs = [], []
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full sets of the wanted nodes (doc_id, k1, k2, ...), from the texts of their least documents."""
    few = distinct_count_at_most(wanted, BROADCAST_ROWS)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted) if few else wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, int] = {}
        for batch in pieces(batches, "text"):
            if len(known) > KNOWN_WORDS:
                known.clear()
            keep, sets, regs = [], [], []
            for i, (text, a, b) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                s = hm.shingle_set(words_of(text.as_py()), shingle, known)
                if hm.set_key(s) == (a, b):  # an id may be repeated with another text
                    keep.append(i), sets.append(s.tobytes()), regs.append(hm.registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns[3:], pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], ["node", "family", "blocks", "regs", "shingles"])

    return rows.select("text", "k1", "k2", "node", "family", "blocks").mapInArrow(run, "node long, family long, blocks long, regs binary, shingles binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, checksum of the text) of every row of ``docs``:
    documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct ``shingle``-word shingles (fewer words: the whole sequence).
    ``component_id`` is the least doc_id that links reach; rows with a null id
    keep it null and stay.  Of a class the row with the least id is kept (equal
    rows: all of them)."""
    least = percent / 100
    sk = store(sketches(docs, shingle), "sketches")
    usable = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = store(
        usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    family = store(families(nodes, least).select("node", F.col("component").alias("family")), "family")
    member = family.join(nodes.select("node", "doc_id", "k1", "k2", "n_shingles"), "node")
    size = member.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY_BLOCK, F.sum("n_shingles") * 8 / FAMILY_BYTES)).alias("blocks"))
    wanted = store(member.join(size, "family").select("doc_id", "k1", "k2", "node", "family", "blocks"), "members")
    dealt = _sets(docs, wanted, shingle).select("family", F.explode(_blocks(F.col("blocks"), F.col("node"), 2)).alias("block"), "node", "regs", "shingles")
    # the same text may be there twice under one id
    met = dealt.repartition("family", "block").sortWithinPartitions("family", "block", "node")
    classes = connected_components(met.mapInArrow(lambda it: _verify(it, percent), "u long, v long"), "classes")
    linked = classes.join(nodes.select("node", "k1", "k2", "doc_id"), "node")
    first = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_linked = linked.join(first, "component").select("k1", "k2", F.col("component_id").alias("linked_id"))
    of_set = nodes.select("k1", "k2", F.col("doc_id").alias("set_id")).join(of_linked, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("linked_id", "set_id").alias("class_id"))
    out = sk.select("doc_id", "checksum", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "checksum")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of every class, with all its columns: the least id's, of rows with
    that id the one of least checksum, of equal rows any one.  Rows with a null id stay."""
    rows = store(near_duplicates(docs, shingle, percent).where("doc_id IS NOT NULL").groupBy("doc_id", "checksum", "component_id", "kept").agg(F.count(F.lit(1)).alias("n")), "near_rows")
    one = rows.where("kept").groupBy("doc_id", "component_id").agg(F.min("checksum").alias("least"))
    judged = rows.join(one, ["doc_id", "component_id"], "left").withColumn("stays", F.col("kept") & (F.col("checksum") == F.col("least")))
    # rows that go, and rows that are there several times: few against the table
    special = store(judged.where("NOT stays OR n > 1").select("doc_id", "checksum", "stays"), "near_special")
    special = F.broadcast(special) if distinct_count_at_most(special, BROADCAST_ROWS) else special
    packed, back = carried(docs)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), checksum().alias("checksum"), packed.alias("row"))
    single = whole.join(special, ["doc_id", "checksum"], "left_anti")
    several = whole.join(special.where("stays").drop("stays"), ["doc_id", "checksum"]).dropDuplicates(["doc_id", "checksum"])
    return single.unionByName(several).select(*back("row"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: two-word shingles of every whole document."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("checksum")
