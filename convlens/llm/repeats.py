"""Operator 8: exact removal of long repeats.

A byte is removed if a string of ``length`` bytes covers it that also starts
earlier (an earlier document, or earlier in the same one); overlaps count, and
strings are judged on the input.  Null texts are empty.  Documents are ordered by id, null ids
first; equal ids by hashes of the text (128 bits); rows with equal id and text are one document.

1. Every task cuts its texts into runs of windows with one anchor (windows.py)
   and drops to marks what repeats an earlier run of its own batch, so a string
   that is everywhere costs a row per batch.
2. Runs meet by their anchor's hash, in order.  A run equal to an earlier one is
   marked whole.  If an anchor has several different runs, the first of each is
   looked at closer: its bytes are fetched.
3. Those contexts meet by anchor; their windows are classed, and of each class all
   but the first are marked.  An anchor with very many different
   contexts is dealt out in parts, whose firsts meet again by window.
4. Marks meet their documents.

Hashes of 64 bits are compared within equal anchors (64 further bits), so a
false repeat has a chance of about 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.llm import windows as win
from convlens.llm.common import carried, forget, pieces, store, table

#: Bytes of text whose runs are compared at once, and of contexts classed at once.
BATCH_BYTES, CONTEXT_BYTES = 2_000_000, 1_000_000
#: Contexts of one anchor that one task classes; more are dealt out in parts.
ANCHOR_CONTEXTS = 20_000
NO_ID = -(2**63)

_RUN = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("d", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("dup", pa.bool_())])


def _keyed(docs: DataFrame) -> tuple[DataFrame, Callable[[str], list[Column]]]:
    """(_d, _c, _e, _text, _rest): the key of each document (its id, its text's crc32 above half of a hash, and another hash), its text, not null, and its other columns as one; and what takes those out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest, back = carried(docs, "text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.shiftleft(F.crc32(text) - F.lit(2**31), 32).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1))).alias("_c"), F.xxhash64(F.lit(1), text).alias("_e"), text.alias("_text"), rest.alias("_rest")), back


def _runs_of(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    data, step = np.frombuffer(text, np.uint8), win.PIECE - length
    for begin in range(0, max(len(data) - length + 1, 0), step):
        h, at, first, n, hashes = win.runs(data[begin:begin + step + length - 1], length)
        k = win.mix(hashes.of(first, first + n + length - 1) + h + ((at - first) * length + n).astype(np.uint64))
        yield h.view(np.int64), k.view(np.int64), at + begin, (at - first), n


def runs(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches, "_text", BATCH_BYTES):
            parts = []
            for d, c, e, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                for h, k, at, lo, n in _runs_of(text.as_py().encode("utf-8", "surrogatepass"), length):
                    parts.append((h, k, np.full(len(h), d), np.full(len(h), c), np.full(len(h), e), at, lo, n))
            if parts:
                h, k, d, c, e, at, lo, n = map(np.concatenate, zip(*parts))
                order = np.lexsort((at, e, c, d, k))
                # the same document may be there twice
                same = (k[order][1:] == k[order][:-1]) & ((at[order][1:] != at[order][:-1]) | (d[order][1:] != d[order][:-1]) | (c[order][1:] != c[order][:-1]) | (e[order][1:] != e[order][:-1]))
                dup = np.zeros(len(h), bool)
                dup[order[1:]] = same
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h, k, d, c, e, at, lo.astype(np.int32), n.astype(np.int32), dup), _RUN.types)], schema=_RUN)

    return keyed.select("_d", "_c", "_e", "_text").mapInArrow(run, "h long, k long, d long, c long, e long, at long, lo int, n int, dup boolean")


_MARK = pa.schema([("d", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, k, d, c, e, at) to marks (h null) and to the first run of
    every kind of an anchor that has several.  An anchor's first run is held
    until a second kind or the next anchor is seen."""
    forget()
    held: tuple | None = None  # h, k, d, c, e, at and the rest of the last run that began a kind; whether it is known to be one of several
    several = False
    for batch in batches:
        h, k, d, c, e, at, lo, n, dup = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        # before the first row: the run held, so that its kind and anchor go on
        if held is not None:
            h, k, d, c, e, at, lo, n, dup = (np.concatenate([[v], x]) for v, x in zip(held, (h, k, d, c, e, at, lo, n, dup)))
        dup = dup.astype(bool)
        live = np.flatnonzero(~dup)
        new_h = np.ones(len(live), bool)
        new_h[1:] = h[live][1:] != h[live][:-1]
        new_k = new_h.copy()
        new_k[1:] |= k[live][1:] != k[live][:-1]
        firsts = live[new_k]
        # a kind is one of several if the kind before or after it has the same anchor
        same = h[firsts][1:] == h[firsts][:-1]
        many = np.zeros(len(firsts), bool)
        many[1:] |= same
        many[:-1] |= same
        if len(firsts) and held is not None:
            many[0] |= several
        # a run equal to its kind's first one is a repeat, unless it is the same document's own row again
        kind = np.cumsum(new_k) - 1
        first = firsts[kind] if len(live) else live
        repeat = live[(d[live] != d[first]) | (c[live] != c[first]) | (e[live] != e[first]) | (at[live] != at[first])]
        repeat = np.concatenate([np.flatnonzero(dup), repeat])
        out = firsts[:-1][many[:-1]]
        if len(firsts):
            i = firsts[-1]
            held, several = (h[i], k[i], d[i], c[i], e[i], at[i], lo[i], n[i], False), bool(many[-1])
        rows = np.concatenate([repeat, out]).astype(np.int64)
        begin = at[rows] - lo[rows]
        yield _marks(d[rows], c[rows], e[rows], begin, begin + n[rows] + length - 1, h[rows], lo[rows], n[rows], len(repeat))
    if held is not None and several:
        h, _, d, c, e, at, lo, n, _ = (np.array([v]) for v in held)
        yield _marks(d, c, e, at - lo, at - lo + n + length - 1, h, lo, n, 0)


def _marks(d, c, e, begin, end, h, lo, n, marks: int) -> pa.RecordBatch:
    null = np.arange(len(d)) < marks
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((d, c, e, begin, end), _MARK.types)] + [pa.array(x, t, mask=null) for x, t in zip((h, lo, n), _MARK.types[5:])], schema=_MARK)


_MARKS_DDL = "d long, c long, e long, begin long, end long, h long, lo int, n int"


def _contexts(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """The bytes of runs that are looked at closer."""
    wanted = firsts.groupBy("d", "c", "e").agg(F.collect_list(F.struct("begin", "end", "h", "n")).alias("wanted"))
    joined = keyed.join(wanted, (F.col("_d") == F.col("d")) & (F.col("_c") == F.col("c")) & (F.col("_e") == F.col("e")))
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all columns are taken, so that the texts' exchange is the one that the marks meet
        at = {x: names.index(x) for x in ("_d", "_c", "_e", "_text", "wanted")}
        for batch in pieces(batches, "_text", BATCH_BYTES):
            rows = []
            for d, c, e, text, wanted in zip(*(batch.column(at[x]).to_pylist() for x in ("_d", "_c", "_e")), batch.column(at["_text"]), batch.column(at["wanted"])):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rows += [(r["h"], d, c, e, r["begin"], r["n"], data[r["begin"]:r["end"]]) for r in wanted.as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["h", "d", "c", "e", "begin", "n", "context"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return joined.mapInArrow(run, "h long, d long, c long, e long, begin long, n int, context binary")


def _class_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, part, parts, d, c, e, begin, n, context), sorted by all of these in
    order, to marks (``w`` null) and, of anchors in several parts, to the first window of each class."""
    schema = pa.schema([("d", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("w", pa.int64())])

    def classed(rows: list[tuple]) -> pa.RecordBatch:
        h, part, parts, d, c, e, begin, n = (np.array(x) for x in zip(*(r[:8] for r in rows)))
        data = np.frombuffer(b"".join(r[8] for r in rows), np.uint8)
        starts = np.cumsum([0, *(len(r[8]) for r in rows[:-1])])
        row = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = starts[row] + offset
        key = np.empty(len(row), np.uint64)
        for piece in range(0, len(data), win.PIECE - length):  # each window lies in the piece that it begins in
            inside = (place >= piece) & (place < piece + win.PIECE - length)
            if inside.any():
                key[inside] = win.Hashes(data[piece:piece + win.PIECE]).of(place[inside] - piece, place[inside] - piece + length)
        group = win.mix(key ^ win.mix(h.astype(np.int64).view(np.uint64) + part.astype(np.uint64))[row])
        order = np.argsort(group, kind="stable")  # rows are in order, so a class begins with its first window
        new = np.ones(len(order), bool)
        new[1:] = group[order][1:] != group[order][:-1]
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        at = begin[row] + offset
        other = (d[row[order]] != d[row[first]]) | (c[row[order]] != c[row[first]]) | (e[row[order]] != e[row[first]]) | (at[order] != at[first])
        marked = np.zeros(len(row), bool)
        marked[order] = other
        # neighbouring marked windows of a run are one mark
        edge = np.ones(len(row), bool)
        edge[1:] = (row[1:] != row[:-1]) | ~marked[:-1]
        s = np.flatnonzero(marked & edge)
        tail = np.ones(len(row), bool)
        tail[:-1] = (row[1:] != row[:-1]) | ~marked[1:]
        t = np.flatnonzero(marked & tail)
        f = np.sort(order[new][parts[row[order[new]]] > 1])
        i = np.concatenate([s, f])
        end = np.concatenate([at[t], at[f]]) + length
        return pa.RecordBatch.from_arrays([pa.array(d[row[i]], pa.int64()), pa.array(c[row[i]], pa.int64()), pa.array(e[row[i]], pa.int64()), pa.array(at[i], pa.int64()), pa.array(end, pa.int64()), pa.array(h[row[i]], pa.int64()), pa.array(key[i].view(np.int64), mask=np.arange(len(i)) < len(s))], schema=schema)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(x.to_pylist() for x in batch.columns)):
            if held and size >= CONTEXT_BYTES and r[:2] != held[-1][:2]:  # whole anchors only
                yield classed(held)
                held, size = [], 0
            held.append(r)
            size += len(r[8])
    if held:
        yield classed(held)


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with ``spans``: the byte ranges [begin, end) of each text that
    repeat an earlier string, as an array of structs in no order, perhaps
    overlapping; null if there are none.  A null text becomes the empty one; a
    column of ``docs`` named ``spans`` is replaced, all others are kept."""
    joined, back = _with_spans(docs, length)
    spans = F.col("spans")
    return joined.select(F.col("_text").alias("text"), *[c for c, x in zip(back("_rest"), [x for x in docs.columns if x != "text"]) if x != "spans"], spans)


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, Callable[[str], list[Column]]]:
    """(_text, _rest, spans) of every row, and what takes the other columns out of ``_rest``."""
    keyed, back = _keyed(docs)
    found = runs(keyed, length)
    # repeats within a batch need no meeting; they are spread by document
    met = found.repartition(F.when(F.col("dup"), F.xxhash64("d", "at")).otherwise(F.col("h"))).sortWithinPartitions("h", "k", "d", "c", "e", "at")
    judged = store(met.mapInArrow(lambda it: _sorted_runs(it, length), _MARKS_DDL), "runs")
    firsts = judged.where("h IS NOT NULL")
    hot = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > ANCHOR_CONTEXTS)
    hot = hot.select(F.col("h").alias("hot"), F.ceil(F.col("contexts") / ANCHOR_CONTEXTS).cast("long").alias("parts"))
    contexts = _contexts(keyed, firsts).join(hot, F.col("h") == F.col("hot"), "left")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = contexts.select("h", F.pmod(F.xxhash64("d", "c", "e", "begin"), parts).alias("part"), parts.alias("parts"), "d", "c", "e", "begin", "n", "context")
    near = dealt.repartition("h", "part").sortWithinPartitions("h", "part", "d", "c", "e", "begin")
    classed = store(near.mapInArrow(lambda it: _class_windows(it, length), "d long, c long, e long, begin long, end long, h long, w long"), "windows")
    loose = classed.where("w IS NOT NULL")
    first = loose.groupBy("h", "w").agg(F.min(F.struct("d", "c", "e", "begin")).alias("first"))
    across = loose.join(first, ["h", "w"]).where(F.struct("d", "c", "e", "begin") != F.col("first")).select("d", "c", "e", "begin", "end")
    marks = judged.where("h IS NULL").select("d", "c", "e", "begin", "end").union(classed.where("w IS NULL").select("d", "c", "e", "begin", "end")).union(across)
    spans = marks.groupBy("d", "c", "e").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = keyed.join(spans, (F.col("_d") == F.col("d")) & (F.col("_c") == F.col("c")) & (F.col("_e") == F.col("e")), "left")
    return joined.select("_text", "_rest", "spans"), back


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of spans as maximal ranges in order."""
    out: list[tuple[int, int]] = []
    for b, e in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    begins = [*(b for b, _ in spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, begins))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is kept is text."""
    out = []
    for b, e in spans:
        while b < e and data[b] & 0xC0 == 0x80:
            b += 1
        while e > b and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if e > b:
            out.append((b, e))
    return out


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with its repeats cut out of ``text`` (whole characters only: of a
    character that a repeat cuts in two all bytes stay) and ``n_chars`` counted anew if it is there."""
    spans, back = _with_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches, "_text", BATCH_BYTES):
            texts = []
            for text, each in zip(batch.column(0), batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                texts.append(kept_bytes(data, whole_characters(data, merged(each.as_py()))).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["_text", "_rest"])

    out = spans.mapInArrow(run, T.StructType(spans.schema.fields[:2]))
    others = dict(zip([x for x in docs.columns if x != "text"], back("_rest")))
    return out.select(*[
        F.col("_text").alias("text") if x == "text" else F.length("_text").cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else others[x] for x in docs.columns])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: strings of 100 bytes over all whole ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            rows = []
            for text, doc_id, each in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                data, spans = text.as_py().encode("utf-8", "surrogatepass"), merged(each.as_py())
                rows.append((doc_id, len(data), sum(e - b for b, e in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("text", "doc_id", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
