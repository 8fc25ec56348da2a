"""Operator 5: token ids as fixed-width bit-packed shards.

A shard is a sequence of blocks, each followed by one newline byte.  A block
holds whole documents:

    magic ``TIDS`` | bits uint8 | 3 zero bytes | n_docs uint32 | pad uint32 | n_ids uint64
    doc ids int64[n_docs] | 1 where the doc id is null uint8[n_docs] | lengths uint32[n_docs]
    ids, ``bits`` bits each, least significant bit first, padded to a byte

All numbers are little-endian.  ``bits`` is the least number that holds every
id of the vocabulary.  An id's place follows from its number alone, so any
range of a block unpacks with numpy, and the index of block offsets gives
random access to a document or an id number without reading what precedes it.

Documents are dealt out by ranges of ``doc_id`` and each task streams its
sorted range into blocks of bounded size; the files come from Spark's own text
writer (one block a row), whose commit protocol survives lost executors.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlens.llm.common import TOKENIZER_DIR, WORKER, forget, pieces, shared_path, store, table
from convlens.llm.word_cache import UnitEncoder

MAGIC, HEAD = b"TIDS", struct.Struct("<4sB3xI4xQ")
#: Ids after which a block ends (at the end of a document).
BLOCK_IDS = 1 << 18
#: Unknown words that are tokenized as one text.
WORDS_JOINED = 200

#: A unit whose one space is its first character.
_ONE_SPACE = re.compile(r" \S+(?:[\t\n\x0b\x0c\r]+\S+)*")


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(packed: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a packed run, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    begin, end = first * bits // 8, ((first + count) * bits + 7) // 8
    raw = np.zeros(end - begin + 8, dtype=np.uint64)
    raw[: end - begin] = np.frombuffer(packed, dtype=np.uint8, count=end - begin, offset=begin)
    byte, shift = at // 8 - begin, (at % 8).astype(np.uint64)
    word = np.zeros(count, dtype=np.uint64)
    for k in range((bits + 7) // 8 + 1):
        word |= raw[byte + k] << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def make_block(docs: list[tuple[int | None, np.ndarray]], bits: int) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    return b"".join([
        HEAD.pack(MAGIC, bits, len(docs), len(ids)),
        np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(),
        np.array([d is None for d, _ in docs], dtype=np.uint8).tobytes(),
        np.array([len(x) for _, x in docs], dtype="<u4").tobytes(),
        pack_ids(ids, bits),
    ])


def blocks_of(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, memoryview]]:
    """(offset, bytes, bits, doc ids, nulls, lengths, packed ids) of each block of a shard."""
    view, at = memoryview(content), 0
    while at < len(content):
        magic, bits, n_docs, n_ids = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        p = at + HEAD.size
        docs = np.frombuffer(content, "<i8", n_docs, p)
        nulls = np.frombuffer(content, np.uint8, n_docs, p + 8 * n_docs)
        lengths = np.frombuffer(content, "<u4", n_docs, p + 9 * n_docs)
        p += 13 * n_docs
        end = p + (n_ids * bits + 7) // 8
        yield at, end - at, bits, docs, nulls, lengths, view[p:end]
        at = end + 1


def _encoder(path: str) -> tuple[UnitEncoder, int]:
    """One encoder per worker process and file; its cache of words outlives a batch.

    Words that no cache knows are given to the library many to a text: a
    byte-level tokenizer begins a token at every space that follows a word, so
    the tokens that begin with a space tell the words' ids apart.  Tokenizers
    of another kind get whole texts."""
    if ("ids", path) not in WORKER:
        forget()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        parts = json.loads(t.to_str())
        before = parts["pre_tokenizer"] or {}
        by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts["normalizer"] and not parts["post_processor"]
        special = [x["content"] for x in parts["added_tokens"]]
        spaced = np.zeros(t.get_vocab_size(), bool)
        spaced[[i for token, i in t.get_vocab().items() if token.startswith("\u0120")]] = True

        def each(units: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch_fast(units, add_special_tokens=False)]

        def joined(units: list[str]) -> list[bytes]:
            groups = [units[i:i + WORDS_JOINED] for i in range(0, len(units), WORDS_JOINED)]
            out: list[bytes] = []
            for group, e in zip(groups, t.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(spaced[ids])
                if len(cuts) != len(group) or cuts[0]:
                    out += each(group)
                    continue
                raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                out += [raw[a:b] for a, b in zip((4 * cuts).tolist(), ends)]
            return out

        def encode(units: list[str]) -> list[bytes]:
            plain = [_ONE_SPACE.fullmatch(u) is not None for u in units]
            if any(x in "\n".join(units) for x in special):
                plain = [p and not any(x in u for x in special) for p, u in zip(plain, units)]
            words = iter(joined(list(compress(units, plain))))
            rest = iter(each([u for u, p in zip(units, plain) if not p]))
            return [next(words) if p else next(rest) for p in plain]

        encoder = UnitEncoder(encode, "", " ") if by_word else UnitEncoder(each, "", "", lambda text: [text])
        WORKER["ids", path] = encoder, t.get_vocab_size()
    return WORKER["ids", path]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text (null: empty), append ``end_id`` and write shards in
    ascending ``doc_id`` order (null ids first, equal ids by text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, vocab = _encoder(tokenizer)
        bits = max(bits_for(vocab), bits_for(end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for batch in pieces(batches, "text"):
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                held.append((doc_id, np.frombuffer(ids + end, dtype="<u4")))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([make_block(held, bits)], pa.binary())], ["block"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([make_block(held, bits)], pa.binary())], ["block"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path, lineSep="\n")


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row per block: file, number in the file, byte offset and length, and
    how many ids of the corpus precede it (``start``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for k, (at, size, bits, ids, nulls, lengths, _) in enumerate(blocks_of(content.as_py())):
                    n = int(lengths.sum(dtype=np.int64))
                    rows.append({"file": file, "block": k, "offset": at, "bytes": size, "bits": bits, "first_doc": None if nulls[0] else int(ids[0]), "n_docs": len(ids), "n_ids": n, "before": before})
                    before += n
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "file string, block int, offset long, bytes long, bits int, first_doc long, n_docs long, n_ids long, before long"
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in ddl.split(", "))])
    blocks = store(_files(spark, path).mapInArrow(scan, ddl), "shard_index")
    # a row per file: ranges of doc_id do not overlap, so their first ids order the files
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"), F.min_by("first_doc", "block").alias("first_doc"))
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("file_start"))
    return blocks.join(starts, "file").select("file", "block", "offset", "bytes", "bits", "n_docs", "n_ids", "file_start", (F.col("file_start") + F.col("before")).alias("start"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it), n_tokens,
    ids_crc32 and, if asked for, the ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = 0
                for _, _, bits, docs, nulls, lengths, packed in blocks_of(content.as_py()):
                    ids = unpack_ids(packed, bits, 0, int(lengths.sum(dtype=np.int64))).astype("<u4")
                    ends = np.cumsum(lengths, dtype=np.int64)
                    each = [ids[e - n:e] for e, n in zip(ends, lengths)]
                    columns = [
                        pa.array([file] * len(docs)), pa.array(docs, pa.int64(), mask=nulls.astype(bool)), pa.array(before + ends - lengths, pa.int64()),
                        pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    before += len(ids)

    ddl = "file string, doc_id long, in_file long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [c.split()[0] for c in ddl.split(", ")]
    starts = index_shards(spark, path).where("block = 0").select("file", "file_start")
    rows = _files(spark, path).mapInArrow(decode, ddl).join(starts, "file")
    return rows.select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_ids(index: DataFrame, first: int, count: int) -> np.ndarray:
    """Random access: ids ``first`` to ``first + count`` of the corpus, through
    the index.  ``count`` is what the caller asks to hold."""
    spark, out = index.sparkSession, []
    hit = index.where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first)).orderBy("start").collect()
    for r in hit:
        content = spark.read.format("binaryFile").load(r["file"]).select(F.expr(f"substring(content, {r['offset'] + 1}, {r['bytes']})").alias("b")).first()["b"]
        _, _, bits, _, _, lengths, packed = next(blocks_of(bytes(content)))
        a, b = max(first, r["start"]), min(first + count, r["start"] + r["n_ids"])
        out.append(unpack_ids(packed, bits, a - r["start"], b - a))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document through the shards and back."""
    path = shared_path(spark, "token_shards")
    write_shards(table(spark, sf_dir, "documents"), path, f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    return read_shards(spark, path, with_ids=False)
