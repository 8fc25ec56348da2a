"""Operator 12: BPE with word ends, encoded between certain cuts, and decoded.

No merge can join two bytes that stand next to each other in no token of the
vocabulary: whatever the text around them, BPE leaves a border there.  So such a
place is a forced boundary.  A table of the byte pairs that do occur marks all of
them at once for a whole batch of words; the fragments between them are encoded
independently of each other, each distinct one once while a worker keeps it, and
a text's ids are the concatenation.

* A space is a byte that stands next to no other in any token, so texts are first
  cut at spaces.  What follows such a cut is normalized and split into words as if
  it stood alone (no character composes with a space, the word pattern looks
  neither ahead nor behind), which also cuts giant texts into parts.
* A word's last fragment ends it and takes the model's mark for a word's end; its
  other fragments go to the same merges without that mark.
* Normalization and word pattern are the library's own where characters from
  U+0250 on (or the ASCII separators 1C-1F) occur; below, letters, digits and
  cases are the same in all Unicode versions and Python's functions do.

Strings of special tokens in a text become their ids, as in the library.  Null
texts encode to no ids, and no ids decode to the empty string.  Decoding writes the tokens
with a space between them, as the library does where a file names no decoder.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.llm.common import TOKENIZER_DIR, WORKER, carried, forget, pieces, table

#: Characters of texts that are encoded together, and of the parts of a giant text.
GROUP_CHARS = 1_000_000
#: Units and fragments that a worker keeps between groups, and the longest ones.
KEPT, KEPT_CHARS = 250_000, 40

#: The word pattern that a tokenizer file must state (a fixed value of the format) ...
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ... and how it reads where no white space is left.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_NOT_PLAIN = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    if it is printable Latin-1, else the next one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def pair_table(vocab: list[str], end: str) -> np.ndarray:
    """bool[256, 256]: which bytes follow each other inside some token."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    out = np.zeros((256, 256), bool)
    for token in vocab:
        for body in {token, token.removesuffix(end)}:
            b = [byte.get(c) for c in body]
            for x, y in zip(b, b[1:]):
                if x is not None and y is not None:
                    out[x, y] = True
    return out


class FragmentEncoder:
    """A tokenizer file, its pair table and the fragments known so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation(), self.whole.no_padding()
        parts = json.loads(self.whole.to_str())
        model, before, added = parts["model"], (parts["pre_tokenizer"] or {}).get("pretokenizers", []), parts["added_tokens"]
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        if (
            model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or model["ignore_merges"] or parts["decoder"] or kinds != ["NFC", "Replace", "Lowercase"]
            or [x["type"] for x in before] != ["Split", "ByteLevel"] or before[0]["pattern"] != {"Regex": PATTERN} or before[1]["use_regex"] or before[1]["add_prefix_space"]
            or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
        ):
            raise ValueError(f"{path} is not a byte-level BPE model with word ends")
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: np.array([x["id"]], "<i4").tobytes() for x in added}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.allowed = pair_table(list(model["vocab"]), self.end).ravel()
        self.character = byte_characters()
        self.byte = {c: b for b, c in enumerate(self.character)}
        bare = {**parts, "normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        # fragments are given as one word each: with the mark of a word's end, and without
        self.ending = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps({**bare, "model": {**model, "end_of_word_suffix": None}}))
        self.fragments: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.units: dict[str, bytes] = {}

    def units_of(self, text: str) -> list[str]:
        """The text between spaces, normalized."""
        if _NOT_PLAIN.search(text):
            return [u for u in self.whole.normalizer.normalize_str(text).split(" ") if u]
        return text.lower().split()

    def words(self, unit: str) -> list[bytes]:
        if unit.isascii():
            return [w.encode() for w in _ASCII_WORD.findall(unit)]
        if not _NOT_PLAIN.search(unit):
            return [w.encode() for w in _WORD.findall(unit)]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(unit)]

    def cuts(self, words: list[bytes]) -> tuple[list[int], list[bool]]:
        """Where the fragments of the joined words end, and which of them end a word."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        ends = np.cumsum([len(w) for w in words])
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.allowed[raw[:-1] * 256 + raw[1:]]
        last = np.zeros(len(raw) + 1, bool)
        last[ends] = cut[ends] = True
        at = np.flatnonzero(cut)[1:]
        return at.tolist(), last[at].tolist()

    def _learn(self, missing: list[str]) -> None:
        """The ids of units that are not known."""
        words = [self.words(u) for u in missing]
        flat = [w for ws in words for w in ws if w]
        if not flat:
            self.units.update(dict.fromkeys(missing, b""))
            return
        raw, (at, last) = b"".join(flat), self.cuts(flat)
        parts = [(raw[a:b], end) for a, b, end in zip([0, *at], at, last)]
        for known, model, which in ((self.fragments[0], self.inner, False), (self.fragments[1], self.ending, True)):
            new = sorted({f for f, end in parts if end is which}.difference(known))
            texts = ["".join(map(self.character.__getitem__, f)) for f in new]
            for f, e in zip(new, model.encode_batch_fast(texts, add_special_tokens=False)) if new else ():
                known[f] = np.array(e.ids, "<i4").tobytes()
        of_word, now = [], []
        for f, end in parts:
            now.append(self.fragments[end][f])
            if end:
                of_word.append(b"".join(now))
                now = []
        k = 0
        for u, ws in zip(missing, words):
            n = sum(map(bool, ws))
            self.units[u] = b"".join(of_word[k:k + n])
            k += n

    def _group(self, texts: list[list[str] | bytes]) -> list[bytes]:
        """Ids of lists of units; what is bytes already stays."""
        for kept in (*self.fragments, self.units):
            if len(kept) > KEPT:
                kept.clear()
        need = set()
        for t in texts:
            if not isinstance(t, bytes):
                need.update(t)
        missing = sorted(need.difference(self.units))
        if missing:
            self._learn(missing)
        out = [t if isinstance(t, bytes) else b"".join(map(self.units.__getitem__, t)) for t in texts]
        for u in missing:
            if len(u) > KEPT_CHARS:
                del self.units[u]
        for kept in self.fragments:
            for f in [f for f in kept if len(f) > KEPT_CHARS] if missing else ():
                del kept[f]
        return out

    def parts(self, text: str) -> Iterator[list[str] | bytes]:
        """A text as lists of units, a giant one cut at spaces; special tokens as their ids."""
        for piece in self.special_pattern.split(text) if self.special_pattern and any(s in text for s in self.special) else [text]:
            if piece in self.special:
                yield self.special[piece]
                continue
            at = 0
            while at < len(piece):
                end = len(piece) if len(piece) - at <= GROUP_CHARS else piece.find(" ", at + GROUP_CHARS)
                end = len(piece) if end < 0 else end
                yield self.units_of(piece[at:end])
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        held: list[list[str] | bytes] = []
        owner: list[int] = []
        done: list[list[bytes]] = [[] for _ in texts]
        size = 0

        def flush() -> None:
            for k, ids in zip(owner, self._group(held)):
                done[k].append(ids)
            held.clear(), owner.clear()

        for k, text in enumerate(texts):
            for part in self.parts(text):
                held.append(part), owner.append(k)
                size += len(part) * 6  # about the characters of a unit
                if size >= GROUP_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(d) for d in done]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def _encoder(path: str) -> FragmentEncoder:
    if ("fragments", path) not in WORKER:
        forget()
        WORKER["fragments", path] = FragmentEncoder(path)
    return WORKER["fragments", path]


def _with(docs: DataFrame, of: str, run: Callable, new: list[tuple[str, T.DataType]]) -> DataFrame:
    """``docs`` with columns made from the column ``of`` of each Arrow batch."""
    rest, back = carried(docs, of if of == "text" else "", *[n for n, _ in new])
    rows = docs.select((F.col(of).cast("string") if of == "text" else F.col(of)).alias("x"), rest.alias("rest"))
    schema = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), *[T.StructField(n, t) for n, t in new]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "x"):
            yield pa.RecordBatch.from_arrays([batch.column(1), *run(batch.column(0))], schema.names)

    return rows.mapInArrow(task, schema).select(*back("rest"), *[n for n, _ in new])


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))


IDS, DECODED = ("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) in place of its ``text``; other
    columns stay, but one named ``token_ids`` is replaced."""
    return _with(docs, "text", lambda x: [_lists(_encoder(path).encode([t or "" for t in x.to_pylist()]))], [IDS])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with what its ``token_ids`` decode to as ``decoded`` (null ids: the empty string)."""
    return _with(encoded, "token_ids", lambda x: [pa.array([_encoder(path).decode(i or []) for i in x.to_pylist()], pa.string())], [DECODED])


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts."""

    def run(x: pa.Array) -> list[pa.Array]:
        model = _encoder(path)
        ids = model.encode([t or "" for t in x.to_pylist()])
        return [_lists(ids), pa.array([model.decode(np.frombuffer(i, "<i4").tolist()) for i in ids], pa.string())]

    return _with(docs, "text", run, [IDS, DECODED])


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the digests of every document's ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_and_decode(docs, f"{TOKENIZER_DIR}/word_bpe_49k.json")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
