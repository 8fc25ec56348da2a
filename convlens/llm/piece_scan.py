"""Operator 6: SentencePiece encoding and decoding, giant texts by a max-plus parallel scan.

The model is a BPE model with byte fallback.  Its result is a path through the
lattice of pieces, and a path is the model's own exactly if each pair of
neighbouring pieces is what BPE makes of the two joined.  (Were it not, look at
the first merge across a border: until then each side has merged only within
itself, as it does in the pair alone.)  So weights are 0 for an admissible pair
and minus infinity for any other, and the best path is the only finite one.

A giant text is cut into chunks at fixed places, wherever they fall.  The state
at a cut is the piece that covers the character before it.  Each chunk yields
its transfer matrix (which states at its left cut lead to which at its right
cut); the matrices multiply associatively in the max-plus semiring; the product
fixes the state at every cut; each chunk is then backtraced by itself.  Where a
space follows a non-space no piece crosses and every pair is admissible, so all
states meet there: the matrix has rank one, only the ends of a chunk need the
lattice, and what lies between goes through the library.

Results equal the library's.  Null texts encode to no ids and decode to the
empty string; the decoded text equals the text except that the character
U+2581, which the model cannot tell from a space, comes back as a space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.llm.common import TOKENIZER_DIR, WORKER, carried, forget, pieces, store, table
from convlens.llm.word_cache import UnitEncoder

SPACE = "▁"
#: Texts longer than this are giant and cut into chunks of this many characters.
CHUNK_CHARS = 65_536
#: Words that a worker keeps with their ids; small, as other stages of a pipeline run in the same workers.
CACHED_WORDS = 200_000

_CUT = re.compile(f"(?<=[^ {SPACE}]) ")

State = tuple[int, int]  # where the piece that covers the character before a cut begins and ends, relative to the cut


def _split(text: str) -> list[str]:
    if "  " in text or text[:1] == " " or SPACE in text:
        return _CUT.split(text)
    return text.split(" ")


class Model:
    """A model file, its word cache and its lattice."""

    def __init__(self, path: str):
        self.sp = sp = _processor(path)
        n = sp.vocab_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not sp.is_byte(self.bytes[0]) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a model with byte fallback, and without spaces inside pieces, is needed")
        self.longest = max(map(len, self.ids))
        self.cache = UnitEncoder(self._encode_units, "", "", _split, CACHED_WORDS)

    @cached_property
    def scores(self) -> dict[str, float]:
        """Needed by the lattice, so only in workers that see a chunk of a giant text."""
        return {p: self.sp.get_score(i) for p, i in self.ids.items()}

    @cached_property
    def admissible(self) -> Callable[[str, str], bool]:
        return lru_cache(200_000)(self._admissible)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        # the library puts a space before each string, which here is the one at the cut; alone, it is a piece
        return [np.array(x if u else [self.ids[SPACE]], "<i4").tobytes() for u, x in zip(units, self.sp.encode(units, num_threads=1))]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x if t else b"" for t, x in zip(texts, self.cache(texts))]

    def bpe(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            score, at = max((self.scores.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
            if score == -np.inf:
                break
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _admissible(self, left: str, right: str) -> bool:
        return self.bpe(left + right) == ([left, right] if left else [right])

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def ends(self, s: str, at: int) -> Iterator[int]:
        if s[at] not in self.ids:
            yield at + 1
        for e in range(at + 1, min(len(s), at + self.longest) + 1):
            if s[at:e] in self.ids:
                yield e

    def states(self, s: str, cut: int) -> list[State]:
        """Every piece that may cover the character before ``cut``."""
        return [(a - cut, e - cut) for a in range(max(0, cut - self.longest), cut) for e in self.ends(s, a) if e >= cut and self.admissible("", s[a:e])]

    def paths(self, s: str, begin: dict[tuple[int, int], int], cut: int, final: bool) -> tuple[dict[tuple[int, int], int], dict]:
        """From pieces (start, end) with sets of states (as bits), walk the
        lattice to ``cut``: the pieces that cover the character before it (if
        ``final``, that end at it) with the states that lead there, and what
        precedes each piece."""
        at: dict[int, dict[int, int]] = {}
        out: dict[tuple[int, int], int] = {}
        before: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def reach(piece: tuple[int, int], bits: int) -> None:
            a, e = piece
            if e < cut:
                at.setdefault(e, {})[a] = at.get(e, {}).get(a, 0) | bits
            elif e == cut or not final:
                out[piece] = out.get(piece, 0) | bits

        for piece, bits in begin.items():
            reach(piece, bits)
        p = min(at, default=cut)
        while p < cut:
            for a, bits in at.pop(p, {}).items():
                for e in self.ends(s, p):
                    if self.admissible(s[a:p], s[p:e]):
                        before.setdefault((p, e), []).append((a, p))
                        reach((p, e), bits)
            p += 1
        return out, before

    def trace(self, s: str, begin: tuple[int, int], goal: tuple[int, int], cut: int, final: bool) -> list[int]:
        """The ids after ``begin`` up to and with ``goal``."""
        _, before = self.paths(s, {begin: 1}, cut, final)
        path = []
        while goal != begin:
            path.append(goal)
            (goal,) = before[goal]
        return [i for a, e in reversed(path) for i in self.piece_ids(s[a:e])]


def _processor(path: str):
    if ("processor", path) not in WORKER:
        forget()
        import sentencepiece

        WORKER["processor", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return WORKER["processor", path]


def _model(path: str) -> Model:
    if ("pieces", path) not in WORKER:
        WORKER["pieces", path] = Model(path)
    return WORKER["pieces", path]


def _borders(s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and the last place in ``lo..hi`` where a space follows a non-space."""
    inner = [m.start() + lo for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", s[max(0, lo - 1):hi])]
    inner = [x - (lo > 0) for x in inner]
    return (inner[0], inner[-1]) if inner else None


def transfer(model: Model, s: str, lo: int, hi: int, first: bool, last: bool) -> list[tuple[State, State]]:
    """The finite entries of the matrix of the chunk ``s[lo:hi]``."""
    begin = {(lo, lo): 1} if first else {(lo + a, lo + e): 1 << k for k, (a, e) in enumerate(model.states(s, lo))}
    border = _borders(s, lo, hi)
    if border:
        alive, _ = model.paths(s, begin, border[0], True)
        met = 0
        for bits in alive.values():
            met |= bits
        out, _ = model.paths(s, {(border[1], border[1]): met}, hi, last)
    else:
        out, _ = model.paths(s, begin, hi, last)
    return [((a - lo, e - lo), (0, 0) if last else (x - hi, y - hi)) for (a, e), bit in begin.items() for (x, y), bits in out.items() if bits & bit]


def multiply(left: list[tuple[State, State]], right: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """The max-plus product of two matrices, entries being 0 or minus infinity."""
    go: dict[State, set[State]] = {}
    for a, b in right:
        go.setdefault(a, set()).add(b)
    return sorted({(a, c) for a, b in left for c in go.get(b, ())})


def backtrace(model: Model, s: str, lo: int, hi: int, last: bool, a: State, b: State) -> list[int]:
    begin = (lo + a[0], lo + a[1])
    border = _borders(s, lo, hi)
    if not border:
        start, head, middle = begin, [], []
    else:
        ends, _ = model.paths(s, {begin: 1}, border[0], True)
        (goal,) = ends
        head = model.trace(s, begin, goal, border[0], True)
        inner = s[border[0] + 1:border[1]].replace(SPACE, " ")
        middle = np.frombuffer(model.encode([inner])[0] if inner else np.array([model.ids[SPACE]] * (border[1] > border[0]), "<i4").tobytes(), "<i4").tolist()
        start = (border[1], border[1])
    goals = [g for g in model.paths(s, {start: 1}, hi, last)[0] if last or (g[0] - hi, g[1] - hi) == b]
    return [*head, *middle, *model.trace(s, start, goals[0], hi, last)]


def _decoded(sp, ids: list[list[int]]) -> pa.Array:
    return pa.array([sp.decode(x) if x else "" for x in ids], pa.string())


def encode(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) instead of its text, and if asked
    for with what they decode to as ``decoded``, in the same pass; columns that
    have one of these names are replaced, all others are kept."""
    new = ["token_ids", "decoded"] if decoded else ["token_ids"]
    rest, back = carried(docs, "text", *new)
    rows = docs.select(rest.alias("rest"), F.col("text").cast("string").alias("x"))
    schema = T.StructType([rows.schema["rest"], T.StructField("token_ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in pieces(batches, "x"):
            ids = [np.frombuffer(x, "<i4") for x in model.encode([t or "" for t in batch.column(1).to_pylist()])]
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *[_decoded(model.sp, [x.tolist() for x in ids])] * decoded], schema.names)

    giant = rows.where(F.length("x") > chunk_chars).withColumn("key", F.sha2("x", 256))
    ids = encode_giant(giant.groupBy(F.col("key").alias("_key")).agg(F.first("x").alias("text")), model_path, chunk_chars)
    long = giant.join(ids, F.col("key") == F.col("_key")).select("rest", "token_ids")
    whole = rows.where(F.coalesce(F.length("x"), F.lit(0)) <= chunk_chars).mapInArrow(run, schema)
    return whole.unionByName(decode(long, model_path) if decoded else long).select(*back("rest"), *new)


def encode_giant(texts: DataFrame, model_path: str, chunk_chars: int) -> DataFrame:
    """(_key, text) to (_key, token_ids) by the parallel scan; keys are unique."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = _model(model_path).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = SPACE + text.as_py().replace(" ", SPACE)
                n = -(-len(s) // chunk_chars)
                for k in range(n):
                    lo, hi = k * chunk_chars, min(len(s), (k + 1) * chunk_chars)
                    a = max(0, lo - halo)
                    yield pa.RecordBatch.from_pylist([{"_key": key, "k": k, "n": n, "s": s[a:hi + halo], "lo": lo - a, "hi": hi - a}], schema)

    schema = pa.schema([("_key", pa.string()), ("k", pa.int32()), ("n", pa.int32()), ("s", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
    ddl = "_key string, k int, n int, s string, lo int, hi int"
    chunks = store(texts.select("_key", "text").mapInArrow(cut, ddl).repartition("_key", "k"), "giant_chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = [(r[0], r.k, r.n, *a, *b) for a, b in transfer(model, r.s, r.lo, r.hi, r.k == 0, r.k == r.n - 1)]
                yield pd.DataFrame(rows, columns=["_key", "k", "n", "a0", "a1", "b0", "b1"])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        # forward products from the start, then the states from which the end is reached
        key, n = part["_key"].iloc[0], int(part["n"].iloc[0])
        each: list[list[tuple[State, State]]] = [[] for _ in range(n)]
        for r in part.itertuples(index=False):
            each[r.k].append(((r.a0, r.a1), (r.b0, r.b1)))
        front = [[((0, 0), (0, 0))]]
        for m in each:
            front.append(multiply(front[-1], m))
        rows, state = [], (0, 0)
        for k in range(n - 1, -1, -1):
            (a,) = {a for a, b in each[k] if b == state} & {b for _, b in front[k]}
            rows.append((key, k, *a, *state))
            state = a
        return pd.DataFrame(rows, columns=["_key", "k", "a0", "a1", "b0", "b1"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = backtrace(model, r.s, r.lo, r.hi, r.k == r.n - 1, (r.a0, r.a1), (r.b0, r.b1))
                yield pd.DataFrame({"_key": [r[0]], "k": [r.k], "ids": [ids]})

    # a matrix has some dozens of entries, whatever the chunk's length: a group is tiny against its text
    states = chunks.mapInPandas(matrices, "_key string, k int, n int, a0 int, a1 int, b0 int, b1 int").groupBy("_key").applyInPandas(choose, "_key string, k int, a0 int, a1 int, b0 int, b1 int")
    traced = chunks.join(states, ["_key", "k"]).mapInPandas(trace, "_key string, k int, ids array<int>")
    parts = F.sort_array(F.collect_list(F.struct("k", "ids")))
    return traced.groupBy("_key").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("token_ids"))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the text of its ``token_ids`` (null: empty) as ``decoded``."""
    rest, back = carried(encoded, "decoded")
    rows = encoded.select(rest.alias("rest"), F.col("token_ids").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_path)
        for batch in pieces(batches, "x"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _decoded(sp, batch.column(1).to_pylist())], ["rest", "decoded"])

    return rows.mapInArrow(run, T.StructType([rows.schema["rest"], T.StructField("decoded", T.StringType())])).select(*back("rest"), "decoded")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: its ids, and the hash of what they decode to beside the text's own."""
    path = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = encode(docs, path, decoded=True)
    return out.select("doc_id", "n_chars", F.size("token_ids").alias("n_tokens"), "token_ids", "text_hash", F.xxhash64("decoded").alias("decoded_hash"))
