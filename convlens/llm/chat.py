"""Operator 3: conversations rendered by a compiled template, with a loss mask.

The template marks turns and the assistant's texts (``{% generation %}``).
Control strings inside texts are escaped reversibly: a backslash before every
backslash and every # of a run of three or more, and inside ``</turn>``, so
neither control string ever occurs in an escaped text.

Rows are grouped by conversation and sorted by turn; a task streams them
through the template's closures, a piece per turn (what precedes the first turn
goes with it, what follows the last goes with that), holding one turn at a
time however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.common import pieces, table
from convlens.llm.templates import Output, compile_stream, compile_template

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "<\\/turn>" if m[0][0] == "<" else "".join("\\" + c for c in m[0]), text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TEMPLATE`` rendered."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches, "text"):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _pieces(rows: Iterator[tuple], template: str) -> Iterator[tuple]:
    """(conv_id, n, Output) of sorted rows (conv_id, turn, role, text)."""
    stream = compile_stream(template, FILTERS, "messages")
    whole = compile_template(template, FILTERS)
    row = next(rows, None)
    while row is not None:
        conv_id, n, env, out = row[0], 0, {}, Output()
        if stream:
            stream.before(env, out)
        else:
            env["messages"] = []
        while row is not None and row[0] == conv_id:
            message, row = {"role": row[2], "text": row[3]}, next(rows, None)
            last = row is None or row[0] != conv_id
            if not stream:
                env["messages"].append(message)
                continue
            env[stream.variable], env["loop"] = message, {"index": n + 1, "index0": n, "first": n == 0, "last": last}
            stream.item(env, out)
            if not last:
                yield conv_id, n, out
                out = Output()
            n += 1
        if stream:
            env.pop(stream.variable), env.pop("loop")
            stream.after(env, out)
        else:
            whole(env, out)
        yield conv_id, max(n - 1, 0), out


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def render(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n, piece, spans): the conversation's formatted text is its
    pieces in the order of ``n`` (from 0); spans are [begin, end) code points of
    the piece under the loss mask.  ``rows``: conv_id, turn, role, text, in any
    order; a null role or text is empty; turns sort nulls first, ties by role
    and text; rows of a null conv_id are one conversation.  Rows of a
    conversation follow each other in the result's partitions, in order.
    A template that reads ``messages`` otherwise than in one loop at its top level
    gets them all at once, and a conversation is then one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        for conv_id, n, out in _pieces(_turn_rows(batches), template):
            done.append((conv_id, n, "".join(out.parts), [{"begin": b, "end": e} for b, e in out.spans]))
            size += out.length
            if size >= 1_000_000:
                yield _batch(done)
                done, size = [], 0
        yield _batch(done)

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        ids, ns, texts, spans = zip(*done) if done else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN))], ["conv_id", "n", "piece", "spans"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    dealt = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, n long, piece string, spans array<struct<begin: long, end: long>>")


def conversations(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) with the pieces joined and the spans moved accordingly."""
    parts = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "spans"))).alias("p"))
    moved = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<begin: long, end: long>>").alias("spans")),
        lambda s, x: F.struct((s["at"] + F.length(x["piece"])).alias("at"), F.concat(s["spans"], F.transform(x["spans"], lambda y: F.struct((y["begin"] + s["at"]).alias("begin"), (y["end"] + s["at"]).alias("end")))).alias("spans")),
    )
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), moved["spans"].alias("spans"))


def digest(rendered: DataFrame) -> DataFrame:
    """What the rendered pieces (of ``TEMPLATE``, as ``render`` leaves them) say,
    read back: turns, their hash, and the unescaped text under the loss mask.
    Hashes run along the pieces, so a long conversation is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: object = run  # no conversation yet

        def close() -> None:
            if now is not run:
                rows.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in pieces(batches, "piece"):
            for conv_id, _, piece, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != now:
                    close()
                    now, n, turns, loss, loss_chars, chars = conv_id, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text in parse_turns(piece):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    part = unescape(piece[s["begin"]:s["end"]])
                    loss.update(part.encode("utf-8", "surrogatepass"))
                    loss_chars += len(part)
                chars += len(piece)
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        close()
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, types)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every conversation and conversation -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return digest(render(rows.unionByName(extra)))
