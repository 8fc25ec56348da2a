"""Operator 9: WARC archives, written and read back with a boundary chain.

Writing: a record per page through Spark's text writer (a row a record, the
record separator as line separator), so lost executors cost a task and no
half-written file is ever read.  Of pages with equal payloads the one with the largest id is
written whole, the others as revisits that name it.

Reading: archives are read in splits, cut at every occurrence of the magic
line; an occurrence inside a payload is a candidate like any other.  A task
parses its candidates into (record, successor) offsets.  Within blocks of the
file the chains are contracted; then pointer jumping over (entry, exit) pairs,
from each file's start, keeps the blocks' reachable entries: its rounds grow
with the logarithm of a file's blocks.  A last pass walks each block from its
entry.  What is not reachable is payload.  Records that hold the magic, or
cross splits, are put together from the pieces between their ends.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlens.llm.common import distinct_count_at_most, pieces, shared_path, store, table

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Bytes of a file whose chain one task contracts.
BLOCK_BYTES = 4 << 20
#: Digits of a record's length; longer ones could not be added to an offset.
LENGTH_DIGITS = 18
#: Revisits, splits or blocks of interrupted records that may be broadcast (a few numbers and a path or digest each).
BROADCAST_ROWS = 100_000


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters and a percent sign are percent-encoded."""
    return "".join(c if ord(c) > 32 and c != "%" and ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _unline(value: bytes) -> str:
    out, at = bytearray(), 0
    while at < len(value):
        if value[at:at + 1] == b"%":
            out.append(int(value[at + 1:at + 3], 16))
            at += 3
        else:
            out.append(value[at])
            at += 1
    return out.decode("utf-8", "replace")


def _record_id(digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record without the separator after it."""
    digest = _digest(payload)
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body += payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(digest, page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(digest, refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return MAGIC + "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + END + body


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as archives.  Null html is an empty
    payload.  Pages whose payload has ``min_bytes`` at least and equals that of
    a larger id are revisits; null ids are always written whole."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sums = pages.where("page_id IS NOT NULL").select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    last = sums.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = store(sums.join(last, ["sha", "n"]).where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct(), "revisits")
    revisits = _small(revisits)
    # an id may be repeated with other html, so the payload is part of the key
    joined = pages.join(revisits, (pages["page_id"] == revisits["page_id"]) & (F.sha1(pages["html"]) == revisits["sha"]), "left")
    ready = joined.select(pages["page_id"], "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4_000_000):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([make_record(p, u, h.encode("utf-8", "surrogatepass"), r) for p, u, h, r in rows], pa.binary())], ["record"])

    ready.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path, lineSep=END.decode())


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, raw): what lies between occurrences of the magic, in file order within each split."""
    text = spark.read.option("pathGlobFilter", "part-*").text(path, lineSep=MAGIC.decode())
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("raw"))


def _header(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and where the block begins, if ``raw`` begins with a record's header."""
    end = raw.find(END)
    if end < 0:
        return None
    fields = dict(x.split(b": ", 1) for x in raw[:end].split(b"\r\n") if b": " in x)
    size = fields.get(b"Content-Length", b"")
    return (fields, end + 4) if size.isdigit() and len(size) <= LENGTH_DIGITS else None


def _long(value: bytes) -> int:
    number = int(value)
    if not -(2**63) <= number < 2**63:
        raise ValueError(f"{number} has more than 64 bits")
    return number


def _parse(fields: dict[bytes, bytes], body: bytes) -> tuple:
    """(page_id, url, type, digest, payload bytes, refers_to, payload) of a whole record."""
    end = body.find(END)
    http, payload = body[:end], body[end + 4:]
    number = lambda k: _long(fields[k]) if k in fields else None
    kind = fields.get(b"WARC-Type", b"").decode()
    if kind == "revisit":
        declared = dict(x.split(b": ", 1) for x in http.split(b"\r\n") if b": " in x)
        size, digest, payload = _long(declared[b"Content-Length"]), fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), None
    else:
        size, digest = len(payload), _digest(payload)
    url = _unline(fields[b"WARC-Target-URI"]) if b"WARC-Target-URI" in fields else None
    return number(b"X-Page-ID"), url, kind, digest, size, number(b"X-Refers-To-Page-ID"), payload


_FIELDS = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("successor", pa.int64()), ("whole", pa.bool_()),
    ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])


def _split_starts(spark: SparkSession, path: str) -> DataFrame:
    """Where in its file each split's first segment begins: the splits before it
    add up to that.  ``end`` is a magic's length after the file's end."""
    sums = _segments(spark, path).groupBy("file", "split").agg(F.sum(F.octet_length("raw") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    end = F.sum("size").over(Window.partitionBy("file")).alias("end")
    return store(sums.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), end), "warc_splits")


def _located(segments: DataFrame, run, ddl: str, starts: DataFrame) -> DataFrame:
    """Apply ``run`` (rows with ``at``, relative to the split) and add each split's ``start``."""
    joined = segments.mapInArrow(run, ddl).join(_small(starts), ["file", "split"], "left")
    # the two scans must cut the files alike; fail rather than lose a split
    known = F.when(F.col("start").isNull(), F.raise_error("the files' splits have changed between two scans; read again")).otherwise(F.col("start"))
    return joined.withColumn("start", known)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if distinct_count_at_most(df, BROADCAST_ROWS) else df


def candidates(spark: SparkSession, path: str, payloads: bool, starts: DataFrame) -> DataFrame:
    """Every occurrence of the magic that a header of a record follows, which ends
    within the file.  Payloads hold such too, so what cannot be parsed is told in
    ``error``, for the chain to decide whether it matters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in pieces(batches, "raw", 4_000_000):
            rows = []
            for file, split, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (file, split) != now:
                    now, at = (file, split), 0
                raw = raw.as_py()
                head = _header(raw)
                # what comes before a file's first magic is no record; other splits begin after a magic
                if head and (at or split):
                    fields, begin = head
                    size = int(fields[b"Content-Length"])
                    whole = raw[begin + size:begin + size + 4] == END
                    parsed, error = (None,) * 7, None
                    if whole:
                        try:
                            parsed = _parse(fields, raw[begin:begin + size])
                        except (KeyError, ValueError) as e:
                            error = f"{type(e).__name__}: {e}"
                    rows.append((file, split, at - len(MAGIC), at + begin + size + 4, whole, *parsed[:6], parsed[6] if payloads else None, error))
                at += len(raw) + len(MAGIC)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FIELDS.types)], schema=_FIELDS)

    found = _located(_segments(spark, path), run, "file string, split long, at long, successor long, whole boolean, page_id long, url string, type string, digest string, bytes long, refers_to long, payload binary, error string", starts)
    inside = F.col("start") + F.col("successor") - len(END) <= F.col("end") - len(MAGIC)
    return found.where(F.coalesce(inside, F.lit(True))).select("file", (F.col("start") + F.col("at")).alias("at"), (F.col("start") + F.col("successor")).alias("successor"), "whole", "page_id", "url", "type", "digest", "bytes", "refers_to", "payload", "error")


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, [(at, successor)], last column of the first row)."""
    key, held, extra = None, [], None
    for batch in batches:
        for file, block, at, successor, *more in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if held:
                    yield *key, held, extra
                key, held, extra = (file, block), [], (more or [None])[0]
            held.append((at, successor))
    if held:
        yield *key, held, extra


def reachable(found: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, at) of the records on the chain that begins at byte 0 of each file."""
    links = found.select("file", F.floor(F.col("at") / block_bytes).alias("block"), "at", "successor")

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, rows, _ in _sorted_groups(batches):
            leaves: dict[int, int] = {}
            for at, successor in reversed(rows):
                leaves[at] = leaves.get(successor, successor)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(leaves)), pa.array(leaves, pa.int64()), pa.array(leaves.values(), pa.int64())], ["file", "at", "leaves"])

    dealt = links.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    jumps = store(dealt.mapInArrow(contract, "file string, at long, leaves long"), "warc_jumps")
    entries = jumps.where("at = 0").select("file", "at")
    blocks = found.agg(F.max("successor")).first()[0] or 0
    for _ in range(math.ceil(math.log2(blocks / block_bytes + 1)) + 1 if blocks > block_bytes else 0):
        # entries reach twice as far with every round, and so do the jumps
        entries = store(entries.union(entries.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))).distinct(), "warc_entries")
        onward = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("next"))
        jumps = store(jumps.join(onward, ["file", "leaves"]).select("file", "at", F.col("next").alias("leaves")), "warc_jumps")
    # the chain enters a block once
    enter = entries.select("file", F.floor(F.col("at") / block_bytes).alias("block"), "at").groupBy("file", "block").agg(F.min("at").alias("entry"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, rows, entry in _sorted_groups(batches):
            go, at, on = dict(rows), entry, []
            while at in go:
                on.append(at)
                at = go[at]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(on), pa.string()), pa.array(on, pa.int64())], ["file", "at"])

    entered = links.join(enter, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    return entered.mapInArrow(walk, "file string, at long")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of the archives under ``path``: file, at, page_id, url, type,
    digest, bytes, refers_to and, if asked for, payload (null for revisits).  A chain ends where
    no record begins (the end of the file, or damage); empty archives give no rows."""
    starts = _split_starts(spark, path)
    found = candidates(spark, path, payloads, starts)
    chain = store(found.select("file", "at", "successor", "whole"), "warc_links")
    real = store(chain.join(reachable(chain, block_bytes), ["file", "at"]).where("successor > at"), "warc_records")
    whole = found.join(real.where("whole").select("file", "at", F.col("successor").alias("kept")), ["file", "at"])
    # both sides are asked, so that this cannot move before the join
    broken = F.col("error").isNotNull() & (F.col("kept") > F.col("at"))
    fail = F.raise_error(F.concat(F.lit("not a record of this format at byte "), F.col("at"), F.lit(" of "), F.col("file"), F.lit(": "), F.col("error")))
    whole = whole.withColumns({x: F.when(broken, fail).otherwise(F.col(x)) for x in ("page_id", "url", "type", "digest", "bytes", "refers_to", "payload")})
    rest = _assembled(spark, path, real.where("not whole").select("file", "at", "successor"), block_bytes, starts)
    return whole.select(rest.columns).unionByName(rest).select("file", "at", "page_id", "url", "type", "digest", "bytes", "refers_to", *["payload"] * payloads)


def _assembled(spark: SparkSession, path: str, records: DataFrame, block_bytes: int, starts: DataFrame) -> DataFrame:
    """Records that other candidates or split borders interrupt, from their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in pieces(batches, "raw", 4_000_000):
            out = []
            for file, split, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, split) != now:
                    now, at = (file, split), 0
                out.append((file, split, at - len(MAGIC), raw))
                at += len(raw) + len(MAGIC)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "split", "at", "raw"])

    parts = _located(_segments(spark, path), run, "file string, split long, at long, raw binary", starts).select("file", (F.col("start") + F.col("at")).alias("piece_at"), "raw")
    parts = parts.withColumn("block", F.floor(F.col("piece_at") / block_bytes))
    spans = records.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_bytes), F.floor(F.col("successor") / block_bytes))))
    # few records hold a magic or cross a split, and only their pieces are wanted
    inside = parts.join(_small(store(spans, "warc_spans")), ["file", "block"]).where("piece_at >= at AND piece_at < successor")
    joined = inside.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("piece_at", "raw"))).alias("pieces"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = MAGIC.join(p["raw"] for p in held.as_py())
                fields, begin = _header(raw)
                row = (file, at, *_parse(fields, raw[begin:begin + int(fields[b"Content-Length"])]))
                yield pa.RecordBatch.from_arrays([pa.array([v], _FIELDS.field(n).type) for n, v in zip(names, row)], names)

    names = ["file", "at", "page_id", "url", "type", "digest", "bytes", "refers_to", "payload"]
    return joined.mapInArrow(parse, "file string, at long, page_id long, url string, type string, digest string, bytes long, refers_to long, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page written and read back."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path, payloads=False)
    return records.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
