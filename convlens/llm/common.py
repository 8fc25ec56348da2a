"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.session import ensure_checkpoint_dir

#: Folder of the public tokenizer files when the caller names none.
TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/convlens-llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_count_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows (counted exactly; the guard in front of a broadcast)."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"] <= bound


def text_key(text: Column) -> Column:
    """20 bytes that stand for a text: its crc32, which orders them, and 128 bits of a hash."""
    return F.unhex(F.concat(F.lpad(F.hex(F.crc32(text)), 8, "0"), F.md5(text)))


#: What operators keep in a Python worker between tasks (tokenizers and their word caches).
WORKER: dict = {}


def forget() -> None:
    """Drop what earlier operators keep in this worker and give free memory
    back; workers are reused by the next stages of a pipeline."""
    if WORKER:
        WORKER.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # glibc keeps freed arenas


def carried(df: DataFrame, *taken: str) -> tuple[Column, Callable[[str], list[Column]]]:
    """All columns of ``df`` but ``taken`` as one struct whose fields are numbered, so
    that no name can clash with an operator's own, and what takes them out again
    of the struct column of the given name."""
    names = [c for c in df.columns if c not in taken]
    packed = F.struct(F.lit(0).alias("c"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)])
    return packed, lambda column: [F.col(column)[f"c{i}"].alias(c) for i, c in enumerate(names)]


def pieces(batches: Iterator[pa.RecordBatch], column: str, at_most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow's batches hold a fixed number of rows, however long; cut them so
    that a piece holds about ``at_most`` bytes (or list entries) of ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        lengths = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
        part = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // at_most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
