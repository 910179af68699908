"""What the operators share: tables, checkpoints, Arrow batches cut to a bounded size."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat.shared import checkpoint as checkpoint
from annomat.shared import shared_folder as shared_folder

#: Characters outside blocks whose letters and digits have long been settled, and two inside that came late; Unicode versions
#: may class these differently. All other characters were tried one by one against the tokenizers library.
RARE = re.compile("[^\x00-\u024f\u0370-\u052f\u0590-\u06ff\u0900-\u0c5b\u0c5d-\u0cdb\u0cdd-\u0dff\u0e00-\u0e7f\u1e00-\u206f\u20a0-\u20bf\u2100-\u23ff\u2500-\u27bf\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]")
#: Bits of the filter through which texts are picked before a join: 8 MB at every size.
SIFT_BITS = 1 << 26
#: UTF-8 bytes of text that one numpy pass works on at a time.
BLOCK_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session to hand texts to tasks 1,000 at a time: ten times as many take more memory than the work on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column, for the number of buckets that a shuffle of it needs."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


def small(df: DataFrame, rows: int) -> DataFrame | None:
    """``df``, marked to be copied to every executor, if it has at most ``rows`` rows; else None. ``df`` should be a checkpoint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 byte strings, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with the texts as bytes; each holds ``limit`` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, end - at), as_bytes(column.slice(at, end - at))
            at = end


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task ``run``, giving free memory back at its end: workers are used again and their heaps would add up."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def longs(column: pa.Array, null: int = (1 << 63) - 1) -> np.ndarray:
    """An integer column as int64 with nulls replaced."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def starts_of_runs(values: np.ndarray) -> np.ndarray:
    """Positions at which a value differs from the one before; the first position counts."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _places(ids: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each id."""
    h = ids.astype(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append((x ^ (x >> np.uint64(29))) & np.uint64(SIFT_BITS - 1))
    return np.stack(out).astype(np.int64)


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose doc_id is in ``ids`` (doc_id).

    Only texts that pass a Bloom filter of the ids are shuffled for the join. The filter has a fixed size; with more ids than
    it is made for it lets more texts pass, and the join still decides.
    """

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(longs(batch.column(0))))
            word = at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(at) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.record_batch({"word": word[first], "bits": bits.view(np.int64)})

    words = ids.select("doc_id").mapInArrow(frugal(set_bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(SIFT_BITS >> 6, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(longs(batch.column(0)))
            hit = ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
            yield batch.filter(pa.array(hit))

    return docs.select("doc_id", "text").mapInArrow(frugal(sift), "doc_id long, text string").join(ids, "doc_id", "left_semi")
