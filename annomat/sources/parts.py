"""Sorted tables as raw streams: executors write pieces of them to the shared folder, and the driver joins files.

A piece is one partition of a range-sorted table. Each attempt of a task writes files of its own and only those of attempts
that ended are named to the driver, so lost executors leave nothing behind but files that are removed with the folder. The
driver holds a row for each piece and a block of bytes.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat.errors import InvalidFormatError
from annomat.functions import bitpack
from annomat.functions.casts import spark_type, to_dtype
from annomat.operators.layout import ordered
from annomat.shared import mounted_folder

#: Bytes that the driver moves at once, and entries that a task packs.
BLOCK, PACKED_ENTRIES = 8 << 20, 1 << 20


@dataclass(frozen=True)
class Piece:
    """Files ``{stem}.{stream}`` of the rows with keys ``first`` to ``last``, and whether these came in order."""

    stem: str
    rows: int
    first: int
    last: int
    ascending: bool


def _ascends(batch: pa.RecordBatch, by: int, before: list[int] | None) -> bool:
    """Whether the first ``by`` columns, one or two, never fall, nor below those of the row before the batch."""
    major, minor = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, by - 1))
    if before is not None and [major[0], minor[0]][:by] < before:
        return False
    return not np.any((major[1:] < major[:-1]) | (major[1:] == major[:-1]) & (minor[1:] < minor[:-1]))


class Pieces:
    """A folder of pieces in order, removed at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.pieces = spark, []
        self.folder = f"{mounted_folder(spark)}/parts-{uuid.uuid4().hex}"
        os.makedirs(self.folder)

    def __enter__(self) -> Pieces:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def sorted(self, rows: DataFrame, encode: Callable[[pa.RecordBatch], dict[str, bytes]], by: int = 1, in_order: bool = False) -> Pieces:
        """:meth:`spill` in the order of the first ``by`` columns. Rows said to be ``in_order`` are taken as they come, without a sort or a
        shuffle, unless they turn out not to be.
        """
        if in_order:
            kept = self.spill(rows, encode, by).pieces
            if all(p.ascending for p in kept) and all(p.last < q.first for p, q in zip(kept, kept[1:])):
                return self
            for name in os.listdir(self.folder):
                os.remove(f"{self.folder}/{name}")
        return self.spill(ordered(rows, rows.columns[0], rows.columns[by - 1]), encode, by)

    def spill(self, rows: DataFrame, encode: Callable[[pa.RecordBatch], dict[str, bytes]], by: int = 1) -> Pieces:
        """One pass over ``rows``, as they come, whose first column is the key: each batch adds to the streams of its piece."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            stem, files = f"{folder}/{part}-{uuid.uuid4().hex}", {}
            n = first = last = 0
            ascending, before = True, None
            try:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    ascending, before = ascending and _ascends(batch, by, before), [batch.column(k)[-1].as_py() for k in range(by)]
                    first = batch.column(0)[0].as_py() if not n else first
                    last = before[0]
                    n += batch.num_rows
                    for name, raw in encode(batch).items():
                        if name not in files:
                            files[name] = open(f"{stem}.{name}", "wb")
                        files[name].write(raw)
            finally:
                for f in files.values():
                    f.close()
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "stem": [stem], "rows": pa.array([n], pa.int64()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "ascending": [ascending]})

        try:
            found = rows.mapInArrow(run, "part long, stem string, rows long, first long, last long, ascending boolean").where("rows > 0").collect()
        except BaseException:
            self.__exit__()
            raise
        self.pieces = [Piece(r["stem"], r["rows"], r["first"], r["last"], r["ascending"]) for r in sorted(found, key=lambda r: r["part"])]
        return self

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.pieces)

    def stream(self, name: str) -> Iterator[bytes]:
        """The bytes of a stream over all pieces, some at a time."""
        for p in self.pieces:
            with open(f"{p.stem}.{name}", "rb") as f:
                while block := f.read(BLOCK):
                    yield block

    def whole(self, name: str) -> bytes:
        return b"".join(self.stream(name))

    def texts(self, name: str) -> Iterator[tuple[np.ndarray, bytes]]:
        """Sizes and bytes of the strings of a stream written by :func:`counted`, some at a time."""
        for p in self.pieces:
            with open(f"{p.stem}.{name}", "rb") as f:
                while head := f.read(8):
                    size = np.frombuffer(f.read(4 * int.from_bytes(head, "little")), "<u4").astype(np.int64)
                    yield size, f.read(int(size.sum()))


def counted(column: pa.Array) -> bytes:
    """A batch of strings, none null, with their sizes before them."""
    own = column.cast(pa.large_string())
    at = np.frombuffer(own.buffers()[1], "<i8")[own.offset : own.offset + len(own) + 1]
    raw = memoryview(own.buffers()[2] or b"")[int(at[0]) : int(at[-1])]
    return len(own).to_bytes(8, "little") + np.diff(at).astype("<u4").tobytes() + bytes(raw)


def numbers(column: pa.Array, kind: str) -> bytes:
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(kind).tobytes()


def ahead(jobs: list[Callable[[], Any]]) -> Generator[Any, None, None]:
    """The results of jobs, in turn."""
    for job in jobs:
        yield job()


def vectors(df: DataFrame, in_order: bool = False) -> tuple[Pieces, int]:
    """The pieces of a table of row vectors, stream ``vec``, and how long these are."""
    own = df.select(F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<double>").alias("vec"))
    rows = Pieces(df.sparkSession).sorted(own, lambda batch: {"vec": numbers(batch.column(1).flatten(), "<f8")}, in_order=in_order)
    sizes = [os.path.getsize(f"{p.stem}.vec") // 8 for p in rows.pieces]
    width = sizes[0] // rows.pieces[0].rows if sizes else 0
    if any(size != p.rows * width for size, p in zip(sizes, rows.pieces, strict=True)):
        rows.__exit__()
        raise InvalidFormatError("row vectors differ in length")
    return rows, width


class SparseRows(Pieces):
    """A sparse matrix in row order: streams ``data`` and ``index``, and for each row met its number and entries in ``count``."""

    def __init__(self, x: DataFrame, n: int, dtype: str, kind: str, names: tuple[str, str] = ("obs_idx", "var_idx"), in_order: bool = False):
        super().__init__(x.sparkSession)
        self.n, self.kind = n, kind

        def encode(batch: pa.RecordBatch) -> dict[str, bytes]:
            row, count = np.unique(batch.column(0).to_numpy(), return_counts=True)
            return {"data": numbers(batch.column(2), kind), "index": numbers(batch.column(1), "<u4"), "count": np.stack([row, count], axis=1).astype("<i8").tobytes()}

        missing = F.lit(float("nan") if kind[1] == "f" else 0).cast(spark_type(dtype))  # a stored matrix has no nulls
        cast = x.select(F.col(names[0]).cast("long").alias(names[0]), names[1], F.coalesce(to_dtype(F.col("value"), dtype), missing).alias("value"))
        self.sorted(cast, encode, 2, in_order)

    def pointers(self) -> Iterator[np.ndarray]:
        """Row pointers, n + 1 of them, some at a time; rows without entries repeat theirs."""
        total, row = 0, 0  # the next row whose end is still to come
        yield np.zeros(1, np.int64)

        def same(stop: int) -> Iterator[np.ndarray]:
            for at in range(row, stop, BLOCK // 8):
                yield np.full(min(BLOCK // 8, stop - at), total, np.int64)

        for p in self.pieces:
            yield from same(p.first)
            pairs = np.fromfile(f"{p.stem}.count", "<i8").reshape(-1, 2)
            ends = total + np.cumsum(np.bincount(pairs[:, 0] - p.first, pairs[:, 1], p.last - p.first + 1)).astype(np.int64)
            yield ends
            total, row = int(ends[-1]), p.last + 1
        yield from same(self.n)

    def entries(self) -> Callable[[str, int, int], np.ndarray]:
        """A function that reads entries [a, b) of ``data`` or ``index``, to be sent to tasks."""
        stems = [p.stem for p in self.pieces]
        ends = np.cumsum([p.rows for p in self.pieces]) if stems else np.empty(0, np.int64)
        kinds = {"data": self.kind, "index": "<u4"}

        def read(name: str, a: int, b: int) -> np.ndarray:
            out = []
            for k in range(int(np.searchsorted(ends, a, "right")), len(stems)):
                start = int(ends[k - 1]) if k else 0
                if start >= b:
                    break
                size = np.dtype(kinds[name]).itemsize
                s, e = max(a, start) - start, min(b, int(ends[k])) - start
                out.append(np.fromfile(f"{stems[k]}.{name}", kinds[name], e - s, offset=s * size))
            return np.concatenate(out) if out else np.empty(0, kinds[name])

        return read

    def packed(self, integers: bool) -> Pieces:
        """The streams of a bit-packed matrix, as pieces of whole chunks: ``index``, ``starts``, ``widths`` and for integers ``val``, ``val_widths``."""
        read, nnz, step = self.entries(), self.rows, PACKED_ENTRIES
        out = Pieces(self.spark)

        def encode(batch: pa.RecordBatch) -> dict[str, bytes]:
            streams: dict[str, list[bytes]] = {}
            for k in batch.column(0).to_pylist():
                a, b = k * step, min(nnz, (k + 1) * step)
                before = int(read("index", a - 1, a)[0]) if a else 0
                words, begin, starts = bitpack.encode_d1z(read("index", a, b), before)
                own = {"index": words.astype("<u4"), "starts": starts.astype("<u4"), "widths": np.diff(begin).astype("<u2")}
                if integers:
                    words, begin = bitpack.encode_frame(read("data", a, b))
                    own |= {"val": words.astype("<u4"), "val_widths": np.diff(begin).astype("<u2")}
                for name, v in own.items():
                    streams.setdefault(name, []).append(v.tobytes())
            return {name: b"".join(v) for name, v in streams.items()}

        tasks = -(-nnz // step)
        return out.spill(self.spark.range(0, tasks, numPartitions=max(1, tasks)), encode)


def offsets(pieces: Pieces, name: str) -> tuple[Iterator[np.ndarray], np.ndarray, int]:
    """Where chunks begin, modulo 2**32, from their widths; the chunks before each wrap, from 0 on; and how many offsets there are."""
    turns, total, chunks = [0], 0, 0
    for block in pieces.stream(name):
        ends = total + np.cumsum(np.frombuffer(block, "<u2").astype(np.int64))
        for turn in range((total >> 32) + 1, (int(ends[-1]) >> 32) + 1):
            turns.append(chunks + 1 + int(np.searchsorted(ends, turn << 32)))
        total, chunks = int(ends[-1]), chunks + len(ends)
    size = chunks + 1

    def begins() -> Iterator[np.ndarray]:
        done = 0
        yield np.zeros(1, "<u4")
        for block in pieces.stream(name):
            ends = done + np.cumsum(np.frombuffer(block, "<u2").astype(np.int64))
            done = int(ends[-1])
            yield (ends & 0xFFFFFFFF).astype("<u4")

    return begins(), np.array([*turns, size], "<u8"), size
