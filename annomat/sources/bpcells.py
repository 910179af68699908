"""Directories of bit-packed sparse matrices: each task decodes the chunks of its own rows only.

Binary files have an 8-byte tag and a little-endian body. ``col`` order means that the columns are the observations.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from annomat.errors import InvalidFormatError, MissingFieldError, UnsupportedVersionError
from annomat.functions import bitpack
from annomat.functions.casts import spark_type
from annomat.model import AnnotatedMatrix
from annomat.sources.chunks import CHUNK_SIZE, Lines, RangeReader, Rows, chosen, lines, option, pushdown, triples
from annomat.sources.parts import Pieces, SparseRows, offsets

# Tags, version strings and file names are fixed by the format.
_TAGS = {b"UINT32v1": "<u4", b"UINT64v1": "<u8", b"FLOATSv1": "<f4", b"DOUBLEv1": "<f8"}
_TAG_OF = {v: k for k, v in _TAGS.items()}
_VERSIONS = {
    "packed-uint-matrix-v2": (True, "u32"), "packed-float-matrix-v2": (True, "f32"), "packed-double-matrix-v2": (True, "f64"),
    "unpacked-uint-matrix-v2": (False, "u32"), "unpacked-float-matrix-v2": (False, "f32"), "unpacked-double-matrix-v2": (False, "f64"),
}
_BODY = {"u32": "<u4", "f32": "<f4", "f64": "<f8"}


def array(path: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Entries [start, stop) of a tagged file; only they are read."""
    with open(path, "rb") as f:
        tag = f.read(8)
        if tag not in _TAGS:
            raise InvalidFormatError(f"unknown tag {tag!r} in {path}")
        kind = np.dtype(_TAGS[tag])
        f.seek(8 + start * kind.itemsize)
        body = f.read() if stop is None else f.read((stop - start) * kind.itemsize)
    if len(body) % kind.itemsize or stop is not None and len(body) < (stop - start) * kind.itemsize:
        raise InvalidFormatError(f"{path} is cut short")
    return np.frombuffer(body, kind)


class Directory:
    """The small files of a directory: everything but the entries."""

    def __init__(self, path: str):
        self.path = path
        text = {}
        for name in ("version", "storage_order"):
            if not os.path.exists(f"{path}/{name}"):
                raise MissingFieldError(f"{path}/{name}")
            with open(f"{path}/{name}", encoding="utf-8") as f:
                text[name] = f.read().strip()
        if text["version"] not in _VERSIONS:
            raise UnsupportedVersionError(text["version"])
        if text["storage_order"] not in ("col", "row"):
            raise InvalidFormatError(f"unknown storage order {text['storage_order']!r}")
        self.packed, self.dtype = _VERSIONS[text["version"]]
        rows, cols = array(f"{path}/shape").tolist()
        by_col = text["storage_order"] == "col"
        self.n_obs, self.n_vars = (cols, rows) if by_col else (rows, cols)
        self.obs_file, self.var_file = (f"{path}/{x}_names" for x in (("col", "row") if by_col else ("row", "col")))

    def _begins(self, name: str, a: int, b: int) -> np.ndarray:
        """Word offsets of chunks [a, b]; where the 32-bit offsets wrap is listed in the offsets file."""
        low = array(f"{self.path}/{name}_idx", a, b + 1).astype(np.int64)
        turns = array(f"{self.path}/{name}_idx_offsets") if os.path.exists(f"{self.path}/{name}_idx_offsets") else np.empty(0, np.uint64)
        wraps = np.searchsorted(turns[1:-1].astype(np.int64), np.arange(a, b + 1), "right") if len(turns) > 2 else 0
        return low + (wraps << 32)

    def rows(self, start: int, stop: int) -> pa.RecordBatch:
        """Observations [start, stop) as triples."""
        if not 0 <= start <= stop <= self.n_obs:
            raise InvalidFormatError(f"rows {start} to {stop} are outside 0 to {self.n_obs}")
        ptr = array(f"{self.path}/idxptr", start, stop + 1).astype(np.int64)
        a, b = int(ptr[0]), int(ptr[-1])
        first, last = a // bitpack.CHUNK, -(-b // bitpack.CHUNK)
        cut = slice(a - first * bitpack.CHUNK, b - first * bitpack.CHUNK)
        if b == a:
            return triples(start, ptr, np.empty(0, np.int64), np.empty(0, _BODY[self.dtype]), self.dtype)
        if self.packed:
            begin = self._begins("index", first, last)
            words = array(f"{self.path}/index_data", int(begin[0]), int(begin[-1]))
            index = bitpack.decode_d1z(words, begin - begin[0], array(f"{self.path}/index_starts", first, last))[cut]
        else:
            index = array(f"{self.path}/index", a, b)
        if self.packed and self.dtype == "u32":
            begin = self._begins("val", first, last)
            value = bitpack.decode_frame(array(f"{self.path}/val_data", int(begin[0]), int(begin[-1])), begin - begin[0])[cut]
        else:
            value = array(f"{self.path}/val", a, b)
        return triples(start, ptr, index, value, self.dtype)


class BpcellsSource(DataSource):
    """``spark.read.format("bpcells").option("slot", "X" | "obs" | "var").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bpcells"

    def schema(self) -> str:
        slot = option(self.options, "slot", "X")
        if slot == "X":
            return f"obs_idx bigint, var_idx bigint, value {spark_type(Directory(self.options['path']).dtype)}"
        if slot in ("obs", "var"):
            return f"{slot}_idx bigint, {slot}_id string"
        raise InvalidFormatError(f"no slot {slot!r} in this format")

    def reader(self, schema) -> DataSourceReader:
        return chosen(_Reader(self.options["path"], option(self.options, "slot", "X"), option(self.options, "chunk_size", CHUNK_SIZE)), self.options)


class _Reader(RangeReader):
    def __init__(self, path: str, slot: str, chunk: int):
        self.found, self.slot = Directory(path), slot
        super().__init__(self.found.n_vars if slot == "var" else self.found.n_obs, chunk, "var_idx" if slot == "var" else "obs_idx")
        file = {"obs": self.found.obs_file, "var": self.found.var_file}.get(slot)
        self.names = Lines(file, chunk, blank=False) if file and os.path.exists(file) else None
        if self.names and self.names.n:
            self.stop = self.names.n

    def rows_of(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if self.slot == "X":
            yield self.found.rows(partition.start, partition.stop)
        else:
            own = self.names.read(partition.start, partition.stop) if self.names and self.names.n else [str(i) for i in range(partition.start, partition.stop)]
            yield pa.RecordBatch.from_arrays([pa.array(range(partition.start, partition.start + len(own)), pa.int64()), pa.array(own, pa.string())], names=[f"{self.slot}_idx", f"{self.slot}_id"])


def read(spark: SparkSession, path: str, chunk_size: int = CHUNK_SIZE, **_: Any) -> AnnotatedMatrix:
    """The matrix of a directory; only its header files are read here. Layouts other than X, obs and var are empty."""
    spark.dataSource.register(BpcellsSource)
    head = Directory(path)
    load = lambda slot: spark.read.format("bpcells").option("slot", slot).option("chunk_size", chunk_size).option("pushdown", pushdown(spark)).load(path)
    return AnnotatedMatrix(spark, head.n_obs, head.n_vars, head.dtype, load("X"), load("obs"), load("var"), format="bpcells", in_order=True)


def stored_dtype(dtype: str) -> str:
    """The layout has no signed integers; they are cast to unsigned ones, saturating."""
    return "u32" if dtype == "i32" else dtype


def write(data: AnnotatedMatrix, path: str, packed: bool = True, **_: Any) -> str:
    """X as a directory in column order; of the tables only the ids are kept. Executors sort, encode and write; files are joined here."""
    dtype = stored_dtype(data.dtype)
    integers = dtype == "u32"
    os.makedirs(path, exist_ok=True)

    def put(name: str, blocks: Iterable[np.ndarray | bytes], kind: str) -> None:
        with open(f"{path}/{name}", "wb") as f:
            f.write(_TAG_OF[kind])
            for block in blocks:
                f.write(block if isinstance(block, bytes) else block.astype(kind).tobytes())

    with SparseRows(data.x, data.n_obs, dtype, _BODY[dtype], in_order=data.in_order) as rows:
        put("idxptr", rows.pointers(), "<u8")
        if not (packed and integers):
            put("val", rows.stream("data"), _BODY[dtype])
        if packed:
            with rows.packed(integers) as chunks:
                put("index_starts", chunks.stream("starts"), "<u4")
                for stem, widths in (("index", "widths"), *((("val", "val_widths"),) if integers else ())):
                    put(f"{stem}_data", chunks.stream(stem), "<u4")
                    begins, turns, _ = offsets(chunks, widths)
                    put(f"{stem}_idx", begins, "<u4")
                    put(f"{stem}_idx_offsets", [turns], "<u8")
        else:
            put("index", rows.stream("index"), "<u4")
    put("shape", [np.array([data.n_vars, data.n_obs])], "<u4")
    for file, df, axis_name in (("col_names", data.obs, "obs"), ("row_names", data.var, "var")):
        with Pieces(data.spark) as ids, open(f"{path}/{file}", "wb") as f:
            for block in ids.sorted(df.select(f"{axis_name}_idx", f"{axis_name}_id"), lambda batch: {"id": lines(batch.column(1), "ids", blank=False)}, in_order=data.in_order).stream("id"):
                f.write(block)
    kind = {"u32": "uint", "f32": "float", "f64": "double"}[dtype]
    for name, text in (("storage_order", "col"), ("version", f"{'packed' if packed else 'unpacked'}-{kind}-matrix-v2")):
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return path
