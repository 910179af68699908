"""What the file sources share: row ranges as partitions, range filters pushed to them, Arrow batches of triples."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from annomat.errors import InvalidFormatError

#: Rows in a partition unless the option ``chunk_size`` says otherwise; bytes of a text file looked through at once.
CHUNK_SIZE, _BLOCK = 5000, 16 << 20
#: Entries that a task reads, several chunks one after the other, once there are chunks for so many tasks.
TASK_ENTRIES, TASKS = 1 << 20, 16
ARROW = {"f32": pa.float32(), "f64": pa.float64(), "i32": pa.int32(), "u32": pa.int64()}


class Rows(InputPartition):
    """Rows [start, stop)."""

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class RangeReader(DataSourceReader):
    """Partitions of a chunk of rows each, of many chunks partitions of several; ``rows_of`` yields what the rows of a chunk hold, ``each`` entries a row."""

    def __init__(self, n: int, chunk: int, column: str | None, each: float = 1.0):
        if chunk < 1:
            raise ValueError("chunk_size must be at least 1")
        self.start, self.stop, self.chunk, self.column, self.each = 0, n, chunk, column, each

    def partitions(self) -> list[InputPartition]:
        chunks = -(-(self.stop - self.start) // self.chunk)
        step = self.chunk * max(1, min(chunks // TASKS, int(TASK_ENTRIES / (self.chunk * max(self.each, 1.0)))))
        return [Rows(a, min(a + step, self.stop)) for a in range(self.start, self.stop, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for a in range(partition.start, partition.stop, self.chunk):
            yield from self.rows_of(Rows(a, min(a + self.chunk, partition.stop)))

    def pushing(self) -> DataSourceReader:
        """The same reader taking filters; Spark allows that only where ``spark.sql.python.filterPushdown.enabled`` is set."""
        return _Pushing(self)


class _Pushing(DataSourceReader):
    """Comparisons of the row column with constants narrow the rows that are read; other filters stay with Spark."""

    def __init__(self, inner: RangeReader):
        self.inner = inner

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        r = self.inner
        for f in filters:
            value = getattr(f, "value", None)
            if not (r.column and getattr(f, "attribute", None) == (r.column,) and isinstance(value, int)):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                r.start = max(r.start, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                r.stop = min(r.stop, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.inner.partitions()

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)


class Lines:
    """A text file of names, one a line, of which ranges are read: one pass finds where every ``each``-th line begins.

    Without ``blank``, empty lines don't count. Lines end with a line feed, before which a carriage return is dropped.
    """

    def __init__(self, path: str, each: int, blank: bool = True):
        self.path, self.each, self.blank, self.n = path, each, blank, 0
        begins, at = [], 0
        with open(path, "rb") as f:
            left = b""
            while block := f.read(_BLOCK):
                raw = np.frombuffer(left + block, np.uint8)
                stops = np.flatnonzero(raw == 10)
                starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
                if not blank and len(stops):
                    size = stops - starts - (raw[np.maximum(stops - 1, 0)] == 13)
                    starts = starts[size > 0]
                first = -self.n % each
                begins.append(at + starts[first::each])
                self.n += len(starts)
                cut = int(stops[-1]) + 1 if len(stops) else 0
                left = (left + block)[cut:]
                at += cut
            if left.rstrip(b"\r") or blank and left:  # a last line without its end
                if self.n % each == 0:
                    begins.append(np.array([at]))
                self.n += 1
        self.begins = np.concatenate(begins).astype(np.int64) if begins else np.empty(0, np.int64)

    def read(self, start: int, stop: int) -> list[str]:
        """Lines [start, stop), as far as there are any."""
        out: list[str] = []
        if start >= self.n:
            return out
        skip = start % self.each
        with open(self.path, "rb") as f:
            f.seek(int(self.begins[start // self.each]))
            for raw in f:
                text = raw.removesuffix(b"\n").removesuffix(b"\r")
                if not text and not self.blank:
                    continue
                if skip:
                    skip -= 1
                    continue
                if len(out) == stop - start:
                    break
                out.append(text.decode())
        return out


def lines(column: pa.Array, what: str, blank: bool = True) -> bytes:
    """Strings, none null, one a line; one with a line break, or an empty one where none may be, is an error."""
    own = column.to_pylist()
    if any("\n" in x for x in own) or not blank and not all(own):
        raise InvalidFormatError(f"one of the {what} is empty or has a line break")
    return "".join(f"{x}\n" for x in own).encode()


def pushdown(spark: Any) -> str:
    """The value of the option ``pushdown`` that fits the session."""
    return spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")


def chosen(reader: RangeReader, options: dict[str, Any]) -> DataSourceReader:
    return reader.pushing() if str(option(options, "pushdown", "false")).lower() == "true" else reader


def triples(start: int, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, dtype: str, names: tuple[str, str] = ("obs_idx", "var_idx")) -> pa.RecordBatch:
    """Rows from ``start`` on with their pointers (any base) as a batch of triples."""
    rows = np.repeat(np.arange(start, start + len(indptr) - 1, dtype=np.int64), np.diff(indptr).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.asarray(indices).astype(np.int64)), pa.array(np.asarray(values)).cast(ARROW[dtype])], names=[*names, "value"])


def option(options: dict[str, Any], name: str, default: Any) -> Any:
    """An option, whatever the case of its name, in the type of its default."""
    found = {k.lower(): v for k, v in options.items()}.get(name.lower())
    return default if found is None else type(default)(found) if default is not None else found
