"""Snapshots: directories of raw .npy files with a JSON manifest. Tasks map the files and read their own rows only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from annomat.errors import DtypeMismatchError, InvalidFormatError, MissingFieldError, UnsupportedVersionError
from annomat.functions.casts import false_for_null, nan_for_null, spark_type, to_dtype
from annomat.model import AnnotatedMatrix
from annomat.operators.profile import column_kinds
from annomat.operators.slots import SlotFilter
from annomat.sources.chunks import CHUNK_SIZE, Lines, RangeReader, Rows, chosen, lines, option, pushdown, triples
from annomat.sources.parts import Pieces, SparseRows, numbers, vectors

# The manifest's keys, file names and type names are fixed by the format.
_DESCR = {"f32": "<f4", "f64": "<f8", "i32": "<i4", "u32": "<u4"}
_SPARSE = ("layers", "obsp", "varp")
_KINDS = {"int": ("<i4", "int"), "float": ("<f8", "double"), "bool": ("|b1", "boolean")}


def load(path: str, descr: str | None = None, ndim: int = 1) -> np.ndarray:
    """A .npy file of version 1 in C order, mapped, of the declared type."""
    if not os.path.exists(path):
        raise MissingFieldError(path)
    with open(path, "rb") as f:
        head = f.read(8)
    if head[:6] != b"\x93NUMPY":
        raise InvalidFormatError(f"{path} is no .npy file")
    if head[6] != 1:
        raise UnsupportedVersionError(f"{path} has .npy version {head[6]}")
    found = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
    if found.ndim != ndim or ndim > 1 and not found.flags.c_contiguous:
        raise InvalidFormatError(f"{path} has {found.ndim} dimensions or is in Fortran order")
    if descr and found.dtype.str != descr:
        raise DtypeMismatchError(f"{path} holds {found.dtype.str}, expected {descr}")
    return found


def _lines(path: str) -> list[str]:
    if not os.path.exists(path):
        raise MissingFieldError(path)
    with open(path, encoding="utf-8") as f:
        return f.read().split("\n")[:-1]


def _manifest(path: str) -> dict[str, Any]:
    if not os.path.exists(f"{path}/meta.json"):
        raise MissingFieldError(f"{path}/meta.json")
    with open(f"{path}/meta.json", encoding="utf-8") as f:
        return json.load(f)


class NpySource(DataSource):
    """``spark.read.format("npysnap").option("slot", s).load(path)`` for X, obs, var, layers/k, obsp/k, varp/k, obsm/k, varm/k."""

    @classmethod
    def name(cls) -> str:
        return "npysnap"

    def _slot(self) -> tuple[str, str]:
        slot, _, key = option(self.options, "slot", "X").partition("/")
        return slot, key

    def schema(self) -> str:
        meta, (slot, key) = _manifest(self.options["path"]), self._slot()
        if slot == "X":
            return f"obs_idx bigint, var_idx bigint, value {spark_type((meta.get('X') or {'dtype': 'f32'})['dtype'])}"
        if slot == "layers":
            return f"obs_idx bigint, var_idx bigint, value {spark_type(meta['layers'][key]['dtype'])}"
        if slot in ("obsp", "varp"):
            return f"i bigint, j bigint, value {spark_type(meta[slot][key]['dtype'])}"
        if slot in ("obsm", "varm"):
            return "idx bigint, vec array<double>"
        if slot in ("obs", "var"):
            columns = "".join(f", `{c['name']}` {_KINDS.get(c['kind'], ('', 'string'))[1]}" for c in meta.get(slot, []))
            return f"{slot}_idx bigint, {slot}_id string{columns}"
        raise InvalidFormatError(f"no slot {slot!r} in this format")

    def reader(self, schema) -> DataSourceReader:
        return chosen(_Reader(self.options["path"], *self._slot(), option(self.options, "chunk_size", CHUNK_SIZE)), self.options)


class _Reader(RangeReader):
    def __init__(self, path: str, slot: str, key: str, chunk: int):
        self.path, self.slot, self.key, self.meta = path, slot, key, _manifest(path)
        n = self.meta["n_vars"] if slot in ("var", "varm", "varp") else self.meta["n_obs"]
        column = {"X": "obs_idx", "layers": "obs_idx", "obs": "obs_idx", "var": "var_idx", "obsp": "i", "varp": "i"}.get(slot, "idx")
        own = self.meta.get("X") if slot == "X" else self.meta[slot][key] if key else None
        each = own.get("nnz", n) / max(1, n) if own and slot in ("X", *_SPARSE) else own["shape"][1] if own else len(self.meta.get(slot, []))
        super().__init__(0 if slot == "X" and not self.meta.get("X") else n, chunk, column, each)
        files = []
        if slot in ("obs", "var"):
            files = [f"{path}/{slot}/{c['name']}_strings.txt" for c in self.meta.get(slot, []) if c["kind"] == "string"]
            files += [f"{path}/{slot}_index.txt"] if self.meta.get(f"{slot}_index") and os.path.exists(f"{path}/{slot}_index.txt") else []
        for file in files:
            if not os.path.exists(file):
                raise MissingFieldError(file)
        self.lines = {file: Lines(file, chunk) for file in files}

    def rows_of(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        a, b, at = partition.start, partition.stop, f"{self.path}/{self.slot}"
        if self.slot == "X" or self.slot in _SPARSE:
            own = self.meta["X"] if self.slot == "X" else self.meta[self.slot][self.key]
            base = at if self.slot == "X" else f"{at}/{self.key}"
            ptr = np.asarray(load(f"{base}/indptr.npy", "<u8")[a : b + 1]).astype(np.int64)
            cut = slice(int(ptr[0]), int(ptr[-1]))
            yield triples(a, ptr, load(f"{base}/indices.npy", "<u4")[cut], load(f"{base}/data.npy", _DESCR[own["dtype"]])[cut], own["dtype"], ("i", "j") if self.slot in ("obsp", "varp") else ("obs_idx", "var_idx"))
        elif self.slot in ("obsm", "varm"):
            rows = np.asarray(load(f"{at}/{self.key}.npy", "<f8", 2)[a:b])
            vec = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64())) if rows.shape[1] else pa.array([[]] * len(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int64)), vec], names=["idx", "vec"])
        else:
            index = f"{self.path}/{self.slot}_index.txt"
            ids = self.lines[index].read(a, b) if index in self.lines else [str(i) for i in range(a, b)]
            names, arrays = [f"{self.slot}_idx", f"{self.slot}_id"], [pa.array(np.arange(a, b, dtype=np.int64)), pa.array(ids, pa.string())]
            for c in self.meta.get(self.slot, []):
                names.append(c["name"])
                stem = f"{at}/{c['name']}"
                if c["kind"] in _KINDS:
                    arrays.append(pa.array(np.array(load(f"{stem}.npy", _KINDS[c["kind"]][0])[a:b])))
                elif c["kind"] == "string":
                    arrays.append(pa.array(self.lines[f"{stem}_strings.txt"].read(a, b), pa.string()))
                elif c["kind"] == "categorical":
                    codes, levels = np.array(load(f"{stem}_codes.npy", "<u4")[a:b]).astype(np.int64), _lines(f"{stem}_levels.txt")
                    arrays.append(pa.array([levels[k] if k < len(levels) else None for k in codes.tolist()], pa.string()))
                else:
                    raise InvalidFormatError(f"unknown kind {c['kind']!r} of column {c['name']!r}")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def read(spark: SparkSession, path: str, chunk_size: int = CHUNK_SIZE, **_: Any) -> AnnotatedMatrix:
    """A snapshot with all its slots, none of them read yet. A missing X is empty, missing ids are the row numbers."""
    spark.dataSource.register(NpySource)
    meta = _manifest(path)
    get = lambda slot: spark.read.format("npysnap").option("slot", slot).option("chunk_size", chunk_size).option("pushdown", pushdown(spark)).load(path)
    slots = {s: {k: get(f"{s}/{k}") for k in sorted(meta.get(s, {}))} for s in ("layers", "obsp", "varp", "obsm", "varm")}
    levels = {s: {c["name"]: _lines(f"{path}/{s}/{c['name']}_levels.txt") for c in meta.get(s, []) if c["kind"] == "categorical"} for s in ("obs", "var")}
    uns = {}
    if meta.get("uns") and os.path.exists(f"{path}/uns.json"):
        with open(f"{path}/uns.json", encoding="utf-8") as f:
            uns = json.load(f)
    return AnnotatedMatrix(
        spark, meta["n_obs"], meta["n_vars"], (meta.get("X") or {"dtype": "f32"})["dtype"], get("X"), get("obs"), get("var"), uns=uns, levels=levels,
        layer_dtypes={k: v["dtype"] for k, v in meta.get("layers", {}).items()}, format="npy", in_order=True, **slots,
    )


def _put(path: str, descr: str, blocks: Iterable[np.ndarray | bytes], tail: tuple[int, ...] = ()) -> int:
    """A .npy file from blocks of its rows; its header has room for the final shape. Returns the rows."""
    kind = np.dtype(descr)
    with open(path, "wb") as f:
        f.write(bytes(128))
        for block in blocks:
            f.write(block if isinstance(block, bytes) else block.astype(kind).tobytes())
        n = (f.tell() - 128) // (kind.itemsize * max(1, int(np.prod(tail))))
        f.seek(0)
        text = f"{{'descr': '{kind.str}', 'fortran_order': False, 'shape': {(n, *tail)}, }}"
        f.write(b"\x93NUMPY\x01\x00" + (128 - 10).to_bytes(2, "little") + text.ljust(128 - 10 - 1).encode() + b"\n")
    return n


def _sparse(x: DataFrame, n: int, m: int, dtype: str, at: str, names: tuple[str, str], in_order: bool) -> dict[str, Any]:
    os.makedirs(at, exist_ok=True)
    with SparseRows(x, n, dtype, _DESCR[dtype], names, in_order) as rows:
        _put(f"{at}/data.npy", _DESCR[dtype], rows.stream("data"))
        _put(f"{at}/indices.npy", "<u4", rows.stream("index"))
        _put(f"{at}/indptr.npy", "<u8", rows.pointers())
        return {"shape": [n, m], "nnz": rows.rows, "dtype": dtype}


def _table(df: DataFrame, slot: str, known: dict[str, list[str]], kinds: list[tuple[str, str]], with_ids: bool, path: str, in_order: bool) -> None:
    """The files of a metadata table: executors write the columns of their rows, which are joined here."""
    idx, ident = f"{slot}_idx", f"{slot}_id"
    columns = [F.col(idx).cast("long").alias("_idx"), F.col(ident).alias("_id")]
    for k, (c, kind) in enumerate(kinds):
        v = F.col(f"`{c}`")
        if kind == "categorical":
            codes = F.create_map(*[y for k_, x in enumerate(known[c]) for y in (F.lit(x), F.lit(k_).cast("long"))]) if known[c] else None
            v = F.coalesce(F.element_at(codes, v), F.lit(0xFFFFFFFF)) if codes is not None else F.lit(0xFFFFFFFF).cast("long")
        elif kind == "string":
            v = F.coalesce(v.cast("string"), F.lit(""))
        else:
            v = {"int": lambda x: F.coalesce(to_dtype(x, "i32"), F.lit(0)), "float": nan_for_null, "bool": false_for_null}[kind](v)
        columns.append(v.alias(f"_{k}"))

    def encode(batch: pa.RecordBatch) -> dict[str, bytes]:
        out = {"id": lines(batch.column(1), f"ids of {slot}")} if with_ids else {}
        for k, (c, kind) in enumerate(kinds):
            own = batch.column(k + 2)
            out[str(k)] = lines(own, f"values of {c}") if kind == "string" else numbers(own, "<u4" if kind == "categorical" else _KINDS[kind][0])
        return out

    with Pieces(df.sparkSession) as rows:
        rows.sorted(df.select(*columns), encode, in_order=in_order)
        for k, (c, kind) in enumerate(kinds):
            stem = f"{path}/{slot}/{c}"
            if kind == "categorical":
                _put(f"{stem}_codes.npy", "<u4", rows.stream(str(k)))
                with open(f"{stem}_levels.txt", "w", encoding="utf-8") as f:
                    f.writelines(f"{x}\n" for x in known[c])
            elif kind != "string":
                _put(f"{stem}.npy", _KINDS[kind][0], rows.stream(str(k)))
        texts = {f"{path}/{slot}/{c}_strings.txt": str(k) for k, (c, kind) in enumerate(kinds) if kind == "string"} | ({f"{path}/{slot}_index.txt": "id"} if with_ids else {})
        for file, stream in texts.items():
            with open(file, "wb") as f:
                f.writelines(rows.stream(stream))


def write(data: AnnotatedMatrix, path: str, only: str | None = None, exclude: str | None = None, filter: SlotFilter | None = None, **_: Any) -> str:
    """A snapshot of the selected slots; the manifest comes last. Executors sort and write each slot in pieces, which are joined here."""
    keep = filter or SlotFilter.parse(only, exclude)
    os.makedirs(path, exist_ok=True)
    n, m = data.n_obs, data.n_vars
    meta: dict[str, Any] = {"format_version": "0.1", "n_obs": n, "n_vars": m}
    if keep.includes("X"):
        meta["X"] = _sparse(data.x, n, m, data.dtype, f"{path}/X", ("obs_idx", "var_idx"), data.in_order)
    for slot, df, size in (("obs", data.obs, n), ("var", data.var, m)):
        os.makedirs(f"{path}/{slot}", exist_ok=True)
        known = data.levels.get(slot, {})
        kinds = [(c, k) for c, k in column_kinds(df, (f"{slot}_idx", f"{slot}_id"), known) if keep.includes(f"{slot}:{c}")]
        with_ids = keep.includes(f"{slot}_index")
        if kinds or with_ids:
            _table(df, slot, known, kinds, with_ids, path, data.in_order)
        if with_ids:
            meta[f"{slot}_index"] = {"n": size}
        meta[slot] = [{"name": c, "kind": k, "shape": [size], **({"n_levels": len(known[c])} if k == "categorical" else {})} for c, k in kinds]
    for slot, size in (("obsm", n), ("varm", m)):
        for key, df in getattr(data, slot).items():
            if keep.includes(f"{slot}:{key}"):
                os.makedirs(f"{path}/{slot}", exist_ok=True)
                rows, width = vectors(df, data.in_order)
                with rows:
                    _put(f"{path}/{slot}/{key}.npy", "<f8", rows.stream("vec"), (width,))
                meta.setdefault(slot, {})[key] = {"shape": [size, width], "dtype": "f64"}
    for slot, size, other in (("layers", n, m), ("obsp", n, n), ("varp", m, m)):
        for key, df in getattr(data, slot).items():
            if keep.includes(f"{slot}:{key}"):
                names = ("obs_idx", "var_idx") if slot == "layers" else ("i", "j")
                dtype = data.layer_dtypes.get(key, "f32") if slot == "layers" else "f32"
                meta.setdefault(slot, {})[key] = _sparse(df, size, other, dtype, f"{path}/{slot}/{key}", names, data.in_order)
    if keep.includes("uns") and data.uns:
        with open(f"{path}/uns.json", "w", encoding="utf-8") as f:
            json.dump(data.uns, f, indent=2)
        meta["uns"] = True
    with open(f"{path}/meta.json", "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=2)
    return path
